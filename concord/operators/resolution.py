"""Records without a match get candidates from a catalogue search and are decided again; skips, rejects and their reset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from concord.functions.similarity import Policy
from concord.functions.text import search_text
from concord.operators.matching import FLAGS, matched, on_service
from concord.operators.merging import merged
from concord.operators.stores import insert_or_ignore
from concord.session import stored


def searched(records: DataFrame, source: str, target: str, look_up: Callable[[DataFrame], DataFrame], p: Policy = Policy(), **overrides) -> tuple[DataFrame, DataFrame]:
    """Decisions for the records that are not on the target yet, and the records with what the search has found for them.

    ``look_up`` takes texts ``q`` and gives raw tracks with their ``q`` (``sources.search.looked_up``). Only records without a match are looked up,
    by title without bracketed parts and artist. What is found is merged into the records (equal codes and ids join), and all are decided again.
    """
    from concord.sources.pages import canonical

    first = stored(matched(records, source, target, p=p, pending_only=True, **overrides), "first")
    open_ = records.where(on_service(source) & ~on_service(target)).join(first.where("decision = 'no_match'").select(F.col("source_id").alias("id")), "id", "left_semi")
    found = canonical(look_up(open_.select(search_text(F.col("title"), F.col("artist")).alias("q"))), target).distinct()
    found = stored(found.withColumn("n", F.monotonically_increasing_id()), "found")  # asked and numbered once, read several times
    last = records.agg(F.max("ord")).first()[0] or 0
    new = found.withColumn("ord", F.lit(last + 1) + F.col("n")).drop("n")
    every = stored(merged(records.select(*new.columns).unionByName(new)).drop("merged"), "merged")
    return matched(every, source, target, p=p, pending_only=True, **overrides), every


def skip(exclusions: DataFrame, tracks: DataFrame, target: str) -> DataFrame:
    """Exclusions with a skip of every ``track_id``: never matched or added on the target."""
    rows = tracks.select("track_id", F.lit(target).alias("target_service"), F.lit("skip").alias("kind"), F.lit("").alias("candidate_id"))
    return insert_or_ignore(exclusions, rows, exclusions.columns)


def reject(exclusions: DataFrame, pairs: DataFrame, target: str) -> DataFrame:
    """Exclusions with a reject of every ``track_id, candidate_id``: this candidate is not offered again."""
    rows = pairs.select("track_id", F.lit(target).alias("target_service"), F.lit("reject").alias("kind"), "candidate_id")
    return insert_or_ignore(exclusions, rows, exclusions.columns)


def reset(mappings: DataFrame, exclusions: DataFrame, tracks: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Mappings and exclusions without what was decided by hand for the ``track_id, source_track_id`` of ``tracks``."""
    own = tracks.select(F.col("source_track_id"), F.lit(source).alias("source_service")).distinct()
    gone = tracks.select("track_id", F.lit(target).alias("target_service")).distinct()
    return mappings.join(own, ["source_service", "source_track_id"], "left_anti"), exclusions.join(gone, ["track_id", "target_service"], "left_anti")


def library_filter(records: DataFrame, shown: str = "all") -> DataFrame:
    """Records of ``all`` services, of ``a``, of ``b``, or on ``both``."""
    if shown == "all":
        return records
    need = sum(FLAGS.values()) if shown == "both" else FLAGS[shown]
    return records.where(F.col("availability").bitwiseAND(need) == need)


def free_text(records: DataFrame, text: str, columns: tuple[str, ...] = ("title", "artist")) -> DataFrame:
    """Records whose title or artist contains a text, in any case; an empty text finds all."""
    if not text:
        return records
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lower(F.lit(text))), F.lit(False))
    return records.where(hit)
