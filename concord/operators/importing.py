"""Imports of a service's library into the tables of a ``running.library``, and reports out of them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from concord.operators.commits import Store
from concord.operators.merging import entities, follow, merged, renamed_ids
from concord.operators.metrics import confidence_histogram, library_summary, run_metrics
from concord.operators.stores import lists_with_members
from concord.session import stored
from concord.sources import paged, pages
from concord.sources.sinks import histogram_path, iso_time, six_digits, write_csv


@dataclass(frozen=True)
class Report:
    service: str
    dry_run: bool
    tracks: int
    lists: int
    list_tracks: int  # of all lists, repeated ones too


def imported(store: Store, service: str, tracks: DataFrame, lists: DataFrame, dry_run: bool = False) -> Report:
    """Raw tracks and lists of a service (``sources.paged``) become canonical rows and are merged into the library with one commit.

    Rows that share a service id, a code or an id with earlier ones join them and keep the earlier id; lists follow to the ids that their tracks have
    then, in order and with repeated tracks. Lists that come again replace themselves and keep their id on the other service. A dry run counts what would come and writes nothing.
    """
    own = stored(pages.canonical(tracks, service), "tracks")
    heads, members = (stored(x, name) for x, name in zip(pages.canonical_list_tracks(lists, service), ("heads", "members")))
    report = Report(service, dry_run, own.count(), heads.count(), members.count())
    if dry_run:
        return report
    old, known = store.read("records"), store.read("lists")
    last = old.agg(F.max("ord")).first()[0]
    first = 0 if last is None else last + 1
    # library tracks come before those of lists; the numbers are written, so that they stay the same
    new = stored(own.withColumn("__list", F.lit(0)).unionByName(members.withColumn("__list", F.lit(1))).withColumn("__row", F.monotonically_increasing_id()), "new")
    new = new.withColumn("ord", F.lit(first) + F.col("__list").cast("long") * (1 << 52) + F.col("__row")).drop("__list", "__row")
    every = stored(old.select(*new.columns).unionByName(new), "every")
    groups = stored(entities(every), "entities")  # components are searched once
    records = merged(every, groups).drop("merged")
    renames = stored(renamed_ids(every, groups), "renames")
    rows = known.select("id", "track_ids").join(heads.select("id"), "id", "left_anti").unionByName(heads.select("id", "track_ids"))
    flat = rows.select(F.col("id").alias("list_id"), F.posexplode("track_ids").alias("position", "track_id"))
    other = {c: F.coalesce(F.col(f"n.{c}"), F.col(f"k.{c}")).alias(c) for c in ("name", "owner", "description", "a_id", "b_id")}
    all_heads = known.drop("track_ids").alias("k").join(heads.drop("track_ids").alias("n"), "id", "full_outer").select("id", *other.values(), "k.created_at", "k.updated_at")
    store.commit(f"import-{service}-{uuid.uuid4().hex}", {"records": _dense(records), "lists": lists_with_members(all_heads, follow(flat, renames))}, replaced=("records", "lists"))
    return report


def _dense(records: DataFrame) -> DataFrame:
    """Records numbered anew, in their order."""
    from concord.operators.ordering import numbered

    rows = records.withColumnRenamed("ord", "__ord")
    return numbered(rows, "__ord", name="ord")[0].drop("__ord")


def import_service(store: Store, service: str, base: str, dry_run: bool = False, **options) -> Report:
    """Read a service's library and lists, and import them. ``options`` are those of ``sources.paged``."""
    spark = store.spark
    return imported(store, service, paged.library_tracks(spark, service, base, **options), paged.library_lists(spark, service, base, **options), dry_run)


def import_summary(store: Store) -> DataFrame:
    """``total, on_a, on_b, on_both, lists`` of a library."""
    return library_summary(store.read("records")).withColumn("lists", F.lit(store.read("lists").count()))


def export_metrics(store: Store, path: str, buckets: int = 10) -> None:
    """The metrics of all runs as CSV in ``path``, and the histograms of their scores beside it."""
    runs, outcomes = store.read("runs"), store.read("outcomes")
    table = run_metrics(outcomes, runs)
    numbers = {c: six_digits(F.col(c)) for c in ("mean_score", "auto_rate")}
    write_csv(table.withColumns(numbers | {"start": iso_time(F.col("start"))}), path)
    write_csv(confidence_histogram(outcomes, buckets), histogram_path(path))
