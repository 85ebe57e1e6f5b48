"""Matching by acoustic fingerprints, for records that have no match by their names. An option; nothing uses it unless asked.

A fingerprint is a sequence of 32-bit frames. Two of them are alike at a shift of so many frames if few bits differ where they overlap. Candidates come from
bit sampling: each frame is hashed by some of its bits, ``bits`` in each of ``tables`` samples, so that frames with few different bits often meet. Of a
fingerprint's samples the rarest are used, as many as ``probes``, whatever their frequency, so that silence and other common frames cost nothing where
there is something else to go by. Candidates that meet are then compared frame by frame, at the shifts at which they met.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from concord.session import stored


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    tables: int = 4
    probes: int = 64
    overlap: int = 8  # frames that must overlap
    alike: float = 0.85  # least share of equal bits
    seed: int = 5


def masks(s: Settings) -> list[int]:
    """The bits of each sample, as masks of 32 bits."""
    rng = random.Random(s.seed)
    return [sum(1 << b for b in rng.sample(range(32), s.bits)) for _ in range(s.tables)]


def _samples(rows: DataFrame, s: Settings) -> DataFrame:
    """``id, frames, place, key``: the sampled bits of every frame."""
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("frame").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(masks(s))))
    own = rows.select("id", F.posexplode(F.transform("frames", lambda x: x.cast("long").bitwiseAND(F.lit((1 << 32) - 1)))).alias("place", "frame"))
    return own.select("id", "place", F.explode(keys).alias("key"))


def alike(source: DataFrame, target: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``source_id, target_id, shift, equal``: pairs of ``id, frames`` with a share of equal bits of at least ``alike``, at their best shift.

    ``shift`` is added to a place in the source to get that in the target. Null and empty fingerprints match nothing. Ties go to the smallest absolute
    shift, then the smaller. Pairs that share none of the source's rarest samples are not found; the tests state the recall.
    """
    own, other = (df.where("size(frames) > 0").select("id", "frames") for df in (source, target))
    found = stored(_samples(other, s).dropDuplicates(["id", "key"]), "samples")  # a key's first place would do; one place each
    often = found.groupBy("key").agg(F.count("*").alias("times"))
    asked = _samples(own, s).dropDuplicates(["id", "key"]).join(often, "key")
    rarest = F.row_number().over(W.partitionBy("id").orderBy("times", "key"))
    asked = asked.withColumn("n", rarest).where(F.col("n") <= s.probes).select("key", F.col("id").alias("source_id"), F.col("place").alias("p"))
    met = asked.join(found.select("key", F.col("id").alias("target_id"), F.col("place").alias("q")), "key")
    met = met.select("source_id", "target_id", (F.col("q") - F.col("p")).alias("shift")).distinct()
    both = met.join(own.select(F.col("id").alias("source_id"), F.col("frames").alias("a")), "source_id").join(other.select(F.col("id").alias("target_id"), F.col("frames").alias("b")), "target_id")
    from_, to = "greatest(0, -shift)", "least(size(a), size(b) - shift)"
    differ = f"aggregate(sequence({from_}, {to} - 1), 0, (n, i) -> n + bit_count((CAST(a[i] AS BIGINT) ^ CAST(b[i + shift] AS BIGINT)) & 4294967295L))"
    rows = both.where(f"{to} - {from_} >= {s.overlap}").selectExpr("source_id", "target_id", "shift", f"1 - {differ} / (32D * ({to} - {from_})) AS equal").where(F.col("equal") >= s.alike)
    best = F.min(F.struct((-F.col("equal")).alias("less"), F.abs("shift").alias("far"), "shift"))
    return rows.groupBy("source_id", "target_id").agg(best.alias("x")).select("source_id", "target_id", "x.shift", (-F.col("x.less")).alias("equal"))


def fingerprint_stage(decisions: DataFrame, source: DataFrame, target: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Decisions whose ``no_match`` rows are automatic where a target fingerprint is alike, the best one, ties to the smaller id; method ``fingerprint``."""
    open_ = source.join(decisions.where("decision = 'no_match'").select(F.col("source_id").alias("id")), "id", "left_semi")
    best = alike(open_, target, s).groupBy("source_id").agg(F.min(F.struct((-F.col("equal")).alias("less"), "target_id")).alias("f"))
    rows = decisions.join(best, "source_id", "left")
    hit = F.col("f").isNotNull()
    pick = lambda c, v: F.when(hit, v).otherwise(F.col(c)).alias(c)
    one = F.array(F.struct(F.col("f.target_id").alias("candidate_id"), (-F.col("f.less")).alias("score")))
    new = {"decision": F.lit("auto"), "method": F.lit("fingerprint"), "candidate_id": F.col("f.target_id"), "score": -F.col("f.less"), "candidates": one}
    return rows.select(*(pick(c, new[c]) if c in new else F.col(c) for c in decisions.columns))
