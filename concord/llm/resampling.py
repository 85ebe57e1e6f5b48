"""Importance resampling toward a target distribution (operator 12).

Features are all runs of 1 to ``longest`` consecutive words of a text, hashed into ``buckets``. A bucket's gain is the log of how much
likelier it is in the target than in the corpus; a document's weight is the sum of the gains of its features, and documents are drawn
without replacement by their weights (the greatest weight plus Gumbel noise, which is made from the ids).

Each partition goes through its texts in shares of bounded size. The words of a share are numbered, and its suffixes are sorted by their
first ``longest`` words (prefix doubling). In that order equal n-grams are neighbours: where the common prefix of neighbours falls below
``k``, one run of equal ``k``-grams ends. A run is hashed once, by its first occurrence, and its bucket is scattered back to all its
occurrences, from which counts and weights are summed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from concord.session import for_long_texts, stored

#: Words that a share has before its suffixes are sorted; one longer text is a share of its own.
WORDS = 400_000

#: A-Z in lower case; what is in no word becomes a space.
SIGNS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Settings:
    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: str = "2024"


def text_words(text: bytes) -> list[bytes]:
    return text.translate(SIGNS).split()


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of ``ids`` (0 and more), sorted by their first ``depth`` numbers or more; ties by start."""
    rank, h = ids, 1
    order = np.argsort(rank, kind="stable")
    while h < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-h] = rank[h:] + 1
        key = rank.astype(np.int64) * (int(rank.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        rank = np.zeros(len(ids), np.int64)
        rank[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        h *= 2
    return order


def common_prefixes(ids: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many numbers each suffix has in common with the one before it in ``order``, up to ``depth``; 0 in ``ids`` equals nothing."""
    lcp, live = np.zeros(len(order), np.int64), np.ones(max(0, len(order) - 1), bool)
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)])
    for k in range(depth):
        first, second = padded[order[:-1] + k], padded[order[1:] + k]
        live &= (first == second) & (first != 0)
        lcp[1:] += live
    return lcp


def share_buckets(texts: list[list[bytes]], s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of the features: the texts and the buckets of all their occurrences."""
    seen: dict[bytes, int] = {}
    flat, owner, left, words = [], [], [], []
    for doc, text in enumerate(texts):
        n = len(text)
        flat.append(np.fromiter((seen.setdefault(w, len(seen) + 1) for w in text), np.int64, n))
        flat.append(np.zeros(1, np.int64))  # no feature goes over the end of a text
        owner.append(np.full(n + 1, doc))
        left.append(np.arange(n, -1, -1))
        words += [*text, b""]
    if not words:
        return
    ids, owner, left = np.concatenate(flat), np.concatenate(owner), np.concatenate(left)
    order = suffix_order(ids, s.longest)
    lcp = common_prefixes(ids, order, s.longest)
    for k in range(1, s.longest + 1):
        run = np.cumsum(lcp < k) - 1
        heads = order[np.flatnonzero(lcp < k)]
        hashed = np.fromiter((crc32(b" ".join(words[i : i + k])) % s.buckets for i in heads.tolist()), np.int64, len(heads))
        bucket = np.empty(len(ids), np.int64)
        bucket[order] = hashed[run]
        whole = left >= k
        yield owner[whole], bucket[whole]


def _shares(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, list[list[bytes]]]]:
    """Texts of the batches in shares: the batch, the first row, the words."""
    for b in batches:
        texts, size, first = [], 0, 0
        for i, text in enumerate(b.column(column)):
            texts.append(text_words(text.as_buffer().to_pybytes()) if text.is_valid else [])
            size += len(texts[-1])
            if size >= WORDS:
                yield b, first, texts
                texts, size, first = [], 0, i + 1
        if texts:
            yield b, first, texts


def _text(df: DataFrame) -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")


def bucket_counts(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``bucket, n``: how many features of all texts fall into each bucket. Counts leave a task summed."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(s.buckets, np.int64)
        for _, _, texts in _shares(batches, 0):
            for _, buckets in share_buckets(texts, s):
                n += np.bincount(buckets, minlength=s.buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bucket", "n"])

    return rows.select(_text(rows)).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """The gain of every bucket, in thousandths; both tables' counts are at most ``buckets`` rows."""
    counts = []
    for rows in (docs, target):
        n = [0] * s.buckets
        for r in bucket_counts(rows, s).collect():
            n[r[0]] = r[1]
        counts.append(n)
    own, goal = counts
    all_own, all_goal = sum(own), sum(goal)
    a, b = float(all_own + s.buckets), float(all_goal + s.buckets)
    return np.array([math.floor(1000 * math.log((t + 1) * a / ((c + 1) * b))) for c, t in zip(own, goal)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, s: Settings = Settings()) -> DataFrame:
    """``doc_id, n_features, n_words, weight`` of every document. One pass, no shuffle."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, first, texts in _shares(batches, 1):
            n, w = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for owner, buckets in share_buckets(texts, s):
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
                sums = np.concatenate([[0], np.cumsum(gain[buckets])])  # owners come in order
                n += np.diff(ends)
                w += sums[ends[1:]] - sums[ends[:-1]]
            words = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array(n), words, pa.array(w)], ["doc_id", "n_features", "n_words", "weight"])

    return docs.select("doc_id", _text(docs)).mapInArrow(weighed, f"doc_id {dict(docs.dtypes)['doc_id']}, n_features long, n_words long, weight long")


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise of an id, in thousandths, rounded down. A null id counts as empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; ``rank`` is null for those that are not drawn.

    Of the documents with ``least_words`` words the best ``percent`` in a hundred (rounded down) are drawn, ties to the smaller ``doc_id``, null
    first; among repeated rows of one id any order is the same result. Null and empty texts have no features and weight 0. Empty tables of
    documents give no rows; an empty target leaves the corpus' own counts. Other columns may have any name.

    Texts are read twice, once to count and once to weigh. Ranks come from ranges of the scores: rows are dealt by range, numbered
    inside it, and the ranges' sizes (one row for each) are added up, so no task sees all rows.
    """
    spark = for_long_texts(docs.sparkSession)
    found = weights(docs, gains(docs, target, s), s)
    found = stored(found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), s.seed)), "weights")
    out = ["doc_id", "n_features", "weight", "score"]
    able = F.col("n_words") >= s.least_words
    asked = found.where(able).withColumn("row", F.monotonically_increasing_id())
    order = [F.desc("score"), F.asc("doc_id"), F.asc("row")]
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = stored(asked.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).drop("n_words"), "ranges")
    sizes = sorted(map(tuple, ranged.groupBy("part").agg(F.count("*").alias("n")).collect()))  # a row for each range
    n, base = 0, []
    for part, k in sizes:
        base.append((part, n))
        n += k
    drawn = n * s.percent // 100
    inside = F.row_number().over(W.partitionBy("part").orderBy(*order))
    before = F.broadcast(spark.createDataFrame(base, "part int, base long"))
    ranked = ranged.withColumn("k", inside).join(before, "part").withColumn("rank", F.col("base") + F.col("k"))
    ranked = ranked.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return ranked.unionByName(found.where(~able).select(*out, F.lit(None).cast("long").alias("rank")))
