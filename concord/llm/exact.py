"""Exact deduplication by a tree of merged digest runs (operator 7).

Every scan task turns its rows into one run, sorted by digest, of (digest, representative, count). Runs then
meet in binomial rounds: in each round ``2 ** fan`` neighbouring runs are merged, and of equal digests one
entry, with the wanted identifier, goes on. Copies thus collapse at every level before they meet many others:
however large a group of copies is, a merge sees at most one entry for it from each run. The maximum of a
struct makes Spark merge by sorting, with spill, so no task holds a run in memory.

A digest is SHA-256 of the normalised text, and entries are only joined when a second, unrelated hash agrees;
the byte lengths of a group must agree too, else the job fails rather than dropping a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from concord.session import stored

#: The letters that normalisation lower-cases.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

KEY = ["digest", "check"]


def normalised(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = normalised(F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), text.alias("t")).select("id", F.unhex(F.sha2("t", 256)).alias("digest"), F.xxhash64("t").alias("check"), F.octet_length("t").alias("size"))


def merged_runs(rows: DataFrame, keep: str = "max", fan: int = 3) -> DataFrame:
    """``digest, check, keep_id, group_size``: one entry for each distinct text."""
    best = F.max if keep == "max" else F.min
    # a null identifier loses against any other
    entry = F.struct((F.col("id").isNotNull() if keep == "max" else F.col("id").isNull()).alias("known"), "id")
    run = rows.select(*KEY, entry.alias("top"), F.col("size").alias("lo"), F.col("size").alias("hi"), F.lit(1).cast("long").alias("n"), F.spark_partition_id().alias("run"))
    rounds = max(1, -(-(max(1, rows.rdd.getNumPartitions() - 1).bit_length()) // fan))
    for level in range(rounds):
        last = level == rounds - 1
        run = run.withColumn("run", F.shiftright("run", fan))
        run = run.groupBy(*KEY, *([] if last else ["run"])).agg(best("top").alias("top"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    same = F.when(F.col("lo") == F.col("hi"), F.col("top.id")).otherwise(F.raise_error(F.lit("texts of different lengths share both digests")))
    return run.select(*KEY, same.alias("keep_id"), F.col("n").alias("group_size"))


def exact_groups(docs: DataFrame, keep: str = "max", fan: int = 3) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The row with the largest (or smallest) ``doc_id`` of equal texts stays. A null ``doc_id`` is kept only in a
    group without other ids; of repeated rows with that id, all say ``kept`` (``drop_copies`` keeps one). Null
    and empty texts are equal. Other columns are not read; an empty table gives no rows.
    """
    rows = digests(docs)
    groups = stored(merged_runs(rows, keep, fan), "groups")  # so that Spark can split a hot digest in the join
    return rows.join(groups, KEY).select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, keep: str = "max", fan: int = 3) -> DataFrame:
    """One whole row of each group of equal texts, with all columns of ``docs``.

    Repeated rows have the same id and text; the one with the largest hash of all columns stays. Nulls count as empty texts.
    """
    names = docs.columns
    key = [F.unhex(F.sha2("__t", 256)).alias("__digest"), F.xxhash64("__t").alias("__check")]
    own = docs.select(F.struct(*names).alias("__row"), normalised(F.col("text")).alias("__t"))
    rows = own.select("__row", *key, F.xxhash64("__row").alias("__h"))
    best = F.max if keep == "max" else F.min
    groups = merged_runs(digests(docs), keep, fan).select(F.col("digest").alias("__digest"), F.col("check").alias("__check"), F.col("keep_id").alias("__keep"))
    groups = stored(groups, "groups")
    first = rows.join(groups, ["__digest", "__check"]).where(F.col("__row.doc_id").eqNullSafe(F.col("__keep")))
    # what is left has one row for a group, or rows repeated with one id
    one = first.groupBy("__digest", "__check").agg(F.max_by("__row", "__h").alias("__row"))
    return one.select("__row.*")
