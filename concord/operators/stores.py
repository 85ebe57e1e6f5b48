"""Keyed tables as snapshots: a change takes a table and rows, and gives the table's next state.

Snapshots are written to a new place and then read from there; nothing is overwritten while it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def latest(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key by ``order``; of several at one place the largest, so that no run differs from another."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(order.desc(), F.struct(*rows.columns).desc()))
    return rows.withColumn("__n", rank).where("__n = 1").drop("__n")


def upsert(table: DataFrame, rows: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Rows replace those with their key; among new rows of one key the last by ``order`` counts, without it the largest."""
    new = latest(rows, key, F.col(order) if order else F.struct(*rows.columns))
    return table.join(new.select(*key), key, "left_anti").unionByName(new)


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the table does not have; of several with one key the largest."""
    return table.unionByName(latest(rows, key, F.struct(*rows.columns)).join(table.select(*key), key, "left_anti"))


def delete(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def delete_records(records: DataFrame, children: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Records and their child rows without those with the ids; ``children`` has tables with their foreign keys."""
    gone = ids.select("id").distinct()
    rest = {n: t.join(gone.select(F.col("id").alias(c)), c, "left_anti") for n, (t, c) in children.items()}
    return records.join(gone, "id", "left_anti"), rest


def save_lists(headers: DataFrame, members: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers replaced by those of ``new``, and their members by its ordered ``track_ids``."""
    own = new.select(F.col("id").alias("list_id"), F.posexplode("track_ids").alias("position", "track_id")).withColumn("position", F.col("position").cast("long"))
    rest = members.join(new.select(F.col("id").alias("list_id")).distinct(), "list_id", "left_anti")
    return upsert(headers, new.drop("track_ids"), ["id"]), rest.unionByName(own)


def lists_with_members(headers: DataFrame, members: DataFrame) -> DataFrame:
    """Headers with ``track_ids`` in order; repeated tracks stay, lists without members have an empty one."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("position", "track_id"))), lambda x: x.track_id)
    ids = members.groupBy(F.col("list_id").alias("id")).agg(ordered.alias("track_ids"))
    return headers.join(ids, "id", "left").withColumn("track_ids", F.coalesce("track_ids", F.array().cast("array<string>")))


def checkpoint_upsert(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Status, error and time are overwritten; earlier members stay unless the new row has some."""
    key = ["run_id", "op_key"]
    new = rows.select(*key, *(F.col(c).alias(f"n_{c}") for c in ("status", "previous_track_ids", "error", "updated_at")), F.lit(True).alias("new"))
    pick = lambda c: F.when(F.col("new"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    return log.join(new, key, "full_outer").select(*key, pick("status"), F.coalesce("n_previous_track_ids", "previous_track_ids").alias("previous_track_ids"), pick("error"), pick("updated_at"))


def exclusion_state(exclusions: DataFrame) -> DataFrame:
    """``track_id, target_service, skipped, rejected``: exclusions folded to a flag and a sorted set."""
    return exclusions.groupBy("track_id", "target_service").agg(F.max(F.col("kind") == "skip").alias("skipped"), F.sort_array(F.collect_set(F.when(F.col("kind") == "reject", F.col("candidate_id")))).alias("rejected"))


def choose(mappings: DataFrame, exclusions: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Choices become mappings with a confidence of at least 0.99, or 1 without a score; their exclusions go."""
    conf = F.coalesce(F.greatest(F.col("score"), F.lit(0.99)), F.lit(1.0))
    conf = F.when(F.col("score").isNull(), F.lit(1.0)).otherwise(conf)
    rows = choices.select("source_service", "source_track_id", "target_service", "target_track_id", conf.alias("confidence"))
    cleared = choices.select(F.col("source_track_id").alias("track_id"), "target_service").distinct()
    return upsert(mappings, rows, ["source_service", "source_track_id"]), exclusions.join(cleared, ["track_id", "target_service"], "left_anti")


def latest_resumable(runs: DataFrame) -> DataFrame:
    """The most recent run, if it is not completed."""
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(1).where("status <> 'completed'")


def find(records: DataFrame, column: str, value) -> DataFrame:
    """The first record, in order, with a value: by id, service id or code. The filter reaches the scan."""
    return records.where(F.col(column) == value).orderBy("ord").limit(1)


def outcomes_in_time(outcomes: DataFrame) -> DataFrame:
    return outcomes.orderBy("recorded_at", "source_track_id")


def append_outcomes(outcomes: DataFrame, path: str) -> None:
    """Outcomes in folders by run: those of a run that is written again replace its earlier ones. Outcomes without a run are added."""
    runs, none = outcomes.where("run_id IS NOT NULL"), outcomes.where("run_id IS NULL")
    runs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    if not none.isEmpty():
        none.write.mode("append").partitionBy("run_id").parquet(path)


def recent_runs(runs: DataFrame, n: int | None = None) -> DataFrame:
    """Runs, newest first; all, or the most recent ``n``."""
    ordered = runs.orderBy(F.desc("started_at"), F.desc("id"))
    return ordered if n is None else ordered.limit(n)
