"""Keyed merge of records: rows that share a service id, a code or an id become one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from concord.operators.components import connected_components


def entities(rows: DataFrame) -> DataFrame:
    """``ord, entity``: rows that share any key, directly or through others, have the smallest ``ord`` among them."""
    keys = F.array(
        F.when(F.col("a_id").isNotNull(), F.concat(F.lit("s:"), "a_id")),
        F.when(F.col("b_id").isNotNull(), F.concat(F.lit("a:"), "b_id")),
        F.when(F.length("code") > 0, F.concat(F.lit("i:"), "code")),
        F.concat(F.lit("d:"), "id"),
    )
    typed = rows.select("ord", F.explode(F.array_compact(keys)).alias("key"))
    first = typed.groupBy("key").agg(F.min("ord").alias("low"))
    # a star for each key: a key that very many rows have costs one edge for each of them
    edges = typed.join(first, "key").where("ord <> low").select("ord", "low").distinct()
    found = connected_components(edges, "ord", "low")
    return rows.select("ord").join(found.withColumnRenamed("node", "ord"), "ord", "left").select("ord", F.coalesce("component", "ord").alias("entity"))


def merged(rows: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One row for each entity: first id, last service ids, title and artist, first album, code, seconds and flag, all services.

    Empty strings count as missing. Rows that bridge two entities join them. ``groups`` are the ``entities`` of the rows, if they are known.
    """
    filled = lambda c: F.when(F.length(c) > 0, F.col(c))
    first = lambda c, v=None: F.min_by(v if v is not None else F.col(c), F.when((v if v is not None else F.col(c)).isNotNull(), F.col("ord"))).alias(c)
    last = lambda c, v=None: F.max_by(v if v is not None else F.col(c), F.when((v if v is not None else F.col(c)).isNotNull(), F.col("ord"))).alias(c)
    return rows.join(entities(rows) if groups is None else groups, "ord").groupBy("entity").agg(
        F.min("ord").alias("ord"), first("id"), last("title", filled("title")), last("artist", filled("artist")),
        first("album", filled("album")), first("code", filled("code")), first("seconds"), first("explicit"),
        last("a_id"), last("b_id"), F.bit_or("availability").alias("availability"), F.count("*").alias("merged"),
    ).drop("entity")


def renamed_ids(rows: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``old_id, id``: what the ids of all rows have become, so that memberships can follow. ``groups`` as for ``merged``."""
    own = rows.join(entities(rows) if groups is None else groups, "ord")
    kept = own.groupBy("entity").agg(F.min_by("id", "ord").alias("new"))
    return own.join(kept, "entity").select(F.col("id").alias("old_id"), F.col("new").alias("id")).distinct()


def follow(members: DataFrame, renames: DataFrame, column: str = "track_id") -> DataFrame:
    """Memberships with the ids that their records have now."""
    r = renames.select(F.col("old_id").alias(column), F.col("id").alias("__new"))
    return members.join(r, column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")
