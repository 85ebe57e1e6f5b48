"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from concord.session import discard, stored


def contracted(edges: DataFrame, parts: int) -> DataFrame:
    """``node, low`` for the nodes of each of so many shares of the edges: the smallest node connected within the share."""
    kind = edges.schema["a"].dataType
    schema = StructType([StructField("node", kind), StructField("low", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        types = None
        for b in batches:
            types = b.schema.field(0).type
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parent.setdefault(x, x)
                parent.setdefault(y, y)
                x, y = sorted((root(x), root(y)))
                parent[y] = x
        if parent:
            yield pa.RecordBatch.from_arrays([pa.array(list(parent), types), pa.array([root(x) for x in parent], types)], ["node", "low"])

    return edges.select("a", "b").coalesce(parts).mapInArrow(run, schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", share: int = 500_000, limit: int = 200) -> DataFrame:
    """``node, component``: every node that has an edge, and the smallest node of its component.

    Tasks first contract shares of about ``share`` edges each. If there is more than one, rounds of minimum-label propagation with pointer
    jumping follow, so that long chains take a logarithmic number of rounds. Only nodes and labels move, and all
    joins are equi-joins that Spark can split.
    """
    own = stored(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(F.col("a") != F.col("b")), "edges")
    parts = max(1, -(-own.count() // share))
    near = stored(contracted(own, parts), "contracted")
    discard(own)
    if parts == 1:
        return near.withColumnRenamed("low", "component")
    star = near.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    both = stored(star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    before = labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    discard(near)
    for _ in range(limit):
        close = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        seen = labels.join(close, F.col("node") == F.col("a"), "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        moved = seen.join(jump, F.col("low") == F.col("via"), "left").select("node", "component", F.least("low", F.coalesce("far", "low")).alias("next"))
        after = stored(moved, "labels")
        changed = after.where("next != component").limit(1).count()
        discard(before)
        before, labels = after, after.select("node", F.col("next").alias("component"))
        if not changed:
            discard(both)
            return labels
    raise RuntimeError(f"components did not settle in {limit} rounds")
