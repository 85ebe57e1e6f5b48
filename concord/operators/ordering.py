"""Global places of rows without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from concord.session import discard, stored


def numbered(rows: DataFrame, *order: str | Column, name: str = "n") -> tuple[DataFrame, int]:
    """Rows with their place, from 0, in an order, stored; and how many there are.

    Rows are dealt out by ranges of the order and numbered inside them; the ranges' sizes, one row for each, are added up on the driver.
    """
    spark = rows.sparkSession
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = stored(rows.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = sorted(map(tuple, ranged.groupBy("__part").agg(F.count("*")).collect()))
    base, total = [], 0
    for part, n in sizes:
        base.append((part, total))
        total += n
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*by)) - 1
    before = F.broadcast(spark.createDataFrame(base, "__part int, __base long"))
    out = ranged.withColumn(name, inside.cast("long")).join(before, "__part").withColumn(name, F.col(name) + F.col("__base")).drop("__part", "__base")
    out = stored(out, "numbered")
    discard(ranged)
    return out, total
