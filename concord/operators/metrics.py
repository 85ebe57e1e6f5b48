"""Quality metrics of runs: decision counts, dense histograms, nearest-rank timers, error tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from concord.session import stored


def run_metrics(outcomes: DataFrame, runs: DataFrame) -> DataFrame:
    """One row for each run or group of outcomes; outcomes without a run are ``(none)``."""
    own = outcomes.withColumn("run_id", F.coalesce("run_id", F.lit("(none)"))).groupBy("run_id").agg(
        F.count("*").alias("matches"), *(F.count_if(F.col("decision") == d).alias(d) for d in ("auto", "ambiguous", "no_match")),
        F.avg("top_score").alias("mean_score"), F.min("recorded_at").alias("first_at"),
    )
    r = runs.select(F.col("id").alias("run_id"), "started_at", F.col("status").alias("run_status"))
    both = own.join(r, "run_id", "full_outer")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("matches", "auto", "ambiguous", "no_match")}
    status = F.coalesce("run_status", F.when(F.col("run_id") == "(none)", "unassigned").otherwise("dry_run"))
    both = both.withColumns(zero | {"status": status, "start": F.coalesce("started_at", "first_at")})
    rate = F.when(F.col("matches") > 0, F.col("auto") / F.col("matches"))
    return both.select("run_id", "status", "start", "matches", "auto", "ambiguous", "no_match", "mean_score", rate.alias("auto_rate")).orderBy(F.asc_nulls_last("start"), "run_id")


def confidence_histogram(outcomes: DataFrame, buckets: int = 10) -> DataFrame:
    """Every bucket of each (run, decision) that has scores, empty ones too."""
    own = outcomes.where("top_score is not null").withColumn("run_id", F.coalesce("run_id", F.lit("(none)")))
    place = F.least(F.greatest((F.col("top_score") * buckets).cast("long"), F.lit(0)), F.lit(buckets - 1)).cast("long")
    n = own.groupBy("run_id", "decision", place.alias("bucket")).agg(F.count("*").alias("n"))
    # the empty buckets come from the counted ones; the outcomes are read once
    one = n.groupBy("run_id", "decision").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"))
    all_ = one.select("run_id", "decision", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"))
    return all_.select("run_id", "decision", "bucket", F.coalesce(F.try_element_at("m", "bucket"), F.lit(0)).alias("n")).orderBy("run_id", "decision", "bucket")


#: Places of the nearest-rank quantiles, from 0, among ``n`` values in order.
RANKS = {"p50": "n div 2", "p95": "CAST(n * 0.95D AS BIGINT)", "p99": "CAST(n * 0.99D AS BIGINT)"}


def timer_statistics(samples: DataFrame, by: str = "name", value: str = "value", cells: int = 4096, few: int = 100_000) -> DataFrame:
    """Count, mean, extremes and nearest-rank quantiles of each name: the value at place ``int(n * q)`` from 0 in order.

    Null names, nulls and values that are no numbers are left out. Values are never sorted by name: they are counted in ``cells`` ranges between the
    bounds of a name, the ranges that hold the wanted places are counted again more finely, and only when they have at most ``few`` values each are those
    put in order. Counts are summed before they move, so a name that all rows have is worked on by all tasks.
    """
    rows = samples.select(F.col(by).alias("name"), F.col(value).cast("double").alias("v")).where("name IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)")
    whole = stored(rows.groupBy("name").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max")), "timers")
    places = F.expr("stack(3, " + ", ".join(f"'{q}', {x}" for q, x in RANKS.items()) + ") AS (q, place)")
    wanted = whole.select("name", "n", "min", "max").select("name", places, F.col("min").alias("low"), F.col("max").alias("high"), "n")
    wanted, width = stored(wanted, "places"), F.col("high") - F.col("low")
    ranges = ["name", "low", "high"]
    inside = lambda: rows.join(wanted.where("low < high").select(*ranges).distinct(), "name").where("v >= low AND v <= high")
    for _ in range(8):  # each round has ranges some thousands of times finer
        if wanted.where((F.col("low") < F.col("high")) & (F.col("n") > few)).isEmpty():
            break
        cell = F.least(F.floor((F.col("v") - F.col("low")) / width * cells), F.lit(cells - 1))
        n = inside().groupBy(*ranges, cell.alias("cell")).agg(F.count("*").alias("k"), F.min("v").alias("a"), F.max("v").alias("b"))
        before = F.sum("k").over(W.partitionBy(*ranges).orderBy("cell")) - F.col("k")  # over at most ``cells`` counts
        finer = wanted.where("low < high").drop("n").join(n.withColumn("before", before), ranges).where("place >= before AND place < before + k")
        finer = finer.select("name", "q", (F.col("place") - F.col("before")).alias("place"), F.col("a").alias("low"), F.col("b").alias("high"), F.col("k").alias("n"))
        wanted = stored(finer.unionByName(wanted.where("low >= high")), "places")
    each = inside().groupBy(*ranges, "v").agg(F.count("*").alias("k"))
    before = F.sum("k").over(W.partitionBy(*ranges).orderBy("v")) - F.col("k")
    found = wanted.where("low < high").join(each.withColumn("before", before), ranges).where("place >= before AND place < before + k").select("name", "q", "v")
    found = found.unionByName(wanted.where("low >= high").select("name", "q", F.col("low").alias("v")))
    one = found.groupBy("name").agg(*(F.max(F.when(F.col("q") == q, F.col("v"))).alias(q) for q in RANKS))
    return whole.join(one, "name").select(F.col("name").alias(by), F.col("n").alias("count"), "mean", "min", "max", *RANKS)


def error_top(errors: DataFrame, n: int = 5) -> DataFrame:
    """The most frequent kinds, ties by name."""
    return errors.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(n)


def recent_errors(errors: DataFrame, n: int = 100) -> DataFrame:
    return errors.orderBy(F.desc("ts"), F.desc("ord")).limit(n)


def collected(metrics: DataFrame) -> DataFrame:
    """Counters summed and gauges at their last value: rows ``kind, name, value, ts``."""
    return metrics.groupBy("kind", "name").agg(F.when(F.col("kind") == "counter", F.sum("value")).otherwise(F.max_by("value", "ts")).alias("value")).orderBy("kind", "name")


def library_summary(records: DataFrame) -> DataFrame:
    a, b = F.col("availability").bitwiseAND(1) != 0, F.col("availability").bitwiseAND(2) != 0
    out = records.agg(F.count("*").alias("total"), F.count_if(a).alias("on_a"), F.count_if(b).alias("on_b"), F.count_if(a & b).alias("on_both"))
    return out


def evaluation(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of 0/1 predictions; null where undefined."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    c = pairs.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    over = lambda a, b: F.when(b > 0, a / b)
    return c.withColumns({"precision": over(F.col("tp"), F.col("tp") + F.col("fp")), "recall": over(F.col("tp"), F.col("tp") + F.col("fn")), "f1": over(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def evaluation_curve(pairs: DataFrame, category: str, score: str, truth: str, buckets: int = 100) -> DataFrame:
    """``category, threshold, tp, fp, fn, precision, recall, f1`` at every threshold ``i / buckets``, for each category and, with a null category, for all.

    A pair is predicted if its score reaches the threshold; pairs without a score never are. A null category is ``(none)``. Pairs are counted once, into
    buckets of the score; categories are rolled up and thresholds added up over these counts. Undefined rates are null.
    """
    place = F.least(F.greatest(F.floor(F.col(score) * buckets), F.lit(0)), F.lit(buckets)).cast("long")
    own = pairs.select(F.coalesce(F.col(category).cast("string"), F.lit("(none)")).alias("category"), F.when(F.col(score).isNotNull(), place).otherwise(-1).alias("bucket"), F.coalesce(F.col(truth).cast("boolean"), F.lit(False)).alias("truth"))
    n = own.groupBy("category", "bucket").agg(F.count_if("truth").alias("yes"), F.count_if(~F.col("truth")).alias("no"))
    n = n.withColumnRenamed("category", "kind").groupingSets([["bucket"], ["kind", "bucket"]], "kind", "bucket").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    one = n.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("yes", "no")))).alias("m"), F.sum("yes").alias("all"))
    every = one.select("kind", "all", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets).cast("long"))).alias("bucket"))
    every = every.select("kind", "all", "bucket", F.coalesce(F.try_element_at("m", "bucket")["yes"], F.lit(0)).alias("yes"), F.coalesce(F.try_element_at("m", "bucket")["no"], F.lit(0)).alias("no"))
    down = W.partitionBy("kind").orderBy(F.desc("bucket"))  # over one row a threshold
    t = every.select(F.col("kind").alias("category"), (F.col("bucket") / buckets).alias("threshold"), F.sum("yes").over(down).alias("tp"), F.sum("no").over(down).alias("fp"), (F.col("all") - F.sum("yes").over(down)).alias("fn"))
    over = lambda a, b: F.when(b > 0, a / b)
    return t.withColumns({"precision": over(F.col("tp"), F.col("tp") + F.col("fp")), "recall": over(F.col("tp"), F.col("tp") + F.col("fn")), "f1": over(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def library_stats(records: DataFrame) -> DataFrame:
    """Counts by service as a summary shows them: ``both`` is the lesser of the two, an upper bound."""
    return library_summary(records).select("total", "on_a", "on_b", F.least("on_a", "on_b").alias("both"))


def error_summary(errors: DataFrame, now) -> DataFrame:
    """``total, kinds, last_hour`` of errors ``kind, ts``."""
    recent = F.col("ts") >= F.lit(now).cast("timestamp") - F.expr("INTERVAL 1 HOUR")
    return errors.agg(F.count("*").alias("total"), F.count_distinct("kind").alias("kinds"), F.count_if(recent).alias("last_hour"))
