"""The test tables in the roles of catalogue tables. Every adapter covers its whole table."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from concord.session import table


def parts(spark: SparkSession, sf_dir: str, codes: bool = False) -> DataFrame:
    """Parts as records: odd keys are on service a, even ones on service b."""
    p, odd = table(spark, sf_dir, "part"), F.col("p_partkey") % 2 == 1
    sid = F.concat(F.lit("x"), F.col("p_partkey").cast("string"))
    code = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.when(odd, "us").otherwise("US"), F.lpad((F.floor(F.col("p_partkey") / 2) % 700).cast("string"), 10, "0"))) if codes else F.lit(None).cast("string")
    return p.select(
        F.col("p_partkey").alias("ord"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("title"), F.col("p_name").alias("artist"), F.col("p_type").alias("album"),
        code.alias("code"), F.col("p_size").cast("long").alias("seconds"), F.lit(None).cast("boolean").alias("explicit"),
        F.when(odd, sid).alias("a_id"), F.when(~odd, sid).alias("b_id"), F.when(odd, 1).otherwise(2).alias("availability"),
    )


def overrides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Mappings for one part in 7, skips for one in 11, rejects of the next part for one in 3."""
    k = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).where("k % 2 = 1")
    name = lambda c: F.concat(F.lit("p"), F.expr(c).cast("string"))
    m = k.where("k % 7 = 0").select(F.lit("a").alias("source_service"), F.concat(F.lit("x"), F.col("k").cast("string")).alias("source_track_id"), F.lit("b").alias("target_service"), name("k + 1").alias("target_track_id"), F.when(F.col("k") % 2 == 1, F.when(F.col("k") % 3 == 0, 0.99)).alias("confidence"))
    kinds = k.select(name("k").alias("track_id"), F.lit("b").alias("target_service"), F.explode(F.array_compact(F.array(
        F.when(F.expr("k % 11 = 0"), F.struct(F.lit("skip").alias("kind"), F.lit("").alias("candidate_id"))),
        F.when(F.expr("k % 3 = 0"), F.struct(F.lit("reject").alias("kind"), name("k - 1").alias("candidate_id"))),
    ))).alias("x")).select("track_id", "target_service", "x.*")
    return m, kinds


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, and suppliers twice, as rows that share service ids, codes and ids in groups."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"), F.col("c_acctbal").alias("bal"), F.lit(0).alias("kind"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("n"), F.col("s_acctbal").alias("bal"))
    rows = c.unionByName(s.withColumn("kind", F.lit(1))).unionByName(s.withColumn("kind", F.lit(2)))
    text = lambda p, e: F.concat(F.lit(p), F.expr(e).cast("string"))
    return rows.select(
        (F.col("k") * 3 + F.col("kind")).alias("ord"), F.concat(F.lit("r"), (F.col("k") * 3 + F.col("kind")).cast("string")).alias("id"), F.col("n").alias("title"),
        F.when(F.col("k") % 4 == 0, "").otherwise(F.col("n")).alias("artist"), F.when(F.col("k") % 5 > 1, F.col("n")).otherwise("").alias("album"),
        F.when(F.col("k") % 2 == 0, text("C", "k div 2")).alias("code"), F.when(F.col("k") % 3 == 0, F.floor("bal")).alias("seconds"), F.lit(None).cast("boolean").alias("explicit"),
        F.when(F.col("kind") < 2, text("s", "k")).alias("a_id"), F.when(F.col("kind") > 0, text("t", "k")).alias("b_id"), F.when(F.col("kind") == 0, 1).when(F.col("kind") == 1, 3).otherwise(2).alias("availability"),
    )


def conversation_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as ordered lists of tracks."""
    return table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("list_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("track_id"), F.col("turn").alias("position"), "role")


def conversation_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All turns as the source's lists; what the target has of them: every third list is unknown, every other of the rest lacks its last role."""
    from concord.operators.stores import lists_with_members

    m = conversation_members(spark, sf_dir)
    k = F.expr("cast(substr(list_id, 2) as bigint)")
    heads = m.select("list_id").distinct().select(F.col("list_id").alias("id"), F.when(k % 3 > 0, F.concat(F.lit("b"), "list_id")).alias("b_id"))
    source = lists_with_members(heads, m.select("list_id", "track_id", "position"))
    theirs = m.where((k % 2 == 0) | (F.col("role") != "assistant"))
    target = lists_with_members(heads.where("b_id is not null"), theirs.select("list_id", "track_id", "position"))
    return source.withColumn("a_id", F.col("id")), target


def event_outcomes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as decisions of runs (users); errors have no score, every seventh user no run. Orders as runs."""
    e = table(spark, sf_dir, "events")
    kinds = {"click": "auto", "view": "ambiguous", "purchase": "no_match"}
    decision = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()], F.lit("skipped"))
    own = e.select(F.when(F.col("user_id") % 7 > 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("run_id"), F.col("ts").alias("recorded_at"), decision.alias("decision"), F.when(F.col("event_type") != "error", F.col("value") / F.lit(500.0)).alias("top_score"))
    runs = e.where("user_id % 2 = 0").groupBy("user_id").agg(F.min("ts").alias("t")).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.col("t").alias("started_at"), F.when(F.col("user_id") % 4 == 0, "completed").otherwise("failed").alias("status"))
    return own, runs


def line_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a checkpoint log: one entry for each order, part and supplier."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_shipdate").alias("t"), F.max("l_returnflag").alias("f"), F.max("l_linenumber").alias("n"))
    key = F.concat(F.lit("update_members:l:"), F.col("l_partkey").cast("string"), F.lit(":d"))
    return li.select(F.concat(F.lit("o"), (F.col("l_orderkey") % 50).cast("string")).alias("run_id"), F.when(F.col("n") > 1, key).otherwise(F.concat(F.lit("add_track:"), F.col("l_partkey").cast("string"))).alias("op_key"), F.when(F.col("f") == "R", "failed").otherwise("done").alias("status"), F.when(F.col("n") > 2, F.concat(F.lit('["m'), F.col("n").cast("string"), F.lit('","z"]'))).alias("previous_track_ids"), F.lit(None).cast("string").alias("error"), F.col("t").cast("timestamp").alias("updated_at"), (F.col("l_orderkey") * 100_000 + F.col("l_partkey")).alias("ord"))


def canonical_parts(spark: SparkSession, sf_dir: str, service: str) -> DataFrame:
    """Parts as raw tracks of a service, as canonical rows. One part in seven has no artist on service a."""
    from concord.sources.pages import canonical

    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    artist = F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand")).alias("artists") if service == "a" else F.col("p_brand").alias("artist")
    raw = p.select(F.concat(F.lit("x"), k.cast("string")).alias("id"), F.col("p_name").alias("name"), artist, F.col("p_type").alias("album"), (F.col("p_size").cast("long") * 1000 + 499).alias("duration_ms"), F.lit(None).cast("boolean").alias("explicit"), F.when(k % 3 == 0, F.concat(F.lit("us"), k.cast("string"))).alias("code"))
    return canonical(raw, service)


# ---- recorded answers of services, made from the test tables

PER_PAGE = 100
#: Entries that one reader follows.
READ_BY_ONE = 50_000


def recorded_tracks(spark: SparkSession, sf_dir: str, service: str) -> tuple[str, int]:
    """Parts as recorded pages of a library: the folder, and how many entries there are. Some entries are null, local or without id."""
    from concord.session import shared_dir
    from concord.sources.requests import CHUNK

    folder = f"{shared_dir(spark)}/recorded-{uuid.uuid4().hex}"
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    id_, code = F.concat(F.lit("x"), k.cast("string")), F.when(k % 3 == 0, F.concat(F.lit("us"), k.cast("string")))
    if service == "a":
        artists = F.array(F.struct(F.col("p_brand").alias("name")))
        track = F.struct(
            F.when(k % 17 > 0, id_).alias("id"), F.col("p_name").alias("name"), artists.alias("artists"), F.struct(F.col("p_type").alias("name")).alias("album"), (F.col("p_size").cast("long") * 1000 + 499).alias("duration_ms"),
            (k % 2 == 0).alias("explicit"), F.when(code.isNotNull(), F.create_map(F.lit("isrc"), code)).alias("external_ids"), (k % 13 == 0).alias("is_local"),
        )
        item, items = F.struct(F.when(k % 11 > 0, track).alias("track")), "items"
    else:
        about = F.struct(
            F.col("p_name").alias("name"), F.col("p_brand").alias("artistName"), F.col("p_type").alias("albumName"), (F.col("p_size").cast("long") * 1000 + 500).alias("durationInMillis"),
            F.when(k % 3 == 0, "explicit").when(k % 3 == 1, "clean").alias("contentRating"), code.alias("isrc"), F.when(k % 5 == 0, F.struct(F.concat(F.lit("c"), k.cast("string")).alias("catalogId"))).alias("playParams"),
        )
        item, items = F.struct(F.when(k % 17 > 0, id_).alias("id"), about.alias("attributes")), "data"
    total = p.agg(F.max("p_partkey")).first()[0] or 0
    page = F.floor((k - 1) / PER_PAGE).cast("long")
    rows = p.select(page.alias("page"), k.alias("k"), item.alias("item")).groupBy("page").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", F.to_json("item").alias("j")))), lambda x: x["j"]).alias("j"))
    link = F.concat(F.lit(f"recorded://service/t?folder={quote(folder)}&limit={PER_PAGE}&offset=") if service == "a" else F.lit(f"/t?folder={quote(folder)}&limit={PER_PAGE}&offset="), ((F.col("page") + 1) * PER_PAGE).cast("string"))
    after = F.when((F.col("page") + 1) * PER_PAGE < total, F.concat(F.lit('"'), link, F.lit('"'))).otherwise("null")
    value = F.concat(F.lit(f'{{"{items}":['), F.concat_ws(",", "j"), F.lit('],"next":'), after, F.lit("}"))
    lines = rows.select(F.floor(F.col("page") / CHUNK).cast("int").alias("chunk"), "page", value.alias("value"))
    lines.repartition("chunk").sortWithinPartitions("chunk", "page").select("chunk", "value").write.partitionBy("chunk").text(folder)
    return folder, total


def recorded_catalogue(spark: SparkSession, sf_dir: str, chunks: int = 16) -> str:
    """Searches of service b for the texts ``brand name`` of parts, recorded: up to five parts each, by key. The folder."""
    from concord.session import shared_dir

    folder = f"{shared_dir(spark)}/recorded-{uuid.uuid4().hex}"
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    about = F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("artistName"), F.when(k % 2 == 0, "explicit").alias("contentRating"))
    one = p.select(F.concat_ws(" ", "p_name", "p_brand").alias("q"), k.alias("k"), F.to_json(F.struct(F.concat(F.lit("c"), k.cast("string")).alias("id"), about.alias("attributes"))).alias("j"))
    rank = F.row_number().over(W.partitionBy("q").orderBy("k"))
    five = one.withColumn("n", rank).where("n <= 5").groupBy("q").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "j"))), lambda x: x["j"]).alias("j"))
    value = F.concat(F.col("q"), F.lit("\t"), F.lit('{"results":{"songs":{"data":['), F.concat_ws(",", "j"), F.lit("]}}}"))
    lines = five.select((F.crc32(F.col("q").cast("binary")) % chunks).cast("int").alias("chunk"), value.alias("value"))
    lines.repartition("chunk").write.partitionBy("chunk").text(folder)
    return folder
