"""Records and lists from the services' JSON pages, and their projection to canonical rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from concord import schema as S
from concord.functions.ids import list_id, record_id, whole_seconds


def read_pages(spark: SparkSession, path: str, page: str) -> DataFrame:
    """Pages saved as JSON files, one page in each file or line."""
    return spark.read.schema(page).option("multiLine", True).json(path)


def parsed(pages: DataFrame, page: str, column: str = "value") -> DataFrame:
    """Pages held as text; what does not parse becomes nulls."""
    return pages.select(F.from_json(column, page).alias("p")).select("p.*")


def tracks_a(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Tracks of service a; those that are null, local or without id are left out. Columns to ``keep`` stay with each."""
    t = pages.select(*(keep or []), F.explode("items").alias("i")).select(*(keep or []), "i.track.*")
    own = t.where(F.col("id").isNotNull() & ~F.coalesce("is_local", F.lit(False)))
    return own.selectExpr(*(keep or []), "id", "name", "transform(artists, x -> x.name) AS artists", "album.name AS album", "duration_ms", "explicit", "try_element_at(external_ids, 'isrc') AS code")


def search_a(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return tracks_a(pages.select(*(keep or []), F.transform("tracks.items", lambda t: F.struct(t.alias("track"))).alias("items")), keep)


def tracks_b(pages: DataFrame, rating_missing: bool | None = None, keep: list[str] | None = None) -> DataFrame:
    """Tracks of service b under their catalogue id if they have one. ``rating_missing`` is what no rating means."""
    rows = pages.select(*(keep or []), F.explode("data").alias("d")).select(*(keep or []), "d.id", "d.attributes.*")
    rating = F.when(F.col("contentRating").isNotNull(), F.col("contentRating") == "explicit").otherwise(F.lit(rating_missing).cast("boolean"))
    return rows.where("id is not null").select(*(keep or []), F.coalesce("playParams.catalogId", "id").alias("id"), "name", F.col("artistName").alias("artist"), F.col("albumName").alias("album"), F.col("durationInMillis").alias("duration_ms"), rating.alias("explicit"), F.col("isrc").alias("code"))


def search_b(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return tracks_b(pages.select(*(keep or []), F.col("results.songs.data").alias("data")), rating_missing=False, keep=keep)


def track_type(service: str) -> str:
    """The type of a raw track."""
    artist = "artists:array<string>" if service == "a" else "artist:string"
    return f"struct<id:string,name:string,{artist},album:string,duration_ms:bigint,explicit:boolean,code:string>"


def list_members(pages: DataFrame, service: str) -> DataFrame:
    """``request, tracks``: the raw tracks of each request's pages, in order. A track that a list has twice stays twice."""
    page, items = (S.PAGE_A, "items") if service == "a" else (S.PAGE_B, "data")
    rows = pages.select("request", "page", F.posexplode(F.from_json("value", page)[items]).alias("place", "x"))
    # one item a row goes through the same decoding as a page of them
    one = rows.withColumn(items, F.array("x")).drop("x")
    keep = ["request", "page", "place"]
    own = tracks_a(one, keep) if service == "a" else tracks_b(one, keep=keep)
    ordered = F.sort_array(F.collect_list(F.struct("page", "place", F.struct(*own.columns[3:]).alias("t"))))
    return own.groupBy("request").agg(F.transform(ordered, lambda x: x["t"]).alias("tracks"))


def canonical_list_tracks(lists: DataFrame, service: str) -> tuple[DataFrame, DataFrame]:
    """Canonical lists with ``track_ids`` in order, and the canonical rows of all their tracks, repeated ones too."""
    rows = lists.select(F.col("id").alias("list"), F.posexplode("tracks").alias("place", "t")).select("list", "place", "t.*")
    own = canonical(rows, service, ["list", "place"])
    ids = own.groupBy("list").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("track_ids"))
    heads = canonical_lists(lists, service).withColumn("list", F.coalesce("a_id", "b_id"))
    both = heads.join(ids, "list", "left").withColumn("track_ids", F.coalesce("track_ids", F.array().cast("array<string>"))).drop("list")
    return both, own.drop("list", "place")


def lists_a(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.explode("items").alias("i")).select("i.*").where("id is not null")
    blank = F.when(F.length("description") > 0, F.col("description"))
    return rows.select("id", "name", blank.alias("description"), F.coalesce("owner.display_name", "owner.id").alias("owner"))


def lists_b(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.explode("data").alias("d")).select("d.id", "d.attributes.*").where("id is not null")
    text = F.col("description.standard")
    return rows.select("id", "name", F.when(F.length(text) > 0, text).alias("description"), F.lit(None).cast("string").alias("owner"))


def canonical(tracks: DataFrame, service: str, keep: list[str] | None = None) -> DataFrame:
    """Canonical rows of raw tracks, without ``ord``: first artist, whole seconds, id from code or description."""
    many = "artists" in tracks.columns
    artist = F.coalesce(F.try_element_at("artists", F.lit(1)), F.lit("Unknown Artist")) if many else F.col("artist")
    seconds = whole_seconds(F.col("duration_ms"))
    none = F.lit(None).cast("string")
    return tracks.select(
        *(keep or []), record_id(F.col("name"), artist, F.col("album"), seconds, F.col("code")).alias("id"), F.col("name").alias("title"), artist.alias("artist"),
        "album", "code", seconds.alias("seconds"), "explicit",
        (F.col("id") if service == "a" else none).alias("a_id"), (F.col("id") if service == "b" else none).alias("b_id"),
        F.lit(1 if service == "a" else 2).alias("availability"),
    )


def canonical_lists(lists: DataFrame, service: str) -> DataFrame:
    """Canonical headers; ids of lists of service b are theirs with a prefix (a fixed value, so that ids agree)."""
    none = F.lit(None).cast("string")
    own = list_id(F.col("owner"), F.col("name")) if service == "a" else F.concat(F.lit("apple:"), "id")
    return lists.select(own.alias("id"), "name", "owner", "description", (F.col("id") if service == "a" else none).alias("a_id"), (F.col("id") if service == "b" else none).alias("b_id"))


def clamp_limit(limit: int, service: str) -> int:
    """What a search may ask for: 1 to 50 on service a, 1 to 25 on service b."""
    return max(1, min(limit, 50 if service == "a" else 25))
