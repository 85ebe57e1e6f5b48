"""Paged services as a Spark data source, ``spark.read.format("concord_pages")``, and as a step over a table of requests.

Both give ``request, page, url, value``: the text of every page, decoded afterwards by JSON expressions in the JVM (module ``pages``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urlencode

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from concord import schema as S
from concord.session import stored
from concord.sources import pages as P
from concord.sources.requests import follow, named
from concord.sources.sinks import TokenBucket

PAGES = "request string, page long, url string, value string"
HTTP = "concord.sources.requests:http"

# The services' first requests.
TRACKS = {"a": "me/tracks?limit=50", "b": "/v1/me/library/songs?limit=100"}
LISTS = {"a": "me/playlists?limit=50", "b": "/v1/me/library/playlists?limit=100"}
MEMBERS = {"a": ("playlists/", "/tracks?limit=100"), "b": ("/v1/me/library/playlists/", "/tracks?limit=100")}


class Requests(InputPartition):
    def __init__(self, firsts: list[str], most: int | None):
        self.firsts, self.most = firsts, most


class PageReader(DataSourceReader):
    """Options: ``requests`` (a JSON list of first requests), ``base`` address, ``transport`` and ``headers`` (``module:function``), ``rate`` a second
    of all readers together, ``attempts``, ``delay``, ``parallel`` readers.

    With ``total`` and ``limit`` the one request is read in ranges of offsets, each by its reader, which ends where the next begins; else each
    request is followed by one reader from its first page to its last.
    """

    def __init__(self, options: dict):
        self.o = {k.lower(): v for k, v in options.items()}
        self.parallel = int(self.o.get("parallel", 5))

    def partitions(self) -> list[Requests]:
        firsts = json.loads(self.o["requests"])
        if "total" in self.o:
            limit = int(self.o["limit"])
            pages = max(1, -(-int(self.o["total"]) // limit))
            most = -(-pages // self.parallel)
            sign = "&" if "?" in firsts[0] else "?"
            return [Requests([f"{firsts[0]}{sign}{urlencode({'offset': i * limit, 'limit': limit})}"], most) for i in range(0, pages, most)]
        shares = [firsts[i :: self.parallel] for i in range(self.parallel)]
        return [Requests(s, None) for s in shares if s]

    def read(self, partition: Requests) -> Iterator[tuple]:
        step = _Follower(self.o, max(1, len(self.partitions())))
        for first in partition.firsts:
            for number, url, text in step.pages(first, partition.most):
                yield first, number, url, text


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "concord_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


class _Follower:
    def __init__(self, o: dict, readers: int):
        self.transport = named(o.get("transport", HTTP))
        self.headers = named(o["headers"]) if o.get("headers") else dict
        self.base = o.get("base")
        self.retries = {"attempts": int(o.get("attempts", 5)), "delay": float(o.get("delay", 1.0)), "bucket": TokenBucket(float(o.get("rate", 10.0)) / readers)}

    def pages(self, first: str, most: int | None = None) -> Iterator[tuple[int, str, str]]:
        return follow(first, self.transport, self.headers, self.base, most, **self.retries)


def read_service(spark: SparkSession, requests: list[str], **options) -> DataFrame:
    """All pages of some first requests, through the data source."""
    spark.dataSource.register(PageSource)
    given = {k: str(v) for k, v in options.items() if v is not None}
    return spark.read.format("concord_pages").options(requests=json.dumps(requests), **given).load()


def fetched(requests: DataFrame, column: str = "request", parallel: int = 5, **options) -> DataFrame:
    """Pages of the requests of a table, which may be many: one each for lists whose members are wanted."""
    o = {k: str(v) for k, v in options.items() if v is not None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = _Follower(o, parallel)
        for b in batches:
            for first in b.column(0).to_pylist():
                for number, url, text in step.pages(first):  # a page at a time
                    yield pa.RecordBatch.from_pylist([{"request": first, "page": number, "url": url, "value": text}])

    return requests.select(column).distinct().repartition(parallel).mapInArrow(run, PAGES)


def total_of(first: str, **options) -> int | None:
    """What a service says that a listing holds in all, if it says so."""
    o = {k: str(v) for k, v in options.items()}
    step = _Follower(o, 1)
    text = next(step.pages(first, 1))[2]
    found = json.loads(text)
    return found.get("total", (found.get("meta") or {}).get("total"))


def landed(raw: DataFrame) -> DataFrame:
    """Pages, stored: what reads them afterwards asks nobody again."""
    return stored(raw, "pages")


def library_tracks(spark: SparkSession, service: str, base: str, **options) -> DataFrame:
    """A library's tracks, as the service has them; a track that is null, local or without id is left out."""
    raw = landed(read_service(spark, [TRACKS[service]], base=base, **options))
    return P.tracks_a(P.parsed(raw, S.PAGE_A)) if service == "a" else P.tracks_b(P.parsed(raw, S.PAGE_B))


def library_lists(spark: SparkSession, service: str, base: str, parallel: int = 5, **options) -> DataFrame:
    """``id, name, description, owner, tracks``: lists with their raw tracks in order; a list without tracks has none.

    The lists' pages are read first, then those of all members, many lists at a time.
    """
    raw = landed(read_service(spark, [LISTS[service]], base=base, parallel=parallel, **options))
    heads = P.lists_a(P.parsed(raw, S.LIST_PAGE_A)) if service == "a" else P.lists_b(P.parsed(raw, S.LIST_PAGE_B))
    before, after = MEMBERS[service]
    heads = heads.withColumn("request", F.concat(F.lit(before), "id", F.lit(after)))
    members = P.list_members(landed(fetched(heads, parallel=parallel, base=base, **options)), service)
    none = F.array().cast(f"array<{P.track_type(service)}>")
    return heads.join(members, "request", "left").drop("request").withColumn("tracks", F.coalesce("tracks", none))
