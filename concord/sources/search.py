"""Catalogue search as a look-up join: distinct texts only, answers kept for a time, requests at a shared rate."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from urllib.parse import urlencode

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from concord import schema as S
from concord.operators.commits import Store
from concord.sources import pages as P
from concord.sources.requests import attempted, get_json, named
from concord.sources.sinks import TokenBucket

ANSWERS = "service string, q string, asked_at double, value string"
FOUND = "q string, asked_at double, value string, error string"


def search_cache(spark: SparkSession, folder: str) -> Store:
    """Answers by service and text."""
    return Store(spark, folder, {"answers": ANSWERS}, {"answers": ["service", "q"]})


def search_url(service: str, base: str, q: str, limit: int, country: str = "us", **more) -> str:
    """The address of a search; its limit is clamped to what the service allows."""
    limit = P.clamp_limit(limit, service)
    if service == "a":
        return f"{base}/search?{urlencode({'q': q, 'type': 'track', 'limit': limit} | more)}"
    return f"{base}/catalog/{country}/search?{urlencode({'term': q, 'types': 'songs', 'limit': limit} | more)}"


def asked(texts: DataFrame, service: str, base: str, transport: str = "concord.sources.requests:http", headers: str | None = None, limit: int = 5, rate: float = 10.0, parallel: int = 5, attempts: int = 3, delay: float = 1.0, country: str = "us", **more) -> DataFrame:
    """``q, asked_at, value, error`` of each distinct text ``q``: one request each. One that fails has an error and no value; the others go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send, credentials, bucket = named(transport), named(headers) if headers else dict, TokenBucket(rate / parallel)
        for b in batches:
            rows = []
            for q in b.column(0).to_pylist():
                url = search_url(service, base, q, limit, country, **more)
                try:
                    rows.append((q, time.time(), attempted(lambda url=url: get_json(url, send, credentials()), attempts, delay, bucket), None))
                except Exception as e:  # noqa: BLE001  recorded, whatever it is
                    rows.append((q, time.time(), None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.float64(), pa.string(), pa.string()))], names=["q", "asked_at", "value", "error"])

    own = texts.select("q").where("length(q) > 0").distinct().repartition(parallel)
    return own.mapInArrow(run, FOUND)


def looked_up(texts: DataFrame, service: str, cache: Store, base: str, ttl: float = 86_400.0, now: float | None = None, limit: int = 5, **options) -> DataFrame:
    """``q`` and the raw tracks that the service finds for each distinct text of ``texts`` (column ``q``), at most ``limit`` each.

    Answers younger than ``ttl`` seconds come from the cache; the other texts are asked, each once, and their answers are stored as one commit
    before anything reads them, so a later run or a repeated task does not ask again. Failures are not stored. Null and empty texts find nothing.
    Without credentials (``headers=""``) nothing is asked and nothing is found.
    """
    now = time.time() if now is None else now
    wanted = texts.select("q").where("length(q) > 0").distinct()
    fresh = lambda: cache.read("answers").where((F.col("service") == service) & (F.col("asked_at") > now - ttl)).select("q", "value")
    if options.get("headers") != "":
        new = asked(wanted.join(fresh(), "q", "left_anti"), service, base, limit=limit, **options).where("value is not null")
        cache.commit(f"answers-{uuid.uuid4().hex}", {"answers": new.select(F.lit(service).alias("service"), "q", F.lit(now).alias("asked_at"), "value")})
    own = wanted.join(fresh(), "q")
    page, tracks = (S.SEARCH_A, P.search_a) if service == "a" else (S.SEARCH_B, P.search_b)
    return tracks(own.select("q", F.from_json("value", page).alias("p")).select("q", "p.*"), ["q"])
