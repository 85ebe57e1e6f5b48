import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from concord import schema as S
from concord.operators import syncing
from concord.sources import pages, sinks
from concord.streaming.incremental import synchronise


def page(spark, value, schema):
    return pages.parsed(spark.createDataFrame([(json.dumps(value),)], "value string"), schema)


def test_tracks_a(spark):
    t = lambda i, **kw: {"track": {"id": i, "name": "N", "artists": [{"name": "A"}, {"name": "B"}], "album": {"name": "L"}, "duration_ms": 215999, "explicit": True, "external_ids": {"isrc": "us1"}, "is_local": False} | kw}
    p = page(spark, {"items": [t("t1"), {"track": None}, t(None), t("t2", artists=[], external_ids={}), t("loc", is_local=True)], "next": None}, S.PAGE_A)
    got = pages.canonical(pages.tracks_a(p), "a").orderBy("a_id").collect()
    assert [r.a_id for r in got] == ["t1", "t2"]
    assert (got[0].id, got[0].artist, got[0].seconds, got[0].availability) == ("isrc:US1", "A", 216, 1)
    assert got[1].artist == "Unknown Artist"


def test_tracks_b(spark):
    s = lambda i, **kw: {"id": i, "attributes": {"name": "N", "artistName": "A", "durationInMillis": 1000} | kw}
    songs = [s("i.1", playParams={"catalogId": "111"}, contentRating="explicit"), s("i.2")]
    got = pages.tracks_b(page(spark, {"data": songs}, S.PAGE_B)).collect()
    assert [(r.id, r.explicit) for r in got] == [("111", True), ("i.2", None)]
    found = pages.search_b(page(spark, {"results": {"songs": {"data": songs}}}, S.SEARCH_B)).collect()
    assert [r.explicit for r in found] == [True, False]


def test_lists(spark):
    a = pages.lists_a(page(spark, {"items": [{"id": "l", "name": "n", "description": "", "owner": {"id": "o"}}]}, S.LIST_PAGE_A)).first()
    assert (a.description, a.owner) == (None, "o")
    b = pages.canonical_lists(pages.lists_b(page(spark, {"data": [{"id": "p.1", "attributes": {"name": "n"}}]}, S.LIST_PAGE_B)), "b").first()
    assert (b.id, b.b_id) == ("apple:p.1", "p.1")


def test_limits():
    assert [pages.clamp_limit(n, s) for n, s in ((0, "a"), (99, "a"), (99, "b"))] == [1, 50, 25]


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([('a,b "q"', None, 0.5), ("x", "y", 1 / 3)], "n string, m string, v double").withColumn("v", sinks.six_digits("v"))
    sinks.write_csv(df, str(tmp_path / "r"))
    rows = list(csv.reader(open(glob.glob(f"{tmp_path}/r/part*")[0])))
    assert rows == [["n", "m", "v"], ['a,b "q"', "", "0.5"], ["x", "y", "0.333333"]]
    sinks.write_csv(df.limit(0), str(tmp_path / "e"))
    assert open(glob.glob(f"{tmp_path}/e/part*")[0]).read().strip() == "n,m,v"
    assert sinks.histogram_path("out/report.csv") == "out/report.histogram.csv"


@pytest.mark.parametrize("after, delay, want", [(2, 0.5, 2), (0.1, 0.5, 0.5), (9999, 1, 300), (None, 1.5, 1.5)])
def test_retry_delay(after, delay, want):
    assert sinks.retry_delay(delay, after) == want


def test_token_bucket():
    now = [0.0]
    b = sinks.TokenBucket(2.0, lambda: now[0])
    assert b.capacity == 20 and b.wait_time(20) == 0.0 and b.wait_time() == 0.5
    now[0] = 0.5
    assert b.wait_time() == 0.0


def test_send_records_outcomes(spark):
    def effect(op):
        if op["op_key"] == "bad":
            raise ValueError("no")

    got = {r.op_key: (r.status, r.error) for r in sinks.send(spark.createDataFrame([("ok",), ("bad",)], "op_key string"), effect, rate=100.0, parallel=2).collect()}
    assert got == {"ok": ("done", None), "bad": ("failed", "no")}


OPS = "op string, service string, entity_id string, members array<string>, op_key string, ord long"


def test_stream_passes_changes_once(spark, tmp_path):
    seen = []
    run = lambda apply: synchronise(spark.readStream.schema(OPS).json(str(tmp_path / "in")), apply, str(tmp_path / "cp"))
    put = lambda *rows: spark.createDataFrame(list(rows), OPS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    keep = lambda ops, n: seen.append(sorted((r.op, r.entity_id, tuple(r.members or ()), r.op_key) for r in ops.collect()))

    def step(*rows):
        put(*rows)
        q = run(keep)
        q.awaitTermination()
        return q

    update = lambda e, m, key, ord_=0: ("update_members", "b", e, m, key, ord_)
    step(update("l", ["x"], "k0"), *(update(f"o{i}", ["m"], f"o{i}") for i in range(40)), ("add_track", "b", "t", None, "t", 0))
    step(update("l", ["x"], "k1"), ("add_track", "b", "t", None, "t", 0))
    q = step(update("l", ["x", "y"], "k3", 2), update("l", ["z"], "k2", 1), ("create_list", "b", "l", ["x", "y", "z"], "create_list:b-l", 3), ("create_list", "b", "new", [], "create_list:b-new", 0))
    assert len(seen[0]) == 42 and seen[1] == [("add_track", "t", (), "t")]
    ops = [(op, e, m) for op, e, m, _ in seen[2]]
    assert ops == [("create_list", "new", ()), ("update_members", "l", ("x", "y")), ("update_members", "l", ("x", "y", "z")), ("update_members", "l", ("z",))]
    assert seen[2][2][3].startswith("update_members:b-l:") and seen[2][0][3] == "create_list:b-new"
    state = q.lastProgress["stateOperators"][0]
    assert (state["numRowsUpdated"], state["numRowsTotal"]) == (2, 42)  # two of 42 lists are touched

    def fails(ops, n):
        raise RuntimeError("the service is gone")

    put(update("o1", ["q"], "o1q"))
    with pytest.raises(Exception, match="gone"):
        run(fails).awaitTermination()
    run(keep).awaitTermination()  # the batch comes again, from the state before it
    assert seen[3] == [("update_members", "o1", ("q",), "o1q")]
