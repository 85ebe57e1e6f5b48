"""Imports from services into a library, and reports."""

import csv
import glob

import pytest
from test_services import FAST, Service, song_b, track_a

from concord.operators import importing, running


@pytest.fixture
def service():
    s = Service()
    yield s
    s.server.shutdown()


def test_import_and_dry_run(spark, service, tmp_path):
    root = f"{service.base}/v1/"
    service.answers = {
        "/v1/me/tracks?limit=50": {"items": [track_a("t1"), track_a("t2", external_ids={}), track_a("t1")], "next": None},
        "/v1/me/playlists?limit=50": {"items": [{"id": "pl1", "name": "Mix", "owner": {"id": "ben"}}], "next": None},
        "/v1/playlists/pl1/tracks?limit=100": {"items": [track_a("t2", external_ids={}), track_a("t3"), track_a("t2", external_ids={})], "next": None},
        "/v1/me/library/songs?limit=100": {"data": [song_b("b1", isrc="ct1"), song_b("b9")]},
        "/v1/me/library/playlists?limit=100": {"data": [{"id": "p.1", "attributes": {"name": "Theirs"}}]},
        "/v1/me/library/playlists/p.1/tracks?limit=100": {"data": [song_b("b1", isrc="ct1")]},
    }
    store = running.library(spark, str(tmp_path / "library"))
    preview = importing.import_service(store, "a", root, dry_run=True, **FAST)
    assert (preview.dry_run, preview.tracks, preview.lists, preview.list_tracks) == (True, 3, 1, 3) and store.read("records").count() == 0
    importing.import_service(store, "a", root, **FAST)
    rows = {r.a_id: r for r in store.read("records").collect()}
    assert set(rows) == {"t1", "t2", "t3"} and {r.availability for r in rows.values()} == {1} and sorted(r.ord for r in rows.values()) == [0, 1, 2]
    lists = store.read("lists").collect()
    assert [(r.name, r.a_id, r.track_ids) for r in lists] == [("Mix", "pl1", [rows["t2"].id, rows["t3"].id, rows["t2"].id])]

    importing.import_service(store, "b", service.base, **FAST)
    importing.import_service(store, "a", root, **FAST)  # again, changes nothing
    now = {r.id: r for r in store.read("records").collect()}
    assert len(now) == 4 and now[rows["t1"].id].availability == 3 and now[rows["t1"].id].b_id == "b1"
    assert {(r.name, tuple(r.track_ids)) for r in store.read("lists").collect()} == {("Mix", (rows["t2"].id, rows["t3"].id, rows["t2"].id)), ("Theirs", (rows["t1"].id,))}
    s = importing.import_summary(store).first()
    assert (s.total, s.on_a, s.on_b, s.on_both, s.lists) == (4, 3, 2, 1, 2)


def test_reports(spark, tmp_path):
    store = running.library(spark, str(tmp_path / "library"))
    read = lambda p: list(csv.reader(open(glob.glob(f"{tmp_path}/{p}/part*")[0])))
    importing.export_metrics(store, str(tmp_path / "empty.csv"))
    assert len(read("empty.csv")) == 1 and read("empty.histogram.csv") == [["run_id", "decision", "bucket", "n"]]
    cols = "run_id string, decision string, top_score double, recorded_at timestamp"
    import datetime

    at = datetime.datetime(2024, 1, 1, 10)
    store.commit("o", {"outcomes": spark.createDataFrame([("r", "auto", 1.0, at), ("r", "ambiguous", 2 / 3, at), (None, "no_match", None, at)], cols)})
    importing.export_metrics(store, str(tmp_path / "report.csv"))
    rows = {r[0]: dict(zip(read("report.csv")[0], r)) for r in read("report.csv")[1:]}
    assert rows["r"]["mean_score"] == "0.833333" and rows["r"]["auto_rate"] == "0.5" and rows["r"]["start"] == "2024-01-01T10:00:00Z" and rows["(none)"]["mean_score"] == ""
    assert ["r", "auto", "9", "1"] in read("report.histogram.csv") and len(read("report.histogram.csv")) == 21


def test_components_are_searched_once(spark, tmp_path, monkeypatch):
    from concord.operators import importing, merging, running
    from concord.sources import pages

    calls, plain = [], merging.connected_components

    def counted(*a, **kw):
        calls.append(a)
        return plain(*a, **kw)

    monkeypatch.setattr(merging, "connected_components", counted)
    store = running.library(spark, f"{tmp_path}/library")
    kind = "id string, name string, artists array<string>, album string, duration_ms long, explicit boolean, code string"
    tracks = spark.createDataFrame([("x1", "One", ["Anna"], "LP", 200_000, None, "us1"), ("x2", "One", ["Anna"], "LP", 200_000, None, "us1"), ("x3", "Two", ["Bert"], "LP", 1000, None, None)], kind)
    none = spark.createDataFrame([], f"id string, name string, description string, owner string, tracks array<{pages.track_type('a')}>")
    importing.imported(store, "a", tracks, none)
    assert store.read("records").count() == 2 and len(calls) == 1
