"""Paged services and catalogue search over a local HTTP server; decisions by hand."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.error import URLError
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from concord import schema as S
from concord.operators import resolution
from concord.sources import paged, pages, requests, search


class Service:
    """Answers by path; every request is kept."""

    def __init__(self):
        self.log, self.answers, self.busy, service = [], {}, {}, self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                service.log.append((self.path, dict(self.headers)))
                left = service.busy.get(self.path, 0)
                if left:
                    service.busy[self.path] = left - 1
                    return self.reply(429, b"busy", {"Retry-After": "0.01"})
                answer = service.answers.get(self.path) or service.answer(self.path)
                return self.reply(200, json.dumps(answer).encode(), {}) if answer is not None else self.reply(404, b"{}", {})

            def reply(self, status, body, headers):
                self.send_response(status)
                for k, v in headers.items():
                    self.send_header(k, v)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.base = f"http://127.0.0.1:{self.server.server_port}"

    def answer(self, path):
        return None

    def asked(self):
        return [p for p, _ in self.log]


@pytest.fixture
def service():
    s = Service()
    yield s
    s.server.shutdown()


FAST = {"delay": 0.001, "rate": 10_000}


def track_a(i, **more):
    return {"track": {"id": i, "name": f"N {i}", "artists": [{"name": "A"}], "album": {"name": "L"}, "duration_ms": 1500, "explicit": False, "external_ids": {"isrc": f"c{i}"}, "is_local": False} | more}


def song_b(i, **more):
    return {"id": i, "attributes": {"name": f"N {i}", "artistName": "A", "durationInMillis": 1500} | more}


def test_pages_of_a_follow_absolute_links(spark, service):
    root = f"{service.base}/v1/me/tracks?limit=50"
    service.answers = {
        "/v1/me/tracks?limit=50": {"items": [track_a("1"), {"track": None}, track_a("2")], "next": f"{root}&offset=50"},
        "/v1/me/tracks?limit=50&offset=50": {"items": [track_a("3", is_local=True), track_a(None)], "next": f"{root}&offset=100"},
        "/v1/me/tracks?limit=50&offset=100": {"items": [track_a("4")], "next": None},
    }
    service.busy = {"/v1/me/tracks?limit=50&offset=50": 1}
    got = paged.library_tracks(spark, "a", f"{service.base}/v1/", headers="concord.sources.fixtures:bearer", **FAST).orderBy("id").collect()
    assert [(r.id, r.artists, r.code) for r in got] == [(i, ["A"], f"c{i}") for i in ("1", "2", "4")]
    assert service.asked() == ["/v1/me/tracks?limit=50", *["/v1/me/tracks?limit=50&offset=50"] * 2, "/v1/me/tracks?limit=50&offset=100"]
    assert all(h["Authorization"] == "Bearer test" for _, h in service.log)


def test_pages_of_b_follow_relative_links(spark, service):
    first = "/v1/me/library/songs?limit=100"
    service.answers = {
        first: {"data": [song_b("i.1", playParams={"catalogId": "111"}, contentRating="explicit")], "next": f"{first}&offset=100"},
        f"{first}&offset=100": {"data": [song_b("i.2")], "next": f"{first}&offset=200"},
        f"{first}&offset=200": {"data": [], "next": None},
    }
    service.busy = {f"{first}&offset=100": 2}
    got = paged.library_tracks(spark, "b", service.base, **FAST).orderBy("id").collect()
    assert [(r.id, r.explicit) for r in got] == [("111", True), ("i.2", None)] and len(service.log) == 5


def test_a_page_that_stays_busy_fails_the_read(spark, service):
    service.answers = {"/x": {"items": []}}
    service.busy = {"/x": 99}
    with pytest.raises(Exception, match="status 429"):
        paged.read_service(spark, ["/x"], base=service.base, attempts=2, **FAST).collect()


def test_ranges_of_offsets_have_readers_of_their_own(spark, service):
    def answer(path):
        q = {k: int(v[0]) for k, v in parse_qs(urlsplit(path).query).items()}
        at, limit = q.get("offset", 0), q["limit"]
        more = f"{service.base}/t?offset={at + limit}&limit={limit}" if at + limit < 95 else None
        return {"items": [track_a(str(i)) for i in range(at, min(95, at + limit))], "next": more, "total": 95}

    service.answer = answer
    assert paged.total_of(f"{service.base}/t?limit=10") == 95
    service.log.clear()
    raw = paged.read_service(spark, ["/t"], base=service.base, total=95, limit=10, parallel=4, **FAST)
    assert raw.rdd.getNumPartitions() == 4
    got = pages.tracks_a(pages.parsed(raw, S.PAGE_A)).collect()
    assert sorted(int(r.id) for r in got) == list(range(95)) and len(service.log) == len(set(service.asked())) == 10


def test_lists_with_members_in_order(spark, service):
    root = f"{service.base}/v1/"
    service.answers = {
        "/v1/me/playlists?limit=50": {"items": [{"id": "l1", "name": "One", "description": "", "owner": {"id": "o"}}, {"id": "l2", "name": "None", "owner": None}], "next": None},
        "/v1/playlists/l1/tracks?limit=100": {"items": [track_a("z"), track_a("a")], "next": f"{root}playlists/l1/tracks?limit=100&offset=100"},
        "/v1/playlists/l1/tracks?limit=100&offset=100": {"items": [track_a("z"), {"track": None}, track_a("b", external_ids={})], "next": None},
        "/v1/playlists/l2/tracks?limit=100": {"items": [], "next": None},
    }
    lists = paged.library_lists(spark, "a", root, **FAST).cache()
    got = {r.id: r for r in lists.collect()}
    assert [t.id for t in got["l1"].tracks] == ["z", "a", "z", "b"] and got["l2"].tracks == [] and got["l1"].description is None
    heads, tracks = pages.canonical_list_tracks(lists, "a")
    ids = {r.name: r.track_ids for r in heads.collect()}
    assert ids["One"][:3] == ["isrc:CZ", "isrc:CA", "isrc:CZ"] and len(ids["One"]) == 4 and ids["None"] == []
    assert set(ids["One"]) == {r.id for r in tracks.collect()} and tracks.count() == 4
    service.answers |= {
        "/v1/me/library/playlists?limit=100": {"data": [{"id": "p.1", "attributes": {"name": "B"}}]},
        "/v1/me/library/playlists/p.1/tracks?limit=100": {"data": [song_b("2"), song_b("1")]},
    }
    b = paged.library_lists(spark, "b", service.base, **FAST).first()
    assert (b.id, [t.id for t in b.tracks]) == ("p.1", ["2", "1"])


def found_a(*ids):
    return {"tracks": {"items": [track_a(i)["track"] for i in ids]}}


def test_each_text_is_asked_once_until_its_answer_is_old(spark, service, tmp_path):
    service.answer = lambda path: None if "fails" in path else found_a(parse_qs(urlsplit(path).query)["q"][0])
    cache = search.search_cache(spark, str(tmp_path / "cache"))
    texts = spark.createDataFrame([("x",), ("y",), ("x",), (None,), ("",), ("fails",)], "q string")
    ask = lambda now, **more: search.looked_up(texts, "a", cache, service.base, ttl=100, now=now, attempts=1, **FAST, **more)
    assert sorted((r.q, r.id) for r in ask(1000.0).collect()) == [("x", "x"), ("y", "y")]
    q = [parse_qs(urlsplit(p).query) for p in service.asked()]
    assert sorted(x["q"][0] for x in q) == ["fails", "x", "y"] and all(x["limit"] == ["5"] and x["type"] == ["track"] for x in q)
    service.log.clear()
    assert ask(1050.0).count() == 2 and ["fails" in p for p in service.asked()] == [True]  # only what has no answer
    service.log.clear()
    assert ask(1101.0).count() == 2 and len(service.log) == 3  # the answers are too old
    service.log.clear()
    assert ask(5000.0, headers="").count() == 0 and not service.log  # without credentials


def test_search_of_b(spark, service, tmp_path):
    service.answer = lambda path: {"results": {"songs": {"data": [song_b("9")]}}} if path.startswith("/catalog/gb/search?term=") else None
    cache = search.search_cache(spark, str(tmp_path / "cache"))
    rows = search.looked_up(spark.createDataFrame([("x y",)], "q string"), "b", cache, service.base, country="gb", limit=99, **FAST).collect()
    assert [(r.q, r.id, r.explicit) for r in rows] == [("x y", "9", False)] and "limit=25" in service.asked()[0]
    service.answer = lambda path: {"results": {}}
    assert search.looked_up(spark.createDataFrame([("none",)], "q string"), "b", cache, service.base, **FAST).count() == 0


def test_searched_records_are_decided_again(spark, service, tmp_path):
    cols = "ord long, id string, title string, artist string, album string, code string, seconds long, explicit boolean, a_id string, b_id string, availability int"
    rows = [(0, "x", "Heroes (Live) [2017 Remaster]", "Bowie", None, None, 200, None, "a1", None, 1), (1, "y", "Other", "Somebody", None, None, 200, None, "a2", None, 1), (2, "z", "Other", "Somebody", None, None, 200, None, None, "b2", 2)]
    records = spark.createDataFrame(rows, cols)
    service.answer = lambda path: {"results": {"songs": {"data": [song_b("77", name="Heroes Live 2017 Remaster", artistName="Bowie", durationInMillis=200_000)]}}}
    cache = search.search_cache(spark, str(tmp_path / "cache"))
    look_up = lambda q: search.looked_up(q, "b", cache, service.base, **FAST)
    decisions, every = resolution.searched(records, "a", "b", look_up)
    got = {r.source_id: r.decision for r in decisions.collect()}
    assert got == {"x": "auto", "y": "auto"} and every.where("b_id = '77'").count() == 1 and every.count() == 4
    assert [parse_qs(urlsplit(p).query)["term"] for p in service.asked()] == [["Heroes Bowie"]]  # only what had no match


def test_decisions_by_hand(spark):
    none = spark.createDataFrame([], S.EXCLUSIONS)
    t = spark.createDataFrame([("x", "a1"), ("y", "a2"), ("x", "a1")], "track_id string, source_track_id string")
    e = resolution.skip(none, t, "b")
    e = resolution.skip(e, t, "b")  # again changes nothing
    e = resolution.reject(e, spark.createDataFrame([("x", "c"), ("x", "c"), ("z", "d")], "track_id string, candidate_id string"), "b")
    assert sorted(map(tuple, e.collect())) == [("x", "b", "reject", "c"), ("x", "b", "skip", ""), ("y", "b", "skip", ""), ("z", "b", "reject", "d")]
    m = spark.createDataFrame([("a", "a1", "b", "q", 1.0), ("a", "a9", "b", "q", 1.0), ("b", "a1", "a", "q", 1.0)], S.MAPPINGS)
    m2, e2 = resolution.reset(m, e, t.where("track_id = 'x'"), "a", "b")
    assert m2.count() == 2 and sorted(r.track_id for r in e2.collect()) == ["y", "z"]


def test_library_views(spark):
    r = spark.createDataFrame([("Red", None, 1), ("blue", "RED hot", 2), ("x%", "y", 3)], "title string, artist string, availability int")
    assert [resolution.library_filter(r, v).count() for v in ("all", "a", "b", "both")] == [3, 2, 2, 1]
    assert [resolution.free_text(r, v).count() for v in ("red", "", "%", "no")] == [2, 3, 1, 0]


def test_errors_by_kind():
    e = requests.ServiceError
    assert [requests.severity(x) for x in (requests.Cancelled(), requests.Unauthorised(), e(401), e(429), e(404), e(418), ConnectionResetError(), KeyError("x"), ValueError())] == ["fatal", "critical", "critical", "warning", "warning", "info", "warning", "warning", "info"]
    assert [requests.retryable(x) for x in (e(408), e(429), e(503), e(404), e(401), URLError("no route"), TimeoutError(), requests.Cancelled(), ValueError())] == [True, True, True, False, False, True, True, False, False]


def test_attempts():
    calls = []

    def broken():
        calls.append(1)
        raise requests.ServiceError(500)

    with pytest.raises(requests.ServiceError):
        requests.attempted(broken, 3, 0.001)
    assert len(calls) == 3 and requests.named("json:dumps") is json.dumps
    assert F is not None
