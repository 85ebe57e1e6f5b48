"""Runs of a synchronisation: retries, cancelling, resuming, progress, rollback, and the store's commits."""

import os
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from concord.operators import running, syncing
from concord.operators.commits import Conflict, Store
from concord.operators.running import AlreadyCompleted, Effects, LocalLibrary, NothingToResume, Progress, RollbackFailed, Runner, library
from concord.sources.requests import Cancelled, ServiceError

OPS = "op string, service string, entity_id string, members array<string>, op_key string, ord long"
LISTS = "id string, name string, a_id string, b_id string, track_ids array<string>"
FAST = {"rate": 10_000.0, "pause": 0.001}


def track_ops(spark, n):
    return spark.createDataFrame([("add_track", "b", f"t{i}", None, f"add_track:b-t{i}", i) for i in range(n)], OPS)


def create(key, members, ord_, op="create_list"):
    return (op, "b", key, members, f"{op}:b-{key}" + (f":{len(members)}{''.join(members)}" if op == "update_members" else ""), ord_)


class Calls:
    """What an effect was called with, in a folder that the workers share with the test."""

    def __init__(self, folder):
        self.folder = str(folder)
        os.makedirs(self.folder, exist_ok=True)

    def effect(self, script=None):
        folder = self.folder

        def run(op):
            before = len(os.listdir(folder))
            attempt = sum(op["op_key"].replace("/", "_") in f for f in os.listdir(folder)) + 1
            if script is not None:
                script(op, attempt, before + 1, lambda: Path(folder, f"{time.time_ns()} {op['op_key']}").touch())
            else:
                Path(folder, f"{time.time_ns()} {op['op_key']}").touch()

        return run

    @property
    def all(self):
        return [f.split(" ", 1)[1] for f in sorted(os.listdir(self.folder))]


@pytest.fixture
def store(spark, tmp_path):
    return library(spark, str(tmp_path / "library"))


def run_of(store, run_id):
    return store.read("runs").where(F.col("id") == run_id).first()


def test_busy_service_is_tried_again(spark, store, tmp_path):
    calls = Calls(tmp_path / "calls")

    def script(op, attempt, total, note):
        note()
        if attempt <= 2:
            raise ServiceError(429, after=0.01)

    result = Runner(store, Effects(calls.effect(script), **FAST)).execute(track_ops(spark, 1), "a>b")
    assert (result.succeeded, result.failed, len(calls.all)) == (1, 0, 3)


def test_other_errors_fail_once_and_are_recorded(spark, store, tmp_path):
    calls = Calls(tmp_path / "calls")

    def script(op, attempt, total, note):
        note()
        raise ServiceError(404, "gone")

    result = Runner(store, Effects(calls.effect(script), **FAST)).execute(track_ops(spark, 1), "a>b", "run-404")
    assert (result.failed, len(calls.all)) == (1, 1) and "404" in result.errors[0]
    rows = store.read("checkpoints").collect()
    assert [(r.run_id, r.status, r.previous_track_ids) for r in rows] == [("run-404", "failed", None)] and "gone" in rows[0].error
    assert run_of(store, "run-404").status == "failed"


def test_cancel_stops_calls_and_resume_skips_what_is_done(spark, store, tmp_path):
    calls, events = Calls(tmp_path / "calls"), []

    def script(op, attempt, total, note):
        if total > 3:
            raise Cancelled
        note()

    ops = track_ops(spark, 6)
    first = Runner(store, Effects(calls.effect(script), parallel=1, batch=2, **FAST), events.append).execute(ops, "a>b", "run-c")
    assert first.cancelled and first.succeeded == 3 and len(calls.all) == 3
    assert run_of(store, "run-c").status == "cancelled" and events[-1].phase == "cancelled" and events[-1].announcement == "Sync cancelled. 3 of 6 operations done."
    assert store.read("checkpoints").count() == 3  # what was cancelled has no row
    earlier = run_of(store, "run-c")
    second = Runner(store, Effects(calls.effect(), parallel=1, batch=2, **FAST)).execute(ops, "a>b", "run-c")
    assert (second.cancelled, second.skipped, second.succeeded, len(calls.all), len(set(calls.all))) == (False, 3, 6, 6, 6)
    last = run_of(store, "run-c")
    assert last.status == "completed" and last.success_count == 6 and last.started_at == earlier.started_at and last.duration_seconds > earlier.duration_seconds


def test_cancel_from_outside_lets_the_batch_end(spark, store, tmp_path):
    calls = Calls(tmp_path / "calls")

    def script(op, attempt, total, note):
        note()
        time.sleep(0.02)

    runner = Runner(store, Effects(calls.effect(script), parallel=2, batch=5, **FAST))
    runner.progress = lambda e: runner.cancel() if e.phase == "tracks" else None
    result = runner.execute(track_ops(spark, 40), "a>b", "run-p")
    done = store.read("checkpoints").where("status = 'done'").count()
    assert result.cancelled and len(calls.all) == done == result.succeeded == 5


def test_jobs_can_be_ended_by_their_tag(spark, store, tmp_path):
    begun = str(tmp_path / "begun")

    def slow(op):
        Path(begun).touch()
        time.sleep(25)

    runner = Runner(store, Effects(slow, parallel=2, **FAST))

    def wait():
        while not os.path.exists(begun):
            time.sleep(0.1)
        runner.cancel(drain=False)

    threading.Thread(target=wait, daemon=True).start()
    with pytest.raises(Exception, match="(?i)cancel"):
        runner.execute(track_ops(spark, 4), "a>b", "run-i")
    assert run_of(store, "run-i").status == "running" and store.read("checkpoints").count() == 0  # resumable, nothing half recorded
    assert Runner(store, Effects(lambda op: None, **FAST)).execute(track_ops(spark, 4), "a>b", "run-i").succeeded == 4


def test_progress_names_lists_and_counts(spark, store):
    store.commit("lists", {"lists": spark.createDataFrame([("p1", "Road Trip", "x", None, []), ("p2", "Focus", "y", None, [])], LISTS)})
    ops = track_ops(spark, 2).union(spark.createDataFrame([create("p1", [], 1), create("p2", ["q"], 2)], OPS))
    for batch in (1, 100):
        events = []
        Runner(store, Effects(lambda op: None, batch=batch, **FAST), events.append).execute(ops, "a>b")
        road = next(e for e in events if e.list_name == "Road Trip")
        assert (road.list_index, road.list_count, road.announcement) == (1, 2, "Syncing playlist 1 of 2, Road Trip")
        assert road.status_line == "Playlist 1 of 2: Road Trip · 2 of 4 operations"
        assert any(e.list_name == "Focus" and e.list_index == 2 for e in events)
        assert events[-1].phase == "finished" and events[-1].fraction == 1 and [e.completed for e in events] == sorted(e.completed for e in events)


def test_status_lines():
    p = lambda phase, **more: Progress("r", phase, 140, 900, **more).status_line
    assert p("tracks") == "Library tracks · 140 of 900 operations"
    assert p("lists", list_name="Road Trip", list_index=3, list_count=12) == "Playlist 3 of 12: Road Trip · 140 of 900 operations"
    assert p("finished") == "Sync finished · 140 of 900 operations" and p("finished", failed=2) == "Sync finished with 2 failed · 140 of 900 operations"
    assert p("cancelled") == "Sync cancelled · 140 of 900 operations. Resume to continue."
    assert Progress("r", "finished", 0, 0).fraction == 1 and Progress("r", "tracks", 0, 0).fraction == 0


def records(spark, rows):
    cols = "ord long, id string, title string, artist string, seconds long, a_id string, b_id string, availability int"
    return spark.createDataFrame([(n, i, f"{i} title", f"{i} artist", 100, "a" + i if f & 1 else None, "b" + i if f & 2 else None, f) for n, (i, f) in enumerate(rows)], cols)


def test_second_run_of_an_unchanged_library_does_nothing(spark, store):
    store.commit("start", {"records": records(spark, [("x", 1), ("y", 1)]), "lists": spark.createDataFrame([("pl", "Mix", "a-pl", None, ["x", "y"])], LISTS)})
    runner = Runner(store, LocalLibrary())
    first = runner.perform("a>b")
    assert (first.total, first.succeeded) == (3, 3)
    assert {r.id: r.availability for r in store.read("records").collect()} == {"x": 3, "y": 3}
    assert store.read("outcomes").count() == 2 and {r.run_id for r in store.read("outcomes").collect()} == {first.run_id}
    assert runner.perform("a>b").total == 0 and store.read("runs").count() == 1
    store.commit("changed", {"lists": spark.createDataFrame([("pl", "Mix", "a-pl", None, ["y"])], LISTS)})
    assert [(r.op, r.entity_id, r.members) for r in runner.difference("a>b").collect()] == [("update_members", "pl", ["y"])]


def test_dry_run_changes_nothing(spark, store):
    store.commit("start", {"records": records(spark, [("x", 1)])})
    before = store.state()
    result = Runner(store, LocalLibrary()).perform("a>b", dry_run=True)
    assert (result.total, result.succeeded) == (1, 1) and store.state() == before


def test_failed_list_is_resumed_and_members_are_restored(spark, store, tmp_path):
    calls = Calls(tmp_path / "calls")
    lists = [("ok", "Works", "a-ok", None, []), ("flaky", "Flaky", "a-flaky", None, [])]
    store.commit("start", {"records": records(spark, [("x", 3), ("y", 3)]), "lists": spark.createDataFrame(lists, LISTS)})

    def script(op, attempt, total, note):
        note()
        if op["entity_id"] == "flaky" and attempt == 1:
            raise ServiceError(400)

    runner = Runner(store, Effects(calls.effect(script), **FAST))
    first = runner.perform("a>b")
    assert first.failed == 1 and run_of(store, first.run_id).status == "failed"
    resumed = runner.resume()
    assert (resumed.run_id, resumed.failed) == (first.run_id, 0) and run_of(store, first.run_id).status == "completed"
    assert sum("flaky" in c for c in calls.all) == 2 and sum(c.endswith("-ok") for c in calls.all) == 1
    with pytest.raises(AlreadyCompleted):
        runner.resume(first.run_id)
    with pytest.raises(NothingToResume):
        runner.resume()
    assert store.read("outcomes").count() == 0  # both tracks are on both services

    store.commit("on both", {"lists": spark.createDataFrame([("ok", "Works", "a-ok", "b-ok", ["x"])], LISTS)})
    local = Runner(store, LocalLibrary())
    ops = spark.createDataFrame([create("ok", ["x", "y"], 1, "update_members"), create("ok", ["y"], 2, "update_members"), create("nowhere", ["y"], 3, "update_members")], OPS)
    done = local.execute(ops, "a>b", "run-upd")
    members = lambda: {r.id: r.track_ids for r in store.read("lists").collect()}["ok"]
    assert (done.succeeded, done.failed) == (2, 1) and members() == ["y"] and "nowhere" in done.errors[0]
    assert local.rollback("run-upd") == 2 and members() == ["x"] and local.rollback("no-run") == 0

    def refuse(op):
        raise ServiceError(500)

    with pytest.raises(RollbackFailed, match="0 restored"):
        Runner(store, Effects(refuse, attempts=1, **FAST)).rollback("run-upd")


def test_resumed_run_takes_its_decisions_over(spark, store, tmp_path, monkeypatch):
    made, real = [], running.matched
    monkeypatch.setattr(running, "matched", lambda *a, **k: made.append(1) or real(*a, **k))
    store.commit("start", {"records": records(spark, [("x", 1), ("y", 1), ("quite some other matter", 2)]), "lists": spark.createDataFrame([("pl", "Mix", "a-pl", None, ["x"])], LISTS)})

    def refuse(op):
        if op["entity_id"] != "x":
            raise ServiceError(400)

    first = Runner(store, Effects(refuse, **FAST)).perform("both")
    assert (first.total, first.succeeded, first.failed, len(made)) == (4, 1, 3, 2)
    again = Runner(store, Effects(refuse, **FAST)).resume(first.run_id)
    assert (again.total, again.skipped, again.failed, len(made)) == (4, 1, 3, 2)  # nothing is decided again
    assert store.read("outcomes").count() == 3
    store.commit("more", {"records": records(spark, [("x", 3)])})  # x is there by now, and y is like it
    ops = {r.op_key for r in Runner(store, LocalLibrary()).difference("both", resumed=first.run_id).collect()}
    assert ops == {"add_track:a-quite some other matter", "create_list:b-pl"} and len(made) == 4
    last = Runner(store, LocalLibrary()).resume(first.run_id)
    assert (last.failed, last.total, len(made)) == (0, 2, 6) and run_of(store, first.run_id).status == "completed"


def test_lost_batch_leaves_neither_rows_nor_digests(spark, store, monkeypatch):
    ops = spark.createDataFrame([create(f"l{i}", ["m"], i) for i in range(4)], OPS)
    runner, publish = Runner(store, Effects(lambda op: None, batch=2, **FAST)), Store._publish

    def lost(self, state, base):
        if any(":2" in b for b in state["batches"]):
            raise OSError("the driver is gone")
        publish(self, state, base)

    monkeypatch.setattr(Store, "_publish", lost)
    with pytest.raises(OSError):
        runner.execute(ops, "a>b", "run-l")
    assert (store.read("checkpoints").count(), store.read("list_state").count(), run_of(store, "run-l").status) == (2, 2, "running")
    monkeypatch.undo()
    again = runner.execute(ops, "a>b", "run-l")
    assert (again.skipped, again.succeeded, store.read("checkpoints").count(), store.read("list_state").count()) == (2, 4, 4, 4)


def test_commits(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), {"kv": "k string, v long, w string", "log": "x long"}, {"kv": ["k"]}, kept=("w",))
    row = lambda k, v, w=None: spark.createDataFrame([(k, v, w)], "k string, v long, w string")
    log = spark.range(2).toDF("x")
    assert s.read("kv").count() == 0 and s.commit("1", {"kv": row("a", 1, "old"), "log": log})
    assert not s.commit("1", {"log": log}) and s.read("log").count() == 2  # a repeated batch
    s.commit("2", {"kv": row("a", 2)}, mark=5)
    s.commit("3", {"kv": row("b", 7), "log": log})
    assert {tuple(r) for r in s.read("kv").collect()} == {("a", 2, "old"), ("b", 7, None)} and s.value("mark") == 5
    base = max(s._numbers())
    Path(tmp_path, "s", "manifests", f"{base + 1:09d}.json").write_text('{"parts": {"kv"')  # a writer that was lost midway
    assert s.read("kv").count() == 2 and s.commit("4", {"kv": row("c", 1)}) and s.read("kv").count() == 3
    with pytest.raises(Conflict):
        s._publish({}, base + 1)
    s.compact("kv")
    s.compact("log")
    s.vacuum()
    assert {tuple(r) for r in s.read("kv").collect()} == {("a", 2, "old"), ("b", 7, None), ("c", 1, None)} and s.read("log").count() == 4
    assert s.committed("2") and len(os.listdir(tmp_path / "s" / "kv")) == 1
    s.commit("5", {"log": log.limit(1)}, replaced=["log"])
    assert s.read("log").count() == 1


def test_numbered(spark):
    from concord.operators.ordering import numbered

    rows, n = numbered(spark.range(1000).selectExpr("id", "id % 7 AS g"), F.desc("g"), "id")
    got = rows.orderBy("n").collect()
    assert n == 1000 and [r.n for r in got] == list(range(1000)) and [(r.g, r.id) for r in got] == sorted(((i % 7, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
    empty, n = numbered(spark.range(0), "id")
    assert n == 0 and empty.count() == 0


def test_restored_keys():
    assert issubclass(running.AlreadyCompleted, Exception) and syncing.directions("both") == [("a", "b"), ("b", "a")]
