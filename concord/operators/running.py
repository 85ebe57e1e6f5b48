"""Synchronisation runs: the operations of a difference are applied in batches, each recorded as a whole, and can be stopped, resumed and undone.

Tracks go first, many at a time; when all of them are through, lists follow in order. A batch's effects, its checkpoint rows and its list digests become
visible with one commit, so a lost job leaves neither alone; its effects replace whole states and are repeated by the next run. Progress comes
from counts observed while a batch is written, without another pass.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, Window as W, functions as F

from concord import schema as S
from concord.functions.ids import members_digest
from concord.operators.commits import Store
from concord.operators.matching import matched, outcomes
from concord.operators.ordering import numbered
from concord.operators.stores import latest_resumable
from concord.operators.syncing import applied_tracks, changed_only, directions, list_ops, pending_sources, rollback_plan, track_ops
from concord.session import discard, stored
from concord.sources.sinks import send

LISTS = f"{S.LISTS}, track_ids ARRAY<STRING>"
TABLES = {"records": S.RECORDS, "lists": LISTS, "mappings": S.MAPPINGS, "exclusions": S.EXCLUSIONS, "outcomes": S.OUTCOMES, "runs": S.RUNS, "checkpoints": f"{S.CHECKPOINTS}, ord BIGINT", "list_state": S.LIST_STATE}
KEYS = {"records": ["id"], "lists": ["id"], "mappings": ["source_service", "source_track_id"], "runs": ["id"], "checkpoints": ["run_id", "op_key"], "list_state": ["service", "list_id"]}
#: Tables that match decisions depend on.
DECISIVE = ("records", "mappings", "exclusions")


def library(spark: SparkSession, folder: str) -> Store:
    """The tables of a library: records, lists, decisions by hand, and the log of its runs."""
    return Store(spark, folder, TABLES, KEYS, kept=("previous_track_ids",))


class NothingToResume(Exception):
    pass


class AlreadyCompleted(Exception):
    pass


class RollbackFailed(Exception):
    pass


@dataclass(frozen=True)
class Progress:
    run_id: str
    phase: str  # tracks, lists, finished, cancelled
    completed: int
    total: int
    failed: int = 0
    skipped: int = 0
    list_name: str | None = None
    list_index: int = 0
    list_count: int = 0
    announcement: str | None = None

    @property
    def fraction(self) -> float:
        return min(1.0, self.completed / self.total) if self.total > 0 else float(self.phase == "finished")

    @property
    def status_line(self) -> str:
        counts = f"{self.completed} of {self.total} operations"
        if self.phase == "tracks":
            return f"Library tracks · {counts}"
        if self.phase == "lists":
            return f"Playlist {self.list_index} of {self.list_count}: {self.list_name or 'Untitled playlist'} · {counts}"
        if self.phase == "finished":
            return f"Sync finished with {self.failed} failed · {counts}" if self.failed else f"Sync finished · {counts}"
        return f"Sync cancelled · {counts}. Resume to continue."


@dataclass
class Result:
    run_id: str
    total: int = 0
    succeeded: int = 0  # with those that an earlier attempt had done
    failed: int = 0
    skipped: int = 0
    cancelled: bool = False
    seconds: float = 0.0
    errors: list[str] = field(default_factory=list)  # the first five of each batch


class Effects:
    """A remote that takes one operation at a time: ``effect`` is called in the workers, at ``rate`` a second in all."""

    def __init__(self, effect: Callable[[dict], None], rate: float = 2.0, parallel: int = 5, attempts: int = 3, batch: int = 500, **options):
        self.effect, self.batch, self.parallel = effect, batch, parallel
        self.options = {"rate": rate, "attempts": attempts} | options

    def apply(self, store: Store, ops: DataFrame, phase: str) -> tuple[DataFrame, dict[str, DataFrame]]:
        return send(ops, self.effect, parallel=self.parallel, order="n" if phase == "lists" else None, **self.options), {}


class LocalLibrary:
    """A remote that is the library itself: a phase's operations are joins, and the changed rows are part of the commit."""

    batch = None

    def apply(self, store: Store, ops: DataFrame, phase: str) -> tuple[DataFrame, dict[str, DataFrame]]:
        table = store.read("records" if phase == "tracks" else "lists")
        known = table.select(F.col("id").alias("entity_id"), F.lit(True).alias("known"))
        there = F.coalesce("known", F.col("op") == "create_list")
        log = ops.join(known, "entity_id", "left").select("op_key", F.when(there, "done").otherwise("failed").alias("status"), F.when(~there, F.concat(F.lit("not found: "), "entity_id")).alias("error"))
        if phase == "tracks":
            named = ops.select(F.col("entity_id").alias("id")).distinct()
            return log, {"records": applied_tracks(table.join(named, "id", "left_semi"), ops)}
        new = ops.groupBy(F.col("entity_id").alias("id")).agg(F.max_by("members", "n").alias("new"), F.max(F.col("op") == "create_list").alias("made"))
        rows = table.join(new, "id", "right").where(F.col("made") | F.col("track_ids").isNotNull())
        return log, {"lists": rows.withColumn("track_ids", F.col("new")).drop("new", "made")}


class Runner:
    def __init__(self, store: Store, remote, progress: Callable[[Progress], None] | None = None, clock: Callable[[], float] = time.time):
        self.store, self.remote, self.spark, self.clock = store, remote, store.spark, clock
        self.progress = progress or (lambda event: None)
        self._stop, self.tag = threading.Event(), f"concord-run-{uuid.uuid4().hex[:8]}"

    def cancel(self, drain: bool = True) -> None:
        """No further batch begins. The one at work ends and is recorded; without ``drain`` its jobs are ended, and it counts as not applied."""
        self._stop.set()
        if not drain:
            self.spark.sparkContext.cancelJobsWithTag(self.tag)

    # ---- entries

    def difference(self, direction: str, run_id: str | None = None, resumed: str | None = None) -> DataFrame:
        """The operations of a synchronisation. With ``run_id`` the match decisions are recorded, once for the run.

        Decisions of a run that is ``resumed`` are those that it recorded, unless what they depend on has changed since.
        """
        s, found, facts = self.store, None, None
        records, lists = s.read("records"), s.read("lists")
        parts = s.state()["parts"]
        decided = {"run": run_id or resumed, "direction": direction, "from": {name: parts.get(name, []) for name in DECISIVE}}
        known = resumed is not None and s.value("decided") == decided
        for step, (source, target) in enumerate(directions(direction)):
            if known:
                made = self._recorded(resumed, records, source, target)
            else:
                made = stored(matched(records, source, target, s.read("mappings"), s.read("exclusions"), pending_only=True), "decisions")
            ord_ = made.select(F.col("source_id").alias("entity_id"), "ord")
            tracks = track_ops(made, target).join(ord_, "entity_id")
            own = lists.where(F.col(f"{source}_id").isNotNull()).select("id", "a_id", "b_id", "track_ids")
            ops = tracks.unionByName(list_ops(own, own.limit(0), target).withColumn("ord", F.lit(None).cast("long"))).withColumn("step", F.lit(step))
            found = ops if found is None else found.unionByName(ops)
            if run_id is not None:
                rows = outcomes(made, run_id, source, target)
                facts = rows if facts is None else facts.unionByName(rows)
        if run_id is not None:
            s.commit(f"{run_id}:outcomes", {"outcomes": facts}, decided=decided)
        kept = changed_only(found.drop("ord", "step"), s.read("list_state"))
        of_list = F.col("members").isNotNull().alias("of_list")
        places = found.select("service", "entity_id", of_list, "step", "ord").distinct()
        return kept.withColumn("of_list", of_list).join(places, ["service", "entity_id", "of_list"]).drop("of_list")

    def _recorded(self, run_id: str, records: DataFrame, source: str, target: str) -> DataFrame:
        """``source_id, decision, ord`` of the decisions that a run has recorded for a direction."""
        own = self.store.read("outcomes").where((F.col("run_id") == run_id) & (F.col("source_service") == source) & (F.col("target_service") == target))
        places = pending_sources(records, source, target).groupBy(F.col("id").alias("source_id")).agg(F.min("ord").alias("ord"))
        return own.select(F.col("source_track_id").alias("source_id"), "decision").join(places, "source_id")

    def perform(self, direction: str = "both", dry_run: bool = False, run_id: str | None = None) -> Result:
        run_id = run_id or str(uuid.uuid4())
        ops = stored(self.difference(direction, None if dry_run else run_id), "difference")
        return self.execute(ops, direction, run_id, dry_run)

    def resume(self, run_id: str | None = None) -> Result:
        """Go on with a run, by default the most recent one if it is not completed. The difference is computed anew, its decisions are not recorded again.

        Nor are they made again if records and decisions by hand are the same files as when they were recorded.
        """
        runs = self.store.read("runs")
        run = (runs.where(F.col("id") == run_id) if run_id else latest_resumable(runs)).first()
        if run is None:
            raise NothingToResume(run_id)
        if run.status == "completed":
            raise AlreadyCompleted(run.id)
        return self.execute(stored(self.difference(run.direction, resumed=run.id), "difference"), run.direction, run.id)

    def rollback(self, run_id: str) -> int:
        """Restore the members of the lists that a run has changed, newest change first; gives how many. The first failure ends it."""
        plan = rollback_plan(self.store.read("checkpoints"), run_id)
        ops, total = numbered(plan.select(F.lit("update_members").alias("op"), F.regexp_extract("entity_id", "^([^-]*)-", 1).alias("service"), F.regexp_extract("entity_id", "^[^-]*-(.*)$", 1).alias("entity_id"), "members", "op_key", "updated_at", "ord"), F.desc("updated_at"), F.desc("ord"))
        restored, width = 0, self.remote.batch or max(1, total)
        for first in range(0, total, width):
            log, changes = self.remote.apply(self.store, ops.where((F.col("n") >= first) & (F.col("n") < first + width)), "lists")
            log = stored(log, "restored")
            states = log.groupBy("status").agg(F.count("*").alias("n"), F.min("error").alias("error")).collect()
            if changes:
                self.store.commit(f"{run_id}:rollback:{uuid.uuid4().hex}", changes)
            restored += sum(r.n for r in states if r.status == "done")
            bad = [r for r in states if r.status != "done"]
            if bad:
                raise RollbackFailed(f"{restored} restored, then: {bad[0].error or bad[0].status}")
        return restored

    # ---- one run

    def execute(self, ops: DataFrame, direction: str, run_id: str | None = None, dry_run: bool = False) -> Result:
        """Apply operations (``op, service, entity_id, members, op_key``; ordered by ``step`` and ``ord`` where they have them); those that the run has done are skipped."""
        began, s = self.clock(), self.store
        run_id = run_id or str(uuid.uuid4())
        ordered, total = self._prepared(ops)
        result = Result(run_id, total)
        if total == 0:
            return result
        old = s.read("runs").where(F.col("id") == run_id).first()
        done = s.read("checkpoints").where((F.col("run_id") == run_id) & (F.col("status") == "done")).select("op_key")
        left = ordered.join(done, "op_key", "left_anti")
        todo, n = numbered(left, "phase", "n", name="m")
        result.skipped = total - n
        attempt = uuid.uuid4().hex[:8]
        lists = ordered.where("phase = 1").select("entity_id").distinct().count()
        first_list = todo.where("phase = 0").count()
        if not dry_run:
            self._save_run(f"{run_id}:{attempt}:start", run_id, old, direction, total, "running", None, result, began)
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            for phase, start, stop in (("tracks", 0, first_list), ("lists", first_list, n)):
                width = self.remote.batch or max(1, stop - start)
                for at in range(start, stop, width):
                    if self._stop.is_set():
                        result.cancelled = True
                    if result.cancelled:
                        break
                    rows = todo.where((F.col("m") >= at) & (F.col("m") < min(stop, at + width)))
                    self._batch(f"{run_id}:{attempt}:{at}", rows, phase, dry_run, result, lists)
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
        result.cancelled = result.cancelled or self._stop.is_set()
        result.succeeded += result.skipped
        result.seconds = self.clock() - began
        status = "cancelled" if result.cancelled else "failed" if result.failed else "completed"
        if not dry_run:
            self._save_run(f"{run_id}:{attempt}:end", run_id, old, direction, total, status, self.clock(), result, began)
        completed = result.succeeded + result.failed
        said = f"Sync cancelled. {completed} of {total} operations done." if result.cancelled else f"Sync finished with {result.failed} failures." if result.failed else f"Sync finished. {total} operations."
        self._emit(result, "cancelled" if result.cancelled else "finished", completed, announcement=said)
        return result

    def _prepared(self, ops: DataFrame) -> tuple[DataFrame, int]:
        """Operations in order, with ``phase``, the place of each list, its name, and the members that it has before each operation."""
        for c in ("step", "ord"):
            if c not in ops.columns:
                ops = ops.withColumn(c, F.lit(0).cast("long"))
        own = ops.withColumn("phase", F.col("members").isNotNull().cast("int")).dropDuplicates(["op_key"])
        rows, total = numbered(own, "phase", "step", "ord", "entity_id", "op_key")
        first = rows.where("phase = 1").groupBy("entity_id").agg(F.min("n").alias("first"))
        places = numbered(first, "first", name="place")[0].select("entity_id", (F.col("place") + 1).alias("place"))
        heads = self.store.read("lists").select(F.col("id").alias("entity_id"), "name", F.col("track_ids").alias("theirs"))
        before = F.lag("members").over(W.partitionBy("entity_id").orderBy("n"))
        lists = rows.where("phase = 1").withColumn("before", before).join(places, "entity_id").join(heads, "entity_id", "left")
        previous = F.when(F.col("op") == "update_members", F.coalesce("before", "theirs"))
        lists = lists.withColumn("previous", previous).drop("before", "theirs")
        tracks = rows.where("phase = 0").select(*rows.columns, F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("array<string>").alias("previous"))
        return stored(tracks.unionByName(lists.select(*tracks.columns)), "operations"), total

    def _batch(self, batch: str, rows: DataFrame, phase: str, dry_run: bool, result: Result, lists: int) -> None:
        run_id, changes, seen = result.run_id, {}, Observation()
        if dry_run:
            log = rows.select("op_key", F.lit("done").alias("status"), F.lit(None).cast("string").alias("error"))
        else:
            log, changes = self.remote.apply(self.store, rows, phase)
        n = {x: F.count_if(F.col("status") == x).alias(x) for x in ("done", "failed", "cancelled")}
        log = stored(log.observe(seen, *n.values()), "outcomes")  # effects happen here, once
        count = seen.get
        if not dry_run:
            both = log.where("status <> 'cancelled'").join(rows, "op_key")
            now = F.lit(self.clock()).cast("timestamp")
            previous = F.when(F.col("status") == "done", F.to_json("previous"))
            points = both.select(F.lit(run_id).alias("run_id"), "op_key", "status", previous.alias("previous_track_ids"), "error", now.alias("updated_at"), F.col("n").alias("ord"))
            applied = both.where("status = 'done' AND members IS NOT NULL")
            last = applied.groupBy("service", F.col("entity_id").alias("list_id")).agg(F.max_by("members", "n").alias("members"))
            digests = last.select("service", "list_id", members_digest(F.col("members")).alias("digest"), now.alias("synced_at"))
            self.store.commit(batch, {"checkpoints": points, "list_state": digests} | changes)
        completed = result.succeeded + result.failed + result.skipped
        if phase == "lists":
            # a row for each list of the batch, in order
            for r in rows.join(log, "op_key").groupBy("place").agg(F.min("n").alias("n"), F.first("name").alias("name"), F.count_if(F.col("status") != "cancelled").alias("k")).orderBy("place").collect():
                name = r.name if r.name is not None else "Untitled playlist"
                here = {"list_name": name, "list_index": r.place, "list_count": lists}
                self._emit(result, phase, completed, announcement=f"Syncing playlist {r.place} of {lists}, {name}", **here)
                completed += r.k
                self._emit(result, phase, completed, **here)
        result.succeeded += count["done"]
        result.failed += count["failed"]
        result.cancelled = result.cancelled or count["cancelled"] > 0
        if count["failed"]:
            result.errors += [f"{r.op_key}: {r.error}" for r in log.where("status = 'failed'").orderBy("op_key").limit(5).collect()]
        if phase == "tracks":
            self._emit(result, phase, result.succeeded + result.failed + result.skipped)
        discard(log)

    def _emit(self, result: Result, phase: str, completed: int, **more) -> None:
        self.progress(Progress(result.run_id, phase, completed, result.total, result.failed, result.skipped, **more))

    def _save_run(self, batch: str, run_id: str, old, direction: str, total: int, status: str, ended: float | None, result: Result, began: float) -> None:
        stamp = lambda t: F.lit(t).cast("timestamp")
        row = self.spark.range(1).select(
            F.lit(run_id).alias("id"), (F.lit(old.started_at) if old else stamp(began)).alias("started_at"), stamp(ended).alias("completed_at"), F.lit(direction).alias("direction"),
            F.lit(old.operations_count if old else total).alias("operations_count"), F.lit(result.succeeded).alias("success_count"), F.lit(result.failed).alias("failure_count"),
            F.lit(status).alias("status"), F.lit((old.duration_seconds or 0.0 if old else 0.0) + result.seconds).alias("duration_seconds"),
        )
        self.store.commit(batch, {"runs": row})
