"""Differences between two services as an operation log; its incremental filter, application, resume and rollback.

An operation has ``op`` (``add_track``, ``remove_track``, ``create_list``, ``update_members``), ``service``, ``entity_id``, ``members`` and ``op_key``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from concord.functions.ids import members_digest, op_key, parse_op_key
from concord.functions.similarity import Policy
from concord.operators.matching import FLAGS, matched, on_service

NO_MEMBERS = "cast(null as array<string>)"


def track_ops(decisions: DataFrame, target: str) -> DataFrame:
    """Additions for records without a match; automatic, ambiguous and skipped ones cause none."""
    ops = decisions.where("decision = 'no_match'").select(F.lit("add_track").alias("op"), F.lit(target).alias("service"), F.col("source_id").alias("entity_id"), F.expr(NO_MEMBERS).alias("members"))
    return ops.withColumn("op_key", op_key(F.col("op"), F.concat_ws("-", "service", "entity_id")))


def list_ops(source: DataFrame, target: DataFrame, service: str) -> DataFrame:
    """Operations that make the target's lists like the source's.

    Lists have ``id, a_id, b_id, track_ids``. A list without an id on the target is created. Others are updated if their
    members differ in any place or are not known; the target's list is looked up by id, then by its service id.
    """
    sid = f"{service}_id"
    by_id = target.select("id", F.col("track_ids").alias("t1"))
    by_sid = target.where(F.col(sid).isNotNull()).groupBy(sid).agg(F.min_by("track_ids", "id").alias("t2"))
    both = source.join(by_id, "id", "left").join(by_sid, sid, "left").withColumn("theirs", F.coalesce("t1", "t2"))
    op = F.when(F.col(sid).isNull(), "create_list").when(~F.col("track_ids").eqNullSafe(F.col("theirs")), "update_members")
    ops = both.select(op.alias("op"), F.lit(service).alias("service"), F.col("id").alias("entity_id"), F.col("track_ids").alias("members")).where("op is not null")
    name = F.concat_ws("-", "service", "entity_id")
    return ops.withColumn("op_key", F.when(F.col("op") == "create_list", op_key(F.col("op"), name)).otherwise(op_key(F.col("op"), name, members_digest(F.col("members")))))


def library_diff(records: DataFrame, lists: DataFrame, source: str, target: str, target_lists: DataFrame | None = None, p: Policy = Policy(), **overrides) -> DataFrame:
    """Track operations and list operations of one direction."""
    tracks = track_ops(matched(records, source, target, pending_only=True, p=p, **overrides), target)
    own = lists.where(F.col(f"{source}_id").isNotNull())
    there = target_lists if target_lists is not None else lists.limit(0)
    return tracks.unionByName(list_ops(own, there, target))


def bidirectional_diff(records: DataFrame, lists: DataFrame, **options) -> DataFrame:
    return library_diff(records, lists, "a", "b", **options).unionByName(library_diff(records, lists, "b", "a", **options))


def changed_only(ops: DataFrame, state: DataFrame) -> DataFrame:
    """Without list operations whose members were synchronised before; a create with other members is an update.

    ``state`` has ``service, list_id, digest``.
    """
    known = state.select("service", F.col("list_id").alias("entity_id"), F.col("digest").alias("known"))
    own = ops.withColumn("digest", F.when(F.col("members").isNotNull(), members_digest(F.col("members"))))
    own = own.join(known, ["service", "entity_id"], "left").where(F.col("members").isNull() | F.col("known").isNull() | (F.col("known") != F.col("digest")))
    moved = (F.col("op") == "create_list") & F.col("known").isNotNull()
    key = op_key(F.lit("update_members"), F.concat_ws("-", "service", "entity_id"), F.col("digest"))
    return own.select(F.when(moved, "update_members").otherwise(F.col("op")).alias("op"), "service", "entity_id", "members", F.when(moved, key).otherwise(F.col("op_key")).alias("op_key"))


def digest_state(ops: DataFrame) -> DataFrame:
    """``service, list_id, digest`` after list operations."""
    return ops.where("members is not null").select("service", F.col("entity_id").alias("list_id"), members_digest(F.col("members")).alias("digest"))


def diff_summary(ops: DataFrame) -> DataFrame:
    return ops.groupBy("op", "service").agg(F.count("*").alias("n"))


def remaining(ops: DataFrame, log: DataFrame, run_id: str) -> DataFrame:
    """Operations of a resumed run that are not done."""
    done = log.where((F.col("run_id") == run_id) & (F.col("status") == "done")).select("op_key").distinct()
    return ops.join(done, "op_key", "left_anti")


def with_previous(ops: DataFrame, target_lists: DataFrame) -> DataFrame:
    """Updates with the members that the target has before them."""
    t = target_lists.select(F.col("id").alias("entity_id"), F.col("track_ids").alias("previous_track_ids"))
    return ops.where("op = 'update_members'").join(t, "entity_id", "left").unionByName(ops.where("op <> 'update_members'").withColumn("previous_track_ids", F.expr(NO_MEMBERS)))


def applied_tracks(records: DataFrame, ops: DataFrame, remove_clears: bool = False) -> DataFrame:
    """Records after track operations. A removal leaves the flags, as a save unites them, unless ``remove_clears``."""
    flag = F.when(F.col("service") == "a", FLAGS["a"]).otherwise(FLAGS["b"])
    bits = ops.where(F.col("op").isin("add_track", "remove_track")).groupBy(F.col("entity_id").alias("id")).agg(F.bit_or(F.when(F.col("op") == "add_track", flag).otherwise(0)).alias("on"), F.bit_or(F.when(F.col("op") == "remove_track", flag).otherwise(0)).alias("off"))
    now = F.col("availability").bitwiseOR(F.coalesce("on", F.lit(0)))
    if remove_clears:
        now = now.bitwiseAND(F.bitwise_not(F.coalesce("off", F.lit(0))))
    return records.join(bits, "id", "left").withColumn("availability", now.cast("int")).drop("on", "off")


def applied_lists(lists: DataFrame, ops: DataFrame) -> DataFrame:
    """Lists after list operations: full replacement, so that a repeated operation changes nothing. The last by ``ord`` counts, where there is one."""
    last = "ord" if "ord" in ops.columns else "op_key"
    new = ops.where("members is not null").groupBy(F.col("entity_id").alias("id")).agg(F.max_by("members", last).alias("new"))
    return lists.join(new, "id", "full_outer").withColumn("track_ids", F.coalesce("new", "track_ids")).drop("new")


def rollback_plan(log: DataFrame, run_id: str) -> DataFrame:
    """Member replacements that undo a run, newest first; only done updates with earlier members can be undone."""
    rows = log.where((F.col("run_id") == run_id) & (F.col("status") == "done") & F.col("previous_track_ids").isNotNull())
    own = rows.withColumn("parsed", parse_op_key(F.col("op_key"))).where("parsed.kind = 'update_members'")
    members = F.from_json("previous_track_ids", "array<string>")
    return own.select("op_key", F.col("parsed.entity").alias("entity_id"), members.alias("members"), "updated_at", "ord").where("members is not null").orderBy(F.desc("updated_at"), F.desc("ord"))


def run_totals(log: DataFrame) -> DataFrame:
    """Counts of a checkpoint log by run."""
    return log.groupBy("run_id").agg(F.count_if(F.col("status") == "done").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("operations")).withColumn("success_rate", F.when(F.col("operations") > 0, F.col("succeeded") / F.col("operations")).otherwise(0.0))


def pending_sources(records: DataFrame, source: str, target: str) -> DataFrame:
    return records.where(on_service(source) & ~on_service(target))


def compute_diff(records: DataFrame, lists: DataFrame, state: DataFrame, direction: str = "both", target_lists: dict[str, DataFrame] | None = None, **options) -> DataFrame:
    """The operations of a synchronisation: all differences of the direction, without lists that have not changed since the last one.

    ``target_lists`` has, by service, what is known of the lists there; a list that is known to have the same members causes nothing.
    """
    found = None
    for source, target in directions(direction):
        ops = library_diff(records, lists, source, target, (target_lists or {}).get(target), **options)
        found = ops if found is None else found.unionByName(ops)
    return changed_only(found, state)


def directions(direction: str) -> list[tuple[str, str]]:
    """Source and target of ``a>b``, ``b>a`` or ``both``."""
    every = {"a>b": [("a", "b")], "b>a": [("b", "a")]}
    return every["a>b"] + every["b>a"] if direction == "both" else every[direction]


def dry_run_report(ops: DataFrame) -> DataFrame:
    """What a run would do, in one row: operations in all, on tracks, lists created and updated."""
    n = lambda *kinds: F.count_if(F.col("op").isin(*kinds))
    return ops.agg(F.count("*").alias("operations"), n("add_track", "remove_track").alias("tracks"), n("create_list").alias("created"), n("update_members").alias("updated"))


def list_order(ops: DataFrame) -> DataFrame:
    """``entity_id, place, lists``: lists of the operations in the order in which they first appear (by ``ord``), as ``place`` of ``lists``."""
    from concord.operators.ordering import numbered

    first = ops.where("members is not null").groupBy("entity_id").agg(F.min("ord").alias("first"))
    placed, lists = numbered(first, "first", "entity_id")
    return placed.select("entity_id", (F.col("n") + 1).alias("place"), F.lit(lists).cast("long").alias("lists"))


def run_state(ops: DataFrame, log: DataFrame, run_id: str, cancelled: bool = False) -> DataFrame:
    """``operations, succeeded, failed, open, fraction, status`` of a run; one that is cancelled or has failures is not completed."""
    own = log.where(F.col("run_id") == run_id).groupBy("op_key").agg(F.max(F.col("status") == "done").alias("done"))
    both = ops.select("op_key").distinct().join(own, "op_key", "left")
    n = both.agg(F.count("*").alias("operations"), F.count_if("done").alias("succeeded"), F.count_if(~F.col("done")).alias("failed"))
    n = n.withColumn("open", F.col("operations") - F.col("succeeded") - F.col("failed"))
    fraction = F.when(F.col("operations") > 0, (F.col("succeeded") + F.col("failed")) / F.col("operations")).otherwise(1.0)
    status = F.when(F.lit(cancelled) | (F.col("open") > 0), "cancelled").when(F.col("failed") > 0, "failed").otherwise("completed")
    return n.withColumns({"fraction": fraction, "status": status})
