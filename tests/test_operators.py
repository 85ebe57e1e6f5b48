import random

from pyspark.sql import functions as F

from concord import schema as S
from concord.functions.similarity import Policy
from concord.operators import components, matching, merging, metrics, stores, syncing

COLS = "ord long, id string, title string, artist string, album string, code string, seconds long, explicit boolean, a_id string, b_id string, availability int"


def records(spark, rows):
    base = dict(album=None, code=None, seconds=None, explicit=None, a_id=None, b_id=None)
    names = [c.split()[0] for c in COLS.split(", ")]
    return spark.createDataFrame([tuple((base | {"ord": i} | r)[n] for n in names) for i, r in enumerate(rows)], COLS)


def rec(id, title, artist, where, **kw):
    return dict(id=id, title=title, artist=artist, availability=where) | kw


def decide(*a, **kw):
    return {r.source_id: r for r in matching.matched(*a, **kw).collect()}


def test_decoys_do_not_hide_the_match(spark):
    rows = [rec("s", "Blue Hour", "The Lamps", 1, seconds=200)] + [rec(f"d{i}", f"Other {i}", f"The Decoy{i}", 2) for i in range(60)] + [rec("t", "Blue Hour", "The Lamps", 2, seconds=200)]
    got = decide(records(spark, rows), "a", "b")["s"]
    assert (got.decision, got.candidate_id, got.method) == ("auto", "t", "fuzzy")


def test_ranked_before_cut(spark):
    rows = [rec("s", "Last Song", "Anna", 1)] + [rec(f"d{i}", f"Noise {i}", "Anna", 2) for i in range(200)] + [rec("t", "Last Song", "Anna", 2)]
    pairs = matching.word_pairs(*(matching.keyed(records(spark, rows)).where(matching.on_service(x)) for x in "ab"), Policy(candidates=5)).orderBy("pre_rank").collect()
    assert len(pairs) == 5 and pairs[0].t_id == "t"


def test_missing_album_and_length_still_match(spark):
    got = decide(records(spark, [rec("s", "Song", "Anna", 1), rec("t", "Song", "Anna", 2)]), "a", "b")["s"]
    assert got.decision == "auto" and abs(got.score - 0.875) < 1e-12


def test_code_first_row_and_reject(spark):
    rows = [rec("s", "One", "Anna", 1, code="us1"), rec("t1", "Two", "Bert", 2, code="US1"), rec("t2", "One", "Anna", 2, code="US1")]
    r = records(spark, rows)
    got = decide(r, "a", "b")["s"]
    assert (got.candidate_id, got.score, got.method) == ("t1", 0.95, "isrc")
    e = spark.createDataFrame([("s", "b", "reject", "t1")], S.EXCLUSIONS)
    assert decide(r, "a", "b", exclusions=e)["s"].decision == "no_match"  # no way back to metadata


def test_mapping_beats_skip(spark):
    r = records(spark, [rec("s", "One", "Anna", 1, a_id="x"), rec("u", "Two", "Anna", 1)])
    m = spark.createDataFrame([("a", "x", "b", "elsewhere", None)], S.MAPPINGS)
    e = spark.createDataFrame([("s", "b", "skip", ""), ("u", "b", "skip", "")], S.EXCLUSIONS)
    got = decide(r, "a", "b", mappings=m, exclusions=e)
    assert (got["s"].method, got["s"].score, got["s"].candidate_id) == ("manual", 1.0, "elsewhere")
    assert got["u"].decision == "skipped"


def test_empty_catalogue(spark):
    r = records(spark, [rec("s", "One", "Anna", 1)])
    assert decide(r, "a", "b")["s"].decision == "no_match"
    stats = matching.statistics(matching.matched(r.limit(0), "a", "b")).first()
    assert stats.total == 0 and stats.auto_rate == 0.0


def test_search_fallback(spark):
    r = records(spark, [rec("s", "Zebra", "Quil", 1), rec("t", "Other", "Name", 2)])
    c = records(spark, [rec("n", "Zebra (Live)", "Quil", 2)]).withColumn("ord", F.lit(99).cast("long"))
    got = {x.source_id: x for x in matching.resolved(r, c, "a", "b").collect()}
    assert got["s"].decision == "auto" and got["s"].candidate_id == "n"


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (200, 201)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100} and got[201] == 200


def fold(rows):
    """The merge, one row after another."""
    out = []
    for r in rows:
        hit = None
        for key in ("a_id", "b_id", "code", "id"):
            if r.get(key):
                hit = next((o for o in out if o[key] == r[key]), None)
                if hit:
                    break
        if not hit:
            out.append(dict(r))
            continue
        for k in ("a_id", "b_id"):
            hit[k] = r[k] if r[k] is not None else hit[k]
        for k in ("title", "artist"):
            hit[k] = r[k] or hit[k]
        for k in ("album", "code"):
            hit[k] = hit[k] or r[k]
        hit["seconds"] = r["seconds"] if hit["seconds"] is None else hit["seconds"]
        hit["availability"] |= r["availability"]
    return out


def test_merge_is_the_fold(spark):
    rng, rows = random.Random(4), []
    for i in range(150):
        k = rng.randrange(40)
        side = rng.choice([1, 2])
        rows.append(rec(f"i{i}", f"T{k}.{i}", f"A{k}", side, a_id=f"a{k}" if side == 1 else None, b_id=f"b{k}" if side == 2 else None, code=f"c{k}", album=rng.choice([None, "", f"L{i}"]), seconds=rng.choice([None, i])))
    base = dict(album=None, code=None, seconds=None, a_id=None, b_id=None)
    want = {r["id"]: r for r in fold([base | r for r in rows])}
    got = {r.id: r for r in merging.merged(records(spark, rows)).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert all((got[k][c] or None) == (w[c] or None) for c in ("title", "artist", "album", "code", "seconds", "a_id", "b_id", "availability")), (k, got[k], w)


def test_memberships_follow_merges(spark):
    r = records(spark, [rec("x", "T", "A", 1, code="c"), rec("y", "T", "A", 2, code="c")])
    m = spark.createDataFrame([("l", "y", 0), ("l", "x", 1)], S.MEMBERS)
    assert {x.track_id for x in merging.follow(m, merging.renamed_ids(r)).collect()} == {"x"}


def lists(spark, rows):
    return spark.createDataFrame(rows, "id string, a_id string, b_id string, track_ids array<string>")


def test_list_ops(spark):
    s = lists(spark, [("new", "1", None, ["x"]), ("same", "2", "b2", ["x", "y"]), ("order", "3", "b3", ["y", "x"]), ("bysid", "4", "b4", ["x"]), ("unknown", "5", "b5", ["x"])])
    t = lists(spark, [("same", None, "b2", ["x", "y"]), ("order", None, "b3", ["x", "y"]), ("other", None, "b4", ["z"])])
    got = {r.entity_id: r.op for r in syncing.list_ops(s, t, "b").collect()}
    assert got == {"new": "create_list", "order": "update_members", "bysid": "update_members", "unknown": "update_members"}


def test_incremental_runs(spark):
    s = lists(spark, [("l", "1", None, ["x"])])
    ops = syncing.list_ops(s, s.limit(0), "b")
    state = syncing.digest_state(ops)
    assert syncing.changed_only(ops, state.limit(0)).count() == 1
    assert syncing.changed_only(ops, state).count() == 0
    again = syncing.list_ops(lists(spark, [("l", "1", None, ["x", "y"])]), s.limit(0), "b")
    assert [r.op for r in syncing.changed_only(again, state).collect()] == ["update_members"]


def test_resume_and_rollback(spark):
    ops = spark.createDataFrame([(f"update_members:b-l{i}:d",) for i in range(6)], "op_key string")
    log = spark.createDataFrame([("r", f"update_members:b-l{i}:d", "done" if i < 3 else "failed", '["a"]' if i != 1 else "no json", None, i, i) for i in range(4)], "run_id string, op_key string, status string, previous_track_ids string, error string, t long, ord long").withColumn("updated_at", F.timestamp_seconds("t"))
    assert syncing.remaining(ops, log, "r").count() == 3
    plan = syncing.rollback_plan(log, "r").collect()
    assert [(r.entity_id, r.members) for r in plan] == [("b-l2", ["a"]), ("b-l0", ["a"])]


def test_applied(spark):
    r = records(spark, [rec("x", "T", "A", 1)])
    ops = spark.createDataFrame([("add_track", "b", "x", None, "k"), ("remove_track", "a", "x", None, "k2")], "op string, service string, entity_id string, members array<string>, op_key string")
    assert syncing.applied_tracks(r, ops).first().availability == 3
    assert syncing.applied_tracks(r, ops, remove_clears=True).first().availability == 2
    new = spark.createDataFrame([("update_members", "b", "l", ["q"], "k")], ops.schema)
    once = syncing.applied_lists(lists(spark, [("l", None, "b", ["x"])]), new)
    assert [x.track_ids for x in syncing.applied_lists(once, new).collect()] == [["q"]]


def test_checkpoint_keeps_members(spark):
    cols = "run_id string, op_key string, status string, previous_track_ids string, error string, updated_at long"
    old = spark.createDataFrame([("r", "k", "failed", '["a"]', "e", 1), ("r", "z", "done", None, None, 1)], cols)
    new = spark.createDataFrame([("r", "k", "done", None, None, 2)], cols)
    got = {x.op_key: x for x in stores.checkpoint_upsert(old, new).collect()}
    assert (got["k"].status, got["k"].previous_track_ids, got["k"].error) == ("done", '["a"]', None) and len(got) == 2


def test_lists_round_trip(spark):
    heads = spark.createDataFrame([("l", "n"), ("e", "m")], "id string, name string")
    none = spark.createDataFrame([], S.MEMBERS)
    new = spark.createDataFrame([("l", "n2", ["b", "a", "b"])], "id string, name string, track_ids array<string>")
    h, m = stores.save_lists(heads, none, new)
    got = {r.id: (r.name, r.track_ids) for r in stores.lists_with_members(h, m).collect()}
    assert got == {"l": ("n2", ["b", "a", "b"]), "e": ("m", [])}


def test_histogram_is_dense(spark):
    o = spark.createDataFrame([(None, "auto", 1.0), (None, "auto", 0.0), ("r", "no_match", None)], "run_id string, decision string, top_score double")
    got = metrics.confidence_histogram(o, 4).collect()
    assert [(r.run_id, r.bucket, r.n) for r in got] == [("(none)", 0, 1), ("(none)", 1, 0), ("(none)", 2, 0), ("(none)", 3, 1)]


def test_latest_resumable_looks_at_the_last_run_only(spark):
    runs = spark.createDataFrame([("a", 1, "failed"), ("b", 2, "completed")], "id string, started_at long, status string")
    assert stores.latest_resumable(runs).count() == 0
    assert stores.latest_resumable(runs.where("id = 'a'")).first().id == "a"


def test_components_of_many_shares(spark):
    """Three edges a share, so that the rounds after the contraction are used."""
    from concord.operators.components import connected_components

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 150)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), share=3).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100), 150: 150, 200: 150}


def test_lists_take_the_last_operation(spark):
    from concord.operators.syncing import applied_lists

    lists = spark.createDataFrame([("l", ["a"])], "id string, track_ids array<string>")
    ops = spark.createDataFrame([("l", ["b"], "z", 1), ("l", ["c"], "a", 2)], "entity_id string, members array<string>, op_key string, ord long")
    assert applied_lists(lists, ops).first().track_ids == ["c"]


def test_retry_after():
    from concord.sources.sinks import retry_after

    assert retry_after("12") == 12 and retry_after("Thu, 01 Jan 1970 00:01:40 GMT", 40.0) == 60 and retry_after(None) is retry_after("soon") is None


def test_difference_against_known_lists(spark):
    r = records(spark, [rec("x", "T", "A", 1)])
    own = lists(spark, [("l", "1", "2", ["x"]), ("m", "1", "3", ["x"])])
    state = spark.createDataFrame([], "service string, list_id string, digest string")
    known = {"b": lists(spark, [("l", None, "2", ["x"])])}
    ops = lambda **more: sorted((o.service, o.entity_id) for o in syncing.compute_diff(r, own, state, **more).where("members is not null").collect())
    assert ops() == [("a", "l"), ("a", "m"), ("b", "l"), ("b", "m")]
    assert ops(target_lists=known) == [("a", "l"), ("a", "m"), ("b", "m")] and ops(direction="a>b", target_lists=known) == [("b", "m")]


def test_alike_sources_are_decided_once(spark, monkeypatch):
    """Sources with the same keys and length have the same candidates; a reject parts one from the others."""
    rows = [(i, f"s{i}", "one song", "some band", "lp", None, 200, f"x{i}", None, 1) for i in range(60)]
    rows += [(60 + i, f"u{i}", "one song", "some band", None, None, None, f"y{i}", None, 1) for i in range(20)]
    rows += [(90, "t0", "one song", "some band", "lp", None, 200, None, "z0", 2), (91, "t1", "one sons", "some band", "lp", None, 200, None, "z1", 2)]
    every = spark.createDataFrame(rows, "ord long, id string, title string, artist string, album string, code string, seconds long, a_id string, b_id string, availability int")
    excluded = spark.createDataFrame([("s7", "b", "reject", "t0")], "track_id string, target_service string, kind string, candidate_id string")
    scored, plain = [], matching.decided

    def counted(sources, *more):
        scored.append(sources.count())
        return plain(sources, *more)

    monkeypatch.setattr(matching, "decided", counted)
    got = {r.source_id: r for r in matching.matched(every, "a", "b", exclusions=excluded).collect()}
    assert scored == [3] and len(got) == 80
    assert {r.candidate_id for i, r in got.items() if i != "s7"} == {"t0"} and got["s7"].candidate_id == "t1"
    assert got["u3"].score < got["s3"].score == 1.0 and got["u3"].ord == 63
