"""Quantiles, evaluation and merges against plain Python."""

import math
import random

import pytest

from concord.operators import metrics


def quantiles(values):
    v, n = sorted(values), len(values)
    return (n, v[0], v[-1], v[n // 2], v[int(n * 0.95)], v[int(n * 0.99)])


@pytest.mark.parametrize("few", [3, 100_000])
def test_timers_equal_sorted_lists(spark, few):
    rng = random.Random(few)
    data = {
        "even": [rng.random() for _ in range(500)], "equal": [2.5] * 300, "one": [7.0], "two": [1.0, 2.0],
        "far": [rng.random() for _ in range(400)] + [1e12, -1e12], "ties": [float(rng.randrange(4)) for _ in range(333)], "tiny": [1.0, math.nextafter(1.0, 2.0)] * 50, "open": [1.0] * 60 + [2.0, math.inf],
    }
    rows = [(name, v) for name, vs in data.items() for v in vs] + [("even", None), (None, 1.0), ("two", math.nan)]
    rng.shuffle(rows)
    got = metrics.timer_statistics(spark.createDataFrame(rows, "name string, value double").repartition(5), cells=16, few=few).collect()
    assert {r["name"]: (r["count"], r["min"], r["max"], r["p50"], r["p95"], r["p99"]) for r in got} == {name: quantiles(vs) for name, vs in data.items()}
    assert metrics.timer_statistics(spark.createDataFrame([], "name string, value double")).count() == 0


def test_timers_of_one_name_use_all_tasks(spark):
    rows = spark.range(200_000, numPartitions=8).selectExpr("'all' AS name", "CAST(id * 7919 % 200000 AS DOUBLE) AS value")
    r = metrics.timer_statistics(rows, few=1000).first()
    assert (r["count"], r["min"], r["max"], r["p50"], r["p95"], r["p99"]) == (200_000, 0.0, 199_999.0, 100_000.0, 190_000.0, 198_000.0)


def test_evaluation_at_every_threshold(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["x", "y", None]), rng.choice([None, rng.random(), 0.0, 1.0]), rng.choice([True, False, None])) for _ in range(400)]
    got = {(r.category, round(r.threshold, 6)): r for r in metrics.evaluation_curve(spark.createDataFrame(rows, "c string, s double, t boolean"), "c", "s", "t", 10).collect()}
    assert len(got) == 4 * 11
    for (category, threshold), r in got.items():
        own = [(s, bool(t)) for c, s, t in rows if category is None or (c or "(none)") == category]
        hit = [t for s, t in own if s is not None and math.floor(s * 10) >= round(threshold * 10)]
        tp, fp, fn = sum(hit), len(hit) - sum(hit), sum(t for _, t in own) - sum(hit)
        assert (r.tp, r.fp, r.fn) == (tp, fp, fn) and r.precision == (tp / (tp + fp) if hit else None) and r.recall == tp / (tp + fn)


def longest(a, b):
    if not a or not b:
        return 0
    return 1 + longest(a[1:], b[1:]) if a[0] == b[0] else max(longest(a[1:], b), longest(a, b[1:]))


def in_order(part, whole):
    it = iter(whole)
    return all(x in it for x in part)


def test_merges_of_short_lists():
    from collections import Counter

    from concord.operators.list_merging import in_both_orders, labelled, merge

    rng = random.Random(9)
    for _ in range(3000):
        a, b, c = (labelled([rng.choice("wxyz") for _ in range(rng.randint(0, 6))]) for _ in range(3))
        chain = in_both_orders(a, b)
        assert len(chain) == longest(a, b) and in_order(chain, a) and in_order(chain, b)
        for base, both in (([], False), (c, False), (None, True)):
            out = merge(a, b, base, both)
            A, B, C = set(a), set(b), set(base or [])
            stays = (A & B) if both else {x for x in A | B if (x in A and x in B) or x not in C}
            assert Counter(out) == Counter(stays)
            kept = in_both_orders([x for x in a if x in stays], [x for x in b if x in stays])
            assert in_order(kept, out) and in_order([x for x in a if x in stays and (x in kept or x not in B)], out) and in_order([x for x in b if x in stays and (x in kept or x not in A)], out)
    assert merge(list("abc"), list("axc"), list("abc"), False) == list("axc") and merge(list("ab"), list("cab"), [], False) == list("cab")


def test_merged_lists(spark):
    from concord.operators.list_merging import merged_lists

    side = lambda *rows: spark.createDataFrame(list(rows), "id string, track_ids array<string>")
    ours, theirs = side(("1", ["a", "b", "a", None]), ("2", ["x"]), ("3", None)), side(("1", ["b", "c"]), ("4", ["q"]))
    got = {r.id: (r.track_ids, r.added, r.removed) for r in merged_lists(ours, theirs).collect()}
    assert got == {"1": (["a", "b", "a", "c"], 1, 0), "2": (["x"], 0, 0), "3": ([], 0, 0), "4": (["q"], 1, 0)}
    got = {r.id: (r.track_ids, r.added, r.removed) for r in merged_lists(ours, theirs, side(("1", ["a", "b"]))).collect()}
    assert got["1"] == (["b", "a", "c"], 1, 1)
    assert {r.id: r.track_ids for r in merged_lists(ours, theirs, how="intersection").collect()} == {"1": ["b"], "2": [], "3": [], "4": []}
    assert merged_lists(ours.limit(0), theirs.limit(0)).count() == 0
