"""Fingerprints against all pairs at all shifts."""

import random

import pytest
from pyspark.sql import functions as F

from concord.operators import fingerprints as fp

FRAMES = "id string, frames array<int>"


def signed(x):
    return x - (1 << 32) if x >= 1 << 31 else x


def equal(a, b, shift):
    at = [i for i in range(len(a)) if 0 <= i + shift < len(b)]
    return len(at), 1 - sum(bin((a[i] ^ b[i + shift]) & 0xFFFFFFFF).count("1") for i in at) / (32 * len(at)) if at else 0


def all_pairs(source, target, s):
    out = {}
    for i, a in source.items():
        for j, b in target.items():
            found = [(-e, abs(k), k) for k in range(-len(a), len(b)) for n, e in [equal(a, b, k)] if n >= s.overlap and e >= s.alike]
            if found:
                out[i, j] = min(found)[2], -min(found)[0]
    return out


@pytest.fixture(scope="module")
def data():
    rng = random.Random(8)
    frame = lambda: signed(rng.getrandbits(32))
    target = {f"t{i}": [0] * 5 + [frame() for _ in range(40)] + [0] * 5 for i in range(40)}  # silence at both ends
    noisy = lambda x, p: signed((x & 0xFFFFFFFF) ^ sum(1 << b for b in range(32) if rng.random() < p))
    source = {f"s{i}": [noisy(x, rng.choice([0.0, 0.03, 0.08])) for x in target[f"t{i}"][rng.randint(0, 12) : rng.randint(30, 50)]] for i in range(30)}
    source |= {f"x{i}": [frame() for _ in range(30)] for i in range(10)} | {"silent": [0] * 20}
    return source, target


def test_recall_against_all_pairs(spark, data):
    source, target = data
    s = fp.Settings()
    got = {(r.source_id, r.target_id): (r["shift"], r["equal"]) for r in fp.alike(*(spark.createDataFrame(list(x.items()) + [("null", None), ("empty", [])], FRAMES) for x in data)).collect()}
    want = all_pairs(source, target, s)
    assert set(got) <= set(want) and len(want) >= 30
    assert sum(k in got for k in want) / len(want) >= 0.95
    assert sum(got[k][0] == want[k][0] for k in got) / len(got) >= 0.95 and all(got[k][1] <= want[k][1] + 1e-12 for k in got)


def test_stage_decides_only_what_is_open(spark, data):
    rows = [(1, "s0", "no_match", None, None, None, None), (2, "s1", "auto", "fuzzy", "t9", 0.9, [("t9", 0.9)]), (3, "x0", "no_match", None, None, None, None)]
    d = spark.createDataFrame(rows, "ord long, source_id string, decision string, method string, candidate_id string, score double, candidates array<struct<candidate_id:string,score:double>>")
    source, target = (spark.createDataFrame(list(x.items()), FRAMES) for x in data)
    got = {r.source_id: (r.decision, r.method, r.candidate_id) for r in fp.fingerprint_stage(d, source, target).collect()}
    assert got == {"s0": ("auto", "fingerprint", "t0"), "s1": ("auto", "fuzzy", "t9"), "x0": ("no_match", None, None)}
    assert fp.alike(source.limit(0), target).count() == 0 and fp.fingerprint_stage(d, source, target).columns == d.columns


def test_outcomes_of_a_run_written_again(spark, tmp_path):
    from concord.operators.stores import append_outcomes, latest

    rows = lambda *r: spark.createDataFrame(list(r), "run_id string, source_track_id string")
    path = str(tmp_path / "o")
    append_outcomes(rows(("r1", "a"), ("r1", "b"), ("r2", "a"), (None, "z")), path)
    append_outcomes(rows(("r1", "a"), (None, "z")), path)
    assert sorted(map(repr, ((r.run_id, r.source_track_id) for r in spark.read.parquet(path).collect()))) == sorted(map(repr, [("r1", "a"), ("r2", "a"), (None, "z"), (None, "z")]))
    assert latest(rows(("k", "a"), ("k", "b")), ["run_id"], F.lit(1)).first().source_track_id == "b"
