"""Operators on whole corpora: near and exact copies, repeated strings, mixing, neighbours, the pipeline."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from concord.llm import exact, mixing, near, neighbours, queries, repeats

DOCS = "doc_id long, text string, node string, source string"
BLANK = [(None, None), (None, ""), (7, "same"), (7, "same"), (8, "SAME"), (9, "é"), (10, "É")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", f"s{(i or 0) % 3}" if i else None) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def variants(n, words, edits, seed=5):
    """A text, and copies of it with random words replaced, dropped and inserted."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(1, edits)):
            k, i = rng.randrange(3), rng.randrange(len(own))
            own[i : i + (k < 2)] = [f"x{rng.randrange(9999)}"] if k != 1 else []
        out.append(" ".join(own))
    return out


def brute_classes(rows, s=near.Settings()):
    known, nodes = near.Words(), {}
    for i, t in rows:
        key, w = near._words(t, known)
        nodes.setdefault(key, (near.kmers(w, s.k), []))[1].append(i)
    nodes, parent = list(nodes.values()), {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    sets = [set(h.tolist()) for h, _ in nodes]
    for a in range(len(nodes)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.44 * (len(sets[a]) + len(sets[b])) > 0 and near.linked(nodes[a][0], nodes[b][0], s):
                parent[find(a)] = find(b)
    out = collections.defaultdict(list)
    for x, (_, own) in enumerate(nodes):
        out[find(x)].extend(own)
    return [sorted(v, key=lambda i: (i is None, i)) for v in out.values()]


@pytest.mark.parametrize("edits", [4, 14])
def test_near_classes(spark, corpus, edits):
    rows = corpus[:80] + [(1000 + i, t) for i, t in enumerate(variants(60, 150, edits))] + [(2000 + i, t.upper() + "!") for i, t in enumerate(variants(20, 30, 2, 6))] + BLANK
    classes = brute_classes(rows)
    got = near.near_classes(docs(spark, rows)).collect()
    want = collections.Counter((i, v[0], len(v)) for v in classes for i in v)
    assert collections.Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    assert max(map(len, classes)) > 15
    kept = near.drop_near_copies(docs(spark, rows))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ") and kept.count() == len(classes)


def test_near_classes_of_nothing(spark):
    assert near.near_classes(docs(spark, [])).count() == 0
    got = near.near_classes(docs(spark, [(1, "a b"), (2, "A, b"), (3, "a b c d e " * 4000)])).collect()
    assert {(r.doc_id, r.class_id, r.class_size) for r in got} == {(1, 1, 2), (2, 1, 2), (3, 3, 1)}


def test_alignment_keeps_order():
    rng, s = np.random.default_rng(2), near.Settings()
    w = rng.integers(0, 2**32, 400, dtype=np.uint32)
    moved = np.concatenate([w[200:], w[:200]])
    assert near.linked(near.kmers(w, 5), near.kmers(w, 5), s) and not near.linked(near.kmers(w, 5), near.kmers(moved, 5), s)


def test_exact_groups(spark, corpus):
    rows = corpus + BLANK + [(5000 + i, "Hot TEXT") for i in range(300)]
    fold = lambda t: (t or "").translate(str.maketrans(exact.UPPER, exact.LOWER))
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[fold(t)].append(i)
    best = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    want = collections.Counter((i, best[fold(t)], len(groups[fold(t)]), i == best[fold(t)], hashlib.sha256(fold(t).encode()).hexdigest()) for i, t in rows)
    d = docs(spark, rows)
    assert collections.Counter(map(tuple, exact.exact_groups(d).collect())) == want
    kept = exact.drop_copies(d)
    assert kept.columns == d.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, best.values()))
    assert exact.exact_groups(d.limit(0)).count() == 0 and exact.drop_copies(d.limit(0)).count() == 0


def test_exact_dedup_is_its_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = duck.execute(queries.ORACLES["op7_exact_dedup"]).fetchall()
    assert sorted(map(tuple, queries.QUERIES["op7_exact_dedup"](spark, sf).collect())) == sorted(want)


def brute_cut(texts, n):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        yield len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()


@pytest.mark.parametrize("hot", [5000, 3])
def test_repeated_strings(spark, corpus, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdef é") for _ in range(260))
    noise = lambda n: "".join(rng.choice("ghijklm ") for _ in range(n))
    rows = corpus[:150] + BLANK + [(3000 + i, noise(rng.randint(0, 300)) + passage[rng.randint(0, 40) : rng.randint(200, 260)] + noise(rng.randint(0, 300))) for i in range(60)]
    rows += [(4000, "x" * 900), (4001, "ab" * 150), (4002, "ab" * 99), (4003, "q" * 199), (4004, "é" * 150), (4005, passage), (4005, passage), (None, passage)]
    want = collections.Counter((i, *o) for (i, _), o in zip(rows, brute_cut([t for _, t in rows], 200)))
    assert collections.Counter(map(tuple, repeats.removed(docs(spark, rows)).collect())) == want
    if hot == 3:
        assert repeats.removed(docs(spark, [])).count() == 0
        assert {r.doc_id: r.text for r in repeats.cleaned(docs(spark, [(1, passage + "tail"), (2, passage)])).collect()} == {1: "tail", 2: ""}


def edf(shares, slots):
    """The schedule, one slot after another."""
    done, out = [0] * len(shares), []
    for t in range(slots):
        ready = [(-(-(done[i] + 1) * slots // w), -w, i) for i, w in enumerate(shares) if done[i] * slots // w <= t]
        out.append(min(ready)[2])
        done[out[-1]] += 1
    return out


def test_schedule(spark):
    rng = random.Random(9)
    for _ in range(4):
        shares = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        total = sum(shares)
        table = spark.createDataFrame([(f"k{i}", w, total) for i, w in enumerate(shares)], "class string, share long, total long")
        rows = sorted(mixing.schedule(table).collect(), key=lambda r: r.slot)
        picks = [int(r["class"][1:]) for r in rows]
        assert picks == edf(shares, total)
        for t in range(1, total + 1):  # less than a block more or less than the weight asks for, at every slot
            assert all(abs(picks[:t].count(i) - t * w / total) < 1 for i, w in enumerate(shares))


def test_mixing(spark):
    rows = [(i, "x" * 10, "clash", "hot" if i % 3 else "b") for i in range(900)] + [(None, None, None, None)] * 3
    d = spark.createDataFrame(rows, DOCS).repartition(4)
    got = mixing.mixed(d, block=20, slots=100, weights={"hot": 0.5, "b": 0.5}).collect()
    assert len(got) == len(rows) and all(r.slot is None and not r.in_mix for r in got if r.source is None)
    first = sorted({(r.slot, r.source) for r in got if r.source})
    assert len({s for s, _ in first}) == len(first)  # a block for a slot
    for t in range(1, 300):
        assert abs(sum(s == "hot" for _, s in first[:t]) - t / 2) < 1
    blocks = collections.Counter((r.source, r.block) for r in got if r.source)
    assert max(blocks.values()) == 2
    natural = mixing.mixed(d, block=20, slots=50, alpha=1.0)
    assert natural.count() == len(rows) and natural.where("in_mix").count() > 0.9 * len(rows)
    assert mixing.mixed(d.limit(0)).count() == 0
    clash = d.selectExpr("*", "1 AS slot", "2 AS in_mix", "3 AS row")
    part = mixing.mixture(clash, block=20, slots=50, alpha=1.0)
    assert part.columns == clash.columns and part.count() == natural.where("in_mix").count()


def test_mixing_of_many_sources(spark):
    """10,000 sources, a third of the ids null: every block has a slot of its own, and each source is within a block of its weight."""
    rng = random.Random(12)
    rows = [(i if i % 3 else None, "x" * rng.choice([1, 30, 200]), "clash", f"s{i % 10_000}" if i % 4 else "hot") for i in range(30_000)]
    d = spark.createDataFrame(rows, DOCS).repartition(4)
    got = mixing.mixed(d, block=100, slots=1000, alpha=0.7).collect()
    assert collections.Counter((r.doc_id, r.source) for r in got) == collections.Counter((i, s) for i, _, _, s in rows)
    place = {}
    for r in got:
        assert place.setdefault((r.source, r.block), r.slot) == r.slot
    assert len(set(place.values())) == len(place)
    volume = collections.Counter()
    for _, t, _, s in rows:
        volume[f"s{s}"] += len(t)
    volumes = spark.createDataFrame(list(volume.items()), "skey string, volume long")
    sources = mixing.source_classes(volumes, None, 0.7)
    shares = {r["class"]: (r.share, r.total, r.members) for r in mixing.class_shares(sources, 1000).collect()}
    kind = {r.skey: r["class"] for r in sources.collect()}
    for (s, block), slot in place.items():
        share, total, members = shares[kind[f"s{s}"]]
        w = share / total / members
        assert abs(block - slot * w) < 1 and abs(block + 1 - (slot + 1) * w) < 1, (s, block, slot, w)
    want = {k: v**0.7 / sum(x**0.7 for x in volume.values()) for k, v in volume.items()}
    share, total, members = shares[kind["shot"]]
    assert share / total / members == pytest.approx(want["shot"], rel=0.1)


def test_mixing_stage_keeps_all_in_order(spark, tmp_path):
    rows = [(i, f"{i:05d} " * 500, "clash", "hot" if i < 400 else f"s{i % 19}") for i in range(1200)] + [(None, None, None, None)] * 3
    d = spark.createDataFrame(rows, DOCS).repartition(4)
    place = {r.doc_id: r.slot for r in mixing.mixed(d, alpha=0.7).collect()}
    assert mixing.mixed(d, alpha=0.7).where("NOT in_mix").count() > 100  # the stage used to drop these
    out = corpus_pipeline.mix_sources(spark, d, "")
    assert out.columns == d.columns
    out.write.parquet(f"{tmp_path}/mix")
    found = [r for f in sorted(tmp_path.glob("mix/part-*")) for r in spark.read.parquet(str(f)).coalesce(1).collect()]
    assert collections.Counter(map(tuple, found)) == collections.Counter(rows)
    slots = [place[r.doc_id] for r in found]
    assert slots == sorted(slots) and len(set(slots)) > 100
    some = mixing.interleaved(d, weights={"hot": 1.0}).collect()  # the others have no slot
    assert len(some) == len(rows) and [r.source == "hot" for r in some] == [True] * 400 + [False] * 803


def test_packing_follows_the_mixture(spark):
    """The sequences come in the order of the mixing stage: its first documents are in the first ones, and other orders give other sequences."""
    rows = [(i, f"{i:05d} " + "word " * (900 + i % 5 * 200), "clash", f"s{i % 3 if i < 300 else 0}") for i in range(600)]
    d = spark.createDataFrame(rows, DOCS).repartition(4)

    def packed(docs):
        docs = corpus_pipeline.stored(docs, "order")
        by = collections.defaultdict(set)
        for r in corpus_pipeline.pack_sequences(spark, docs, "").collect():
            by[r.sequence_id].add(r.doc_id)
        return by, [r.doc_id for r in docs.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]

    by, order = packed(corpus_pipeline.mix_sources(spark, d, ""))
    place = {i: n for n, i in enumerate(order)}
    first = [min(map(place.get, by[k])) for k in range(len(by))]
    assert first[0] == 0 and first == sorted(first) and set(by) == set(range(len(by)))
    other, _ = packed(d.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id"))
    assert len(other) == len(by) and sorted(map(sorted, other.values())) != sorted(map(sorted, by.values()))


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[300:700] = x[300]  # a third are copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (None, x[0].tolist()), (2100, x[1].tolist()), (2100, x[1].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    s = neighbours.Settings(block=100, sample=800, probes=15)
    got = collections.defaultdict(list)
    for r in neighbours.nearest_vectors(table, s=s).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    every = np.concatenate([x, x[1:2], x[1:2]]).astype(float)
    ids = np.array([*range(1500), 2100, 2100])
    assert set(got) == {i for i in range(0, 1500, 100)} | {2100}
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((every - every[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(abs(score - d[ids == v][0]) < 1e-9 for _, v, score in found)
        assert found == sorted(found, key=lambda f: (f[2], f[1])) or [f[2] for f in found] == sorted(f[2] for f in found)
        hits += len({v for _, v, _ in found} & set(ids[best].tolist()))
    assert hits >= 0.9 * 10 * len(got)
    assert [v for _, v, _ in got[300]] == list(range(301, 311))  # ties go to the smaller id
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [9.0, 9.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in neighbours.nearest_vectors(few).orderBy("rank").collect()] == [(0, 1, 1.0), (0, 2, pytest.approx(113**0.5))]
    assert neighbours.nearest_vectors(few.limit(0)).count() == 0


def test_neighbours_of_all_lengths(spark):
    """Lengths over many orders of magnitude: long residuals say nothing about the codes of short ones."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(8000, 64))
    x *= np.exp(2 * rng.normal(size=(8000, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    got = collections.defaultdict(set)
    for r in neighbours.nearest_vectors(table).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 8000, 100):
        d = ((x.astype(float) - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.97 * 10 * 80, hits / 800


def test_close_groups_leave_far_bars_alone(spark):
    """Some queries have neighbours that are nearly copies, all others only far ones, whose bars decide how many pairs are measured."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(12_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 12_000, 1000):
        x[q + 1 : q + 12] = x[q] + 0.01 * rng.normal(size=(11, 64))
    x, figures = x.astype(np.float32), {}
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    got = collections.defaultdict(set)
    for r in neighbours.nearest_vectors(table, figures=figures).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 12_000, 100):
        d = ((x.astype(float) - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.95 * 10 * 120, hits / 1200
    assert figures["pairs measured"] < 120 * 100, figures


def test_pipeline(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "'x' AS score", "1 AS slot", "2 AS component")  # names that operators use
    kept = [d]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(corpus_pipeline.stored(stage(spark, kept[-1], sf), name))
        assert kept[-1].columns == d.columns
    by = [[(r.doc_id, r.text) for r in k.collect()] for k in kept]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {i for i, _ in by[1]}
    assert np.mean([(i in left) == bool(q) for i, q in labels.items()]) > 0.95
    fold = lambda t: t.translate(str.maketrans(exact.UPPER, exact.LOWER))
    assert len(by[2]) == len({fold(t) for _, t in by[1]})
    assert sorted(i for i, _ in by[3]) == sorted(v[0] for v in brute_classes(by[2]))
    assert set(by[4]) <= set(by[3]) and len(by[4]) > 0.8 * len(by[3])
    rows = corpus_pipeline.STAGES[-1][1](spark, kept[-1], sf).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in by[4]}
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf).drop("sequence_id", "offset").collect()} == {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows}
