"""Periodic runs, importance resampling, languages: against brute force, SQL and held-out labels."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from concord.llm import languages, periodic, queries, resampling

DOCS = "doc_id long, text string, lang string, junk array<int>, n_runs string, score string"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def docs(spark, texts, langs=None, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, x, [1], "clash", "clash") for i, t, x in zip(ids, texts, langs or [None] * len(texts))]
    return spark.createDataFrame(rows, DOCS)


# ---- periodic runs


def all_runs(s, least=6, times=4):
    out = []
    for q in range(1, len(s) // times + 1):
        i = 0
        while i + q < len(s):
            a = i
            while i + q < len(s) and s[i] == s[i + q]:
                i += 1
            size, w = i - a + q, s[a : i + q]
            if i > a and size >= max(least, times * q) and all(any(w[x] != w[x + r] for x in range(size - r)) for r in range(1, q)):
                out.append((a, size, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def odd_words(rng):
    s = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(0, 70))]
    for _ in range(rng.randint(0, 3) if s else 0):
        a, p = rng.randrange(len(s)), rng.randint(1, 9)
        s = s[:a] + s[a : a + p] * rng.randint(1, 8) + s[a + rng.randint(0, 5) :]
    return s


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(600):
        s = odd_words(rng)
        assert periodic.word_runs([s, [], s[::-1]]) == [all_runs(s), [], all_runs(s[::-1])]
        assert periodic.stretch_runs(np.array([int(x) for x in s], np.int64), 4, 3) == all_runs(s, 4, 3)


def test_runs_survive_useless_hashes(monkeypatch):
    monkeypatch.setattr(periodic.Extensions, "alike", lambda self, i, j, k: True)
    rng = random.Random(6)
    for _ in range(150):
        s = np.array([rng.randrange(3) for _ in range(rng.randint(6, 60))], np.int64)
        assert periodic.stretch_runs(s) == all_runs(s.tolist())


def test_long_runs_take_little_time():
    n = 100_000
    assert periodic.word_runs([[b"a"] * n, [b"a", b"b"] * (n // 2)]) == [[(0, n, 1)], [(0, n, 2)]]


def expected_row(doc_id, text):
    h, words = zlib.crc32(str(doc_id).encode() if doc_id is not None else b""), [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    more = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *more, digest("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_documents(spark, sf, monkeypatch):
    monkeypatch.setattr(periodic, "WORDS", 100)
    rng = random.Random(7)
    texts = [" ".join(x.decode() for x in odd_words(rng)) for _ in range(300)] + [None, "", " \t\n", "a\x0bb c d", "x " * 500, "é ü " * 40]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500").limit(60).collect()]
    ids = [*range(len(texts) - 2), None, 3]
    got = sorted(map(tuple, periodic.periodic_runs(docs(spark, texts, ids=ids), words_of=periodic.planted_words).collect()), key=repr)
    assert got == sorted((expected_row(i, t) for i, t in zip(ids, texts)), key=repr)
    assert sum(r[1] for r in got) > 100
    assert periodic.periodic_runs(docs(spark, [])).count() == 0


# ---- importance resampling


def brute_sample(rows, goal, s):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))

    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % s.buckets for k in range(1, s.longest + 1) for i in range(len(w) - k + 1)]

    own, target = (collections.Counter(b for t in side for b in features(t)) for side in ([t for _, t in rows], goal))
    a, b = own.total() + s.buckets, target.total() + s.buckets
    out = []
    for i, t in rows:
        f = features(t)
        weight = sum(math.floor(1000 * math.log((target[x] + 1) * a / ((own[x] + 1) * b))) for x in f)
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(t))))
    able = sorted((r for r in out if r[4] >= s.least_words), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    rank = {}
    for k, r in enumerate(able[: len(able) * s.percent // 100]):
        rank.setdefault(r[:4], []).append(k + 1)
    return sorted(((*r[:4], rank[r[:4]].pop(0) if rank.get(r[:4]) else None) for r in out), key=repr)


@pytest.mark.parametrize("longest", [1, 3])
def test_sample_equals_brute_force(spark, monkeypatch, longest):
    monkeypatch.setattr(resampling, "WORDS", 60)
    rng = random.Random(longest)
    vocabulary = ["a", "B", "ab", "Éa", "x1", "日本", "zz"]
    text = lambda: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))
    rows = [(i, text()) for i in range(120)] + [(7, None), (None, ""), (3, "a " * 3000), (None, "b " * 30), (9, "--- ..."), *[(5, "ab " * 25)] * 3]
    goal, s = [text() for _ in range(9)] + [None], resampling.Settings(longest=longest, buckets=50, least_words=5)
    target = spark.createDataFrame([(t, "x") for t in goal], "text string, bucket string")
    got = resampling.resampled(docs(spark, [t for _, t in rows], ids=[i for i, _ in rows]), target, s)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_sample(rows, goal, s)


def test_sample_of_no_rows(spark):
    none = docs(spark, [])
    assert resampling.resampled(none, none).count() == 0
    got = resampling.resampled(docs(spark, ["a b " * 20] * 30), none).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3] and {r.n_features for r in got} == {40}


def test_suffix_order():
    rng = random.Random(3)
    for depth in (1, 2, 3, 5):
        ids = np.array([rng.randrange(4) for _ in range(80)], np.int64)
        order, s = resampling.suffix_order(ids, depth), ids.tolist()
        assert [s[i : i + depth] for i in order] == sorted(s[i : i + depth] for i in range(80))
        want = [0] + [next((k for k in range(depth) if max(a, b) + k >= 80 or s[a + k] != s[b + k] or not s[a + k]), depth) for a, b in itertools.pairwise(order.tolist())]
        assert resampling.common_prefixes(ids, order, depth).tolist() == want


def test_sample_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(queries.ORACLES["op12_resampling"]).df()
    got = queries.QUERIES["op12_resampling"](spark, sf).toPandas()
    values = lambda df: sorted(df[sorted(df.columns)].astype("float64").fillna(-1.0).values.tolist())
    assert values(got) == values(want) and got["rank"].notna().sum() > 5


# ---- languages


def every_segmentation(word, p, ids):
    if not word:
        return 1.0
    return sum(p[ids[word[:k]]] * every_segmentation(word[k:], p, ids) for k in range(1, len(word) + 1) if word[:k] in ids)


def test_forward_sums_all_segmentations():
    pieces, rng = languages.Pieces.load(PIECES), np.random.default_rng(1)
    table = rng.random((pieces.size, 3)) ** 4 / pieces.size
    words = [w.encode() for w in ("▁the", "▁unbe", "é", "日", "▁\x00", "🙂", "aaaaa")]
    got = languages.log_probabilities(words, table, pieces)
    for w, row in zip(words, got):
        for lang in range(3):
            assert math.isclose(row[lang], math.log(every_segmentation(w, table[:, lang], pieces.ids)), rel_tol=1e-9)


def test_expected_counts_cover_the_text():
    pieces = languages.Pieces.load(PIECES)
    words, n, lang = [b"the", b"theory", "▁été".encode()], np.array([3.0, 1.0, 2.0]), np.array([0, 1, 0])
    counts = languages.expected_counts(words, n, lang, np.full((pieces.size, 2), 1 / pieces.size), pieces)
    size = np.zeros(pieces.size)
    for piece, i in pieces.ids.items():
        size[i] = len(piece)
    assert np.allclose(size @ counts, [3 * 3 + 2 * len(words[2]), 6])  # each byte of each copy is in one piece


def test_stretches():
    text = "Ab! " + "É" * 100 + " 日本語" * 3 + " l'e\u0301t3_x ... 12"
    parts = languages.stretches(languages.text_words(text), 32)
    assert b"".join(parts).decode() == "▁ab▁" + "é" * 100 + "▁日本語" * 3 + "▁l▁e\u0301t▁x" and max(map(len, parts)) <= 32
    assert all(p.decode() for p in parts)


def test_languages_of_held_out_texts(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = languages.predicted_languages(d, PIECES).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == d.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_texts_and_languages(spark):
    en, de = "the cat and the dog in the house with it ", "der hund und die katze mit dem haus nicht "
    texts = [en * 3, de * 3] * 20 + [None, "", "123 !!", "x" * 500_000, "the", "Der Hund", "日本語" * 2000, en, en]
    langs = ["en", "de"] * 20 + ["en", "de", None, "en", None, "de", None, None, None]
    ids = [*range(47), None, 1]
    got = languages.predicted_languages(docs(spark, texts, langs, ids), PIECES).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.lang_pred, r.score))
    assert len(got) == len(texts) and by[40] == by[41] == by[42] == [("und", 0.0)]
    assert by[44][0][0] == "en" and by[45][0][0] == "de" and by[None][0][0] == "en" and [x for x, _ in by[1]].count("en") == 1
    assert by[43][0][0] in ("en", "de") and by[46][0][0] in ("en", "de")
    assert {(r.lang_pred, r.score) for r in languages.predicted_languages(docs(spark, texts), PIECES).collect()} == {("und", 0.0)}
    assert languages.predicted_languages(docs(spark, []), PIECES).count() == 0


def test_sample_of_training_rows_is_bounded(spark):
    s = languages.Settings(sample=10)
    texts = [f"w{i}" for i in range(300)] + ["same"] * 600
    words = languages.training_words(docs(spark, texts, ["en"] * 900, [i if i < 300 else 1000 for i in range(900)]), s).collect()
    assert sum(r.n for r in words) == 10
