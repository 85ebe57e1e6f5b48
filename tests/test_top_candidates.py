"""The best candidates under words that very many names share, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from concord.functions import grams
from concord.functions.similarity import Policy
from concord.operators import matching

WORDS = "red blue green black white gold".split()
COLUMNS = "ord long, id string, title_key string, artist_key string, album_key string, code_key string, seconds long"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, before + (x != y))
    return row[-1]


def sim(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if a in b or b in a:
        return min(len(a), len(b)) / max(len(a), len(b))
    return 1.0 - edits(a, b) / max(len(a), len(b))


def best_pairs(source, target, p):
    df = {}
    for _, _, artist in target:
        for w in set(artist.split()):
            df[w] = df.get(w, 0) + 1
    out = []
    for o, title, artist in source:
        known = sorted((df[w], w) for w in set(artist.split()) if w in df)
        use = {w for i, (n, w) in enumerate(known) if i == 0 or n <= p.common_word}
        scored = sorted((-(sim(title, t) * 0.6 + sim(artist, a) * 0.4), k) for k, t, a in target if use & set(a.split()))
        out += [(o, k, n + 1, -s) for n, (s, k) in enumerate(scored[: p.candidates])]
    return sorted(out)


@pytest.mark.parametrize("kind, common", [("random", 500), ("numbered", 20), ("near", 500), ("one artist", 500)])
def test_best_candidates_equal_all_pairs(spark, kind, common):
    rng, p = random.Random(kind), Policy(candidates=4, common_word=common)

    def row(o):
        title = {"random": lambda: "".join(rng.choice("abc ") for _ in range(rng.randint(0, 9))).strip(), "numbered": lambda: f"song {rng.randrange(90)} of {rng.choice(WORDS)}"}.get(kind, lambda: "the long way home"[: rng.randint(5, 17)] + rng.choice(["", " x", "s"]))()
        return o, title, "red" if kind == "one artist" else " ".join(rng.sample(WORDS, rng.randint(1, 3)))

    source, target = [row(o) for o in range(40)], [row(o) for o in range(100, 400)]
    side = lambda rows: spark.createDataFrame([(o, f"r{o}", t, a, None, None, 1) for o, t, a in rows], COLUMNS)
    got = matching.word_pairs(side(source), side(target), p).select("s_ord", "t_ord", "pre_rank", "pre").collect()
    assert sorted(map(tuple, got)) == best_pairs(source, target, p)


def test_far_names_are_few(spark, monkeypatch):
    """Names that no bar lets through are never compared."""
    sizes, keep = {}, matching.stored

    def seen(df, label="t"):
        out = keep(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(matching, "stored", seen)
    rows = [(i, f"r{i}", f"song {i % 200} of the {WORDS[i % 6]}", f"{WORDS[i % 6]} {WORDS[i * 7 % 5]}", None, None, 1) for i in range(1200)]
    df = spark.createDataFrame(rows, COLUMNS)
    matching.word_pairs(df.where("ord < 600"), df.where("ord >= 600"), Policy(candidates=3)).count()
    assert sizes["near_names"] + sizes["far_names"] < 600 * 600 / 4


def test_letter_pairs_find_all_that_are_similar(spark):
    rng = random.Random(2)
    titles = {"".join(rng.choice("abcde ") for _ in range(rng.randint(1, 14))) for _ in range(150)}
    titles |= {"", "a"} | {t[:k] + "e" + t[k + 1 :] for t in sorted(titles) for k in (0, 5)}
    rows = [(t, "x", least) for t in titles for least in (0.65, 0.8, 1.0)]
    asked = spark.createDataFrame(rows, "s_title_key string, t_artist_key string, least double")
    found = {(r.s_title_key, r.t_title_key, r.least) for r in grams.met(asked, asked.select("t_artist_key", F.col("s_title_key").alias("t_title_key")).distinct()).collect()}
    must = {(a, b, s) for a in titles for b in titles for s in (0.65, 0.8, 1.0) if sim(a, b) >= s}
    assert must <= found and len(must) > 2 * len(titles) and len(found) < len(rows) * len(titles) / 2
