import hashlib

import pytest
from pyspark.sql import functions as F

from concord.functions import ids, similarity as sim, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize("raw, key", [
    ("Test Tune (Explicit)", "test tune"), ("Test Tune [Radio Edit]", "test tune"), ("Grand Hotel (2013 Remaster)", "grand hotel 2013"), ("Alive", "a"), ("Tune (Remastered)", "tune ed"),
    ("Tune feat. Someone Else", "tune"), ("Feat of Strength", "feat of strength"), ("Café  del Mar", "cafe del mar"), ("", ""),
])
def test_title_key(spark, raw, key):
    assert one(spark, raw, text.title_key) == key


@pytest.mark.parametrize("raw, key", [("Anna A feat. Ben B", "anna a"), ("Anna A & Ben B", "anna a ben b"), ("Felix J", "felix j"), ("X Marks", "x marks"), ("Anna and Ben", "anna ben"), ("Anna x Ben", "anna")])
def test_artist_key(spark, raw, key):
    assert one(spark, raw, text.artist_key) == key


@pytest.mark.parametrize("raw", ["Album Name (Deluxe Edition)", "Album Name [2015 Remaster]"])
def test_album_key(spark, raw):
    assert one(spark, raw, text.album_key) == "album name"


def test_long_text_key(spark):
    raw = "word " * 30_000
    assert one(spark, raw + "feat you", text.title_key) == raw.strip()


def test_duration_scores(spark):
    rows = spark.createDataFrame([(180, 180), (180, 183), (180, 185), (180, 190), (None, 180)], "a long, b long")
    assert [r.s for r in rows.select(sim.duration_score(F.col("a"), F.col("b")).alias("s")).collect()] == [1.0, 0.4, 0.0, 0.0, 0.5]


def test_similarity_branches(spark):
    rows = spark.createDataFrame([("", ""), ("", "a"), ("Ab", "aB"), ("ab", "abcd"), ("kitten", "sitting")], "a string, b string")
    assert [r.s for r in rows.select(sim.similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [1.0, 0.0, 1.0, 0.5, 1 - 3 / 7]


def test_bands(spark):
    rows = spark.createDataFrame([(0.9,), (0.85,), (0.75,), (0.65,), (0.1,)], "s double")
    assert [r.b for r in rows.select(sim.band(F.col("s")).alias("b")).collect()] == ["auto", "auto", "ambiguous", "ambiguous", "no_match"]


def test_record_ids(spark):
    row = [("Tune ", " Anna", None, 216, None), ("T", "A", "B", None, " us123 ")]
    df = spark.createDataFrame(row, "t string, a string, b string, s long, c string")
    got = [r.i for r in df.select(ids.record_id(*(F.col(c) for c in "tabsc")).alias("i")).collect()]
    assert got == [hashlib.sha256(b"anna|tune||216").hexdigest()[:32], "isrc:US123"]


def test_whole_seconds(spark):
    assert one(spark, 215999, ids.whole_seconds, "long") == 216
    assert one(spark, None, ids.whole_seconds, "long") is None


def fnv(data: bytes) -> str:
    h = ids.FNV_BASIS
    for b in data:
        h = ((h ^ b) * ids.FNV_PRIME) % 2**64
    return f"{h:x}"


@pytest.mark.parametrize("members", [[], ["a"], ["a", "b"], ["é", "🙂", "x" * 50]])
def test_members_digest(spark, members):
    assert one(spark, members, ids.members_digest, "array<string>") == fnv("\x1f".join(members).encode())


def test_members_digest_reads_the_members_once(spark):
    """In 64-bit steps; the digest was made four times over, in decimals of 38 digits."""
    df = spark.createDataFrame([(["\x00\x7f\x80ÿ", "漢\n"],)], "m array<string>").select(ids.members_digest(F.col("m")).alias("d"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and "decimal" not in plan
    assert df.first().d == fnv("\x00\x7f\x80ÿ\x1f漢\n".encode())


def test_op_keys(spark):
    got = one(spark, "update_members:list:with:colons:d1", ids.parse_op_key)
    assert (got.kind, got.entity, got.digest) == ("update_members", "list:with:colons", "d1")
    assert one(spark, "add_track:x", ids.parse_op_key) is None


def test_search_text(spark):
    df = spark.createDataFrame([("Heroes (Live) [2017 Remaster]", "Anna B")], "t string, a string")
    assert df.select(text.search_text(F.col("t"), F.col("a")).alias("q")).first().q == "Heroes Anna B"
