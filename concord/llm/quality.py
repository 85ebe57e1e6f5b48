"""Quality classifier with supervised subword embeddings (operator 6).

A word is the average of hashed vectors: its own and those of its character n-grams. A pair of neighbouring words is the
average of two: a hashed vector of the pair, and one that says whether both are the same word. A document is the average
of its words and of its pairs, and a softmax over two classes reads that average. All vectors are learned by stochastic
gradient descent in numpy, from a bounded sample of labelled rows.

The sample is the ``sample`` labelled training rows with the smallest hash of ``doc_id``; ids with contradictory labels are
not in it, and of texts with the same id the one with the smallest hash is. A document's features are hashed counts, so what
the driver gets is bounded too (``sample`` rows of at most ``buckets`` counts each). Scores are for whole texts: every word of every
document is read, however long.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from concord.session import for_long_texts

#: Words a worker remembers before it starts afresh, and their characters; bounds memory only.
CACHE, CHARS = 400_000, 12_000_000

#: Texts read at a time.
TEXTS = 256

#: So many further words without a say are averaged in, so that very short texts lean to the prior.
EVEN = 2


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    dim: int = 16
    ngram: int = 3
    sample: int = 4000
    epochs: int = 12
    steps: int = 15_000  # at least so many steps in all, so small samples are passed over more often
    rate: float = 0.5
    decay: float = 1e-6
    seed: int = 7


def word_buckets(word: str, s: Settings) -> array:
    """Hashed features of a word: itself, all n-grams of ``<word>``, and its letter case and last sign."""
    text, n = f"<{word}>", s.ngram
    grams = (text[i : i + n] for i in range(len(text) - n + 1))
    more = (f"w {word}", f"s {word.isupper()} {word.isalpha()} {'a' if word[-1].isalnum() else word[-1]}")
    return array("i", (crc32(x.encode()) % s.buckets for x in chain(grams, more)))


def kind_bucket(same: bool, s: Settings) -> int:
    return crc32(b"p same" if same else b"p other") % s.buckets


def pair_buckets(first, second, s: Settings):
    """Hashed features of pairs of words, from the words' checksums; numbers or arrays of them."""
    return (first * 40503 + second) % s.buckets


def document_features(text: str, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of a document; a text without words has none."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    ids, weights = [], []
    for word, n in Counter(words).items():
        b = word_buckets(word, s)
        ids.append(b)
        weights.append(np.full(len(b), n / len(b)))
    for (x, y), n in Counter(zip(words, words[1:])).items():
        ids.append([pair_buckets(crc32(x.encode()), crc32(y.encode()), s), kind_bucket(x == y, s)])
        weights.append(np.full(2, n / 2))
    b, back = np.unique(np.concatenate(ids), return_inverse=True)
    return b.astype(np.int32), (np.bincount(back, np.concatenate(weights)) / (len(words) + EVEN) / 2).astype(np.float32)


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, s: Settings) -> dict[str, np.ndarray]:
    """Vectors and softmax weights, by stochastic gradient descent over shuffled documents."""
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim))
    out, bias = np.zeros((2, s.dim)), np.log((np.bincount(labels, minlength=2) + 1) / (len(labels) + 2))
    epochs = max(s.epochs, -(-s.steps // max(1, len(labels))))
    steps, step = max(1, epochs * len(labels)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            b, w = features[i]
            rate = s.rate * (1 - step / steps)
            step += 1
            h = w @ vectors[b] if len(b) else np.zeros(s.dim)
            z = out @ h + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            if len(b):
                # a document's own weights are small; their square sum scales the step of its vectors
                vectors[b] -= rate * np.outer(w / (w @ w + 1e-3), p @ out) * 0.1
            out -= rate * (np.outer(p, h) + s.decay * out)
            bias -= rate * 0.1 * p
    return {"score": vectors @ (out[1] - out[0]), "bias": np.array([bias[1] - bias[0]])}


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of ``doc_id`` as text, modulo 3, is 1. A null ``doc_id`` counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> dict[str, np.ndarray]:
    """Train on labelled rows that are not held out. Without rows of both classes every score is 0.5."""
    for_long_texts(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("quality").alias("low"))
    known = known.where("quality = low").select("doc_id", "quality")
    # choose by id alone, before any text moves
    chosen = known.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [document_features(t or "", s) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))], ["doc_id", "quality", "h", "b", "w"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` short rows
    texts = texts.select("doc_id", F.col("quality").cast("long"), F.xxhash64("text").alias("h"), "text")
    schema = T.StructType([*texts.schema.fields[:3], T.StructField("b", T.ArrayType(T.IntegerType())), T.StructField("w", T.ArrayType(T.FloatType()))])
    one = texts.mapInArrow(hashed, schema).groupBy("doc_id").agg(F.min(F.struct("h", "quality", "b", "w")).alias("x"))
    rows = one.select("doc_id", "x.quality", "x.b", "x.w").toArrow().sort_by("doc_id")
    y = rows["quality"].to_numpy()
    if len(set(y)) < 2:
        return {"score": np.zeros(s.buckets), "bias": np.zeros(1)}
    b, w = (rows[c].combine_chunks() for c in ("b", "w"))
    at, flat_b, flat_w = b.offsets.to_numpy(), b.values.to_numpy(), w.values.to_numpy()
    model = train([(flat_b[i:j], flat_w[i:j]) for i, j in zip(at, at[1:])], y, s)
    del rows, b, w, at, flat_b, flat_w
    pa.default_memory_pool().release_unused()  # the sample's memory is the driver's for all later work otherwise
    return model


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Scorer:
    """Scores whole texts; a word's share of the score is computed once."""

    def __init__(self, model: dict[str, np.ndarray], s: Settings):
        self.settings, self.bias, self.scores = s, float(model["bias"][0]), np.asarray(model["score"], np.float64)
        self.same, self.other = (self.scores[kind_bucket(k, s)] for k in (True, False))
        self._forget()

    def _forget(self) -> None:
        self.known, self.chars, self.value, self.crc = _Numbers(), 0, np.zeros(0), np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Shares and checksums of the words that got a number since the last call."""
        new = list(islice(reversed(self.known), len(self.known) - len(self.value)))[::-1]
        self.chars += sum(map(len, new))
        flat, ends = array("i"), []
        for w in new:
            flat.extend(word_buckets(w, self.settings))
            ends.append(len(flat))
        sums = np.concatenate([[0.0], np.cumsum(self.scores[np.frombuffer(flat, np.int32)])]) if new else np.zeros(1)
        at = np.array([0, *ends])
        value = (sums[at[1:]] - sums[at[:-1]]) / np.diff(at)
        self.value = np.concatenate([self.value, value])
        self.crc = np.concatenate([self.crc, np.fromiter((crc32(w.encode()) for w in new), np.int64, len(new))])

    def batch(self, texts: list[str]) -> np.ndarray:
        """The score of each text."""
        if len(self.known) > CACHE or self.chars > CHARS:
            self._forget()
        rows = [np.fromiter(map(self.known.__getitem__, w), np.int32, len(w)) for w in map(str.split, texts)]
        self._learn()
        n = np.array([len(r) for r in rows])
        word, doc = np.concatenate([np.zeros(0, np.int32), *rows]), np.repeat(np.arange(len(rows)), n)
        z = np.bincount(doc, self.value[word], len(rows)).astype(float)  # of nothing, counts are whole
        inside = doc[1:] == doc[:-1]
        x, y = word[:-1][inside], word[1:][inside]
        pairs = self.scores[pair_buckets(self.crc[x], self.crc[y], self.settings)] + np.where(x == y, self.same, self.other)
        z = z + np.bincount(doc[1:][inside], pairs, len(rows)) / 2
        return 1 / (1 + np.exp(-np.clip(self.bias + z / (n + EVEN) / 2, -40, 40)))


def score(docs: DataFrame, model: dict[str, np.ndarray], s: Settings = Settings(), columns: list[str] | None = None, name: str = "score") -> DataFrame:
    """``columns`` (``doc_id``) of every document and its score, as ``name``, from the text alone.

    Null and empty texts get the score of the learned bias. Nulls and repeated rows pass through, an empty table gives no rows,
    and other columns may have any name. One pass, no shuffle; only the texts go to Python.
    """
    for_long_texts(docs.sparkSession)
    small = {k: v.astype(np.float32) for k, v in model.items()}  # at most ``buckets`` numbers

    @F.arrow_udf(T.DoubleType())
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(small, s)
        for texts in batches:
            parts = [scorer.batch(texts.slice(i, TEXTS).to_pylist()) for i in range(0, len(texts), TEXTS)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]))

    return docs.select(*(columns or ["doc_id"]), scores(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(name))


def quality_scores(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    found = score(docs, fit(docs, labels, s), s)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
