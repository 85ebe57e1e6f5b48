"""Hashed maximum-entropy language model (operator 8).

Each token is of a unit: frequent words are units of their own, others share units by their last two bytes. Units are
in classes, and a unit's probability is a class softmax times a softmax within the class. Their features are n-grams and skips of
the units before the token: the last unit, the one before it, and a hash of both. A word's share of its unit
is its smoothed relative count, so probabilities of all words, one unseen word a unit included, add up to 1.

Weights start from the units' counts and are learned by distributed gradient updates: in each round every trainer passes over its share of
the training documents in mini-batches from the common weights, and the trainers' weights are averaged by
volume. Rounds use different documents; all rounds together use every training document once.

Word counts are one aggregate over all training documents. The counts of the most frequent words, ``frequent`` at most, go to
the scoring tasks (a bounded table); counts of all other words are joined by word. Words meet by a 64-bit hash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from concord.session import discard, for_long_texts, stored

#: Words a worker remembers before it starts afresh; bounds memory only.
CACHE = 400_000
END = b""


@dataclass(frozen=True)
class Settings:
    own: int = 511  # words with a unit of their own; the end of a text has one too
    shared: int = 512  # units of all other words
    inside: int = 32  # units of a class
    buckets: int = 4096  # of the hashed features of a word and of two words, for up to ``base`` training tokens
    base: int = 10_000_000
    frequent: int = 1 << 19
    rounds: int = 3
    chunk: int = 8192  # tokens of a mini-batch
    trainer: int = 2_000_000  # tokens of a trainer's share, about
    rate: float = 0.2

    @property
    def units(self) -> int:
        return self.own + 1 + self.shared

    @property
    def classes(self) -> int:
        return -(-self.units // self.inside)

    @property
    def features(self) -> int:
        return 1 + self.units + 2 * self.buckets

    def for_corpus(self, n_tokens: int) -> Settings:
        """With so many more buckets as the cube root of the corpus' size asks for, a power of two."""
        more = max(1.0, n_tokens / self.base) ** (1 / 3)
        return replace(self, buckets=self.buckets << round(np.log2(more)))


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space with A-Z in lower case, and the end."""
    out = text.encode().lower().split()
    out.append(END)
    return out


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def shared_unit(word: bytes, s: Settings) -> int:
    return s.own + 1 + crc32(word[-2:]) % s.shared


@dataclass
class Model:
    weights: np.ndarray  # features x classes, then (1 + units) x classes x inside, in one row
    words: dict[bytes, int]  # units of frequent words
    lost: np.ndarray  # of each unit: log10 of the denominator of its words' shares


def _views(w: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    n = s.features * s.classes
    return w[:n].reshape(s.features, s.classes), w[n:].reshape((1 + s.units) * s.classes, s.inside)


class Reader:
    """Turns texts into words with units and hashes, and remembers words. ``units`` has the units of frequent words by hash."""

    def __init__(self, units: dict[int, int], s: Settings):
        self.units, self.s = units, s
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.list: list[bytes] = []
        self.unit, self.hash = np.zeros(0, np.int32), np.zeros(0, np.uint64)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row, and the number of tokens of each."""
        if len(self.list) > CACHE:
            self._forget()
        known, new, rows, sizes = self.known, self.list, [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = tokens(text)
            for w in own:
                if w not in known:
                    known[w] = len(new)
                    new.append(w)
            rows.append(np.fromiter(map(known.__getitem__, own), np.int32, len(own)))
            sizes[i] = len(own)
        fresh = new[len(self.unit) :]
        hashes = list(map(word_hash, fresh))
        units = [self.units[h] if h in self.units else shared_unit(w, self.s) for w, h in zip(fresh, hashes)]
        self.unit = np.concatenate([self.unit, np.array(units, np.int32)])
        self.hash = np.concatenate([self.hash, np.array(hashes, np.uint64)])
        return np.concatenate(rows) if rows else np.zeros(0, np.int32), sizes


def contexts(units: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, s: Settings) -> np.ndarray:
    """Feature numbers (unit of the last word, the word before it, both words) of each token; a text starts after two ends."""
    end = np.uint64(word_hash(END))
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    unit, one = np.concatenate([[s.own], units[:-1]]).astype(np.int64), np.concatenate([[end], hashes[:-1]])
    unit[first], one[first] = s.own, end
    two = np.concatenate([[end], one[:-1]])
    two[first] = end
    both = two * np.uint64(0x9E3779B97F4A7C15) + one
    low = np.uint64(s.buckets - 1)
    skip, pair = ((x ^ (x >> np.uint64(29))) & low for x in (two, both))
    return np.stack([1 + unit, 1 + s.units + skip.astype(np.int64), 1 + s.units + s.buckets + pair.astype(np.int64)])


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def predict(units: np.ndarray, f: np.ndarray, w: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of the classes and of the units of the token's class; rows of the second table's weights."""
    outer, inner = _views(w, s)
    p = _softmax(outer[0] + outer[f[0]] + outer[f[1]] + outer[f[2]])
    own = units // s.inside
    rows = np.stack([own, f[0] * s.classes + own])  # the bias, and the last unit
    return p, _softmax(inner[rows[0]] + inner[rows[1]]), rows


def log_probability(units: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, w: np.ndarray, s: Settings) -> np.ndarray:
    """log10 of the probability of each token's unit."""
    f, out = contexts(units, hashes, sizes, s), np.zeros(len(units))
    for i in range(0, len(units), 65_536):
        u = units[i : i + 65_536]
        p, q, _ = predict(u, f[:, i : i + 65_536], w, s)
        at = np.arange(len(u))
        out[i : i + 65_536] = np.log10(p[at, u // s.inside]) + np.log10(q[at, u % s.inside])
    return out


def learn(units: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, w: np.ndarray, seen: np.ndarray, s: Settings) -> None:
    """Mini-batch gradient steps on ``w`` in place; ``seen`` holds the squared gradients of each row so far."""
    outer, inner = _views(w, s)
    f = contexts(units, hashes, sizes, s)
    for i in range(0, len(units), s.chunk):
        u, g = units[i : i + s.chunk], f[:, i : i + s.chunk]
        at = np.arange(len(u))
        p, q, rows = predict(u, g, w, s)
        p[at, u // s.inside] -= 1
        q[at, u % s.inside] -= 1
        for table, error, which, first in ((outer, p, g[0], 0), (outer, p, g[1], 0), (outer, p, g[2], 0), (inner, q, rows[1], s.features)):
            order = np.argsort(which, kind="stable")
            sorted_rows = which[order]
            start = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
            sums = np.add.reduceat(error[order], start, axis=0)
            row = sorted_rows[start]
            seen[first + row] += (sums**2).mean(1)
            table[row] -= (s.rate / np.sqrt(seen[first + row] + 1.0))[:, None] * sums


def held_out(doc_id: Column) -> Column:
    """crc32 of ``doc_id`` as text, modulo 5, is 1; a null ``doc_id`` counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def word_counts(training: DataFrame, s: Settings) -> DataFrame:
    """``word, unit, c``: training counts by word hash, with the unit that a word shares."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for t in b.column(0).to_pylist():
                found.update(tokens(t))
            words = list(found)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.fromiter(map(word_hash, words), np.uint64, len(words)).view(np.int64)),
                pa.array([shared_unit(w, s) if w else s.own for w in words], pa.int32()),
                pa.array(list(found.values()), pa.int64()),
            ], ["word", "unit", "c"])

    return training.mapInArrow(job, "word long, unit int, c long").groupBy("word").agg(F.max("unit").alias("unit"), F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> pd.DataFrame:
    """The rows of ``counts`` from the least count on that at most ``most`` words reach, most frequent first.

    A histogram of counts by magnitude finds that count, so tasks send these rows and no others to the driver.
    """
    level = F.floor(F.log2("c") * 16)
    words, lowest = 0, None
    for x in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # at most 16 * 63 rows
        words += x["count"]
        if words > most:
            break
        lowest = x["level"]
    found = counts.where(level >= lowest if lowest is not None else F.lit(False))
    return found.toArrow().to_pandas().sort_values(["c", "word"], ascending=[False, True], ignore_index=True)


def _trained(training: DataFrame, words: dict[int, int], start: np.ndarray, n_tokens: int, s: Settings) -> np.ndarray:
    """Rounds of local passes and averages. The weights are of a fixed size, and so is what the driver gets."""
    w, blocks = start, 64
    size = -(-len(w) // blocks)
    trainers = max(8, n_tokens // s.rounds // s.trainer)

    for r in range(s.rounds):

        def job(batches, w=w):
            own, seen = w.copy(), np.zeros(s.features + (1 + s.units) * s.classes, np.float32)
            reader, n = Reader(words, s), 0
            for b in batches:
                texts = b.column(0).to_pylist()
                for i in range(0, len(texts), 256):
                    k, sizes = reader.read(texts[i : i + 256])
                    learn(reader.unit[k], reader.hash[k], sizes, own, seen, s)
                    n += len(k)
            if n:
                shift = np.pad(own - w, (0, blocks * size - len(w))).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([TaskContext.get().partitionId() % 64] * blocks, pa.int32()), pa.array([float(n)] * blocks), pa.array([shift[j * size : (j + 1) * size].tobytes() for j in range(blocks)], pa.binary())], ["block", "shard", "n", "shift"])

        def average(t: pa.Table) -> pa.Table:
            n = t.column("n").to_numpy()
            rows = np.stack([np.frombuffer(x, np.float16) for x in t.column("shift").to_pylist()]).astype(np.float32)
            mean = (rows * (n / n.sum())[:, None]).sum(0).astype(np.float16)
            return pa.table({"block": t.column("block").slice(0, 1), "shard": t.column("shard").slice(0, 1), "n": [n.sum()], "shift": pa.array([mean.tobytes()], pa.binary())})

        schema = "block int, shard int, n double, shift binary"
        shifts = training.where(F.pmod(F.shiftrightunsigned("h", 20), F.lit(s.rounds)) == r).select("text")
        shifts = shifts.coalesce(int(trainers)).mapInArrow(job, schema)
        shifts = shifts.groupBy("block", "shard").applyInArrow(average, schema).groupBy("block").applyInArrow(average, schema)
        got = {x["block"]: np.frombuffer(x["shift"], np.float16) for x in shifts.collect()}
        if got:
            w = w + np.concatenate([got[j] for j in range(blocks)]).astype(np.float32)[: len(w)]
    return w


def language_scores(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    Null and empty texts consist of the end alone. Null ids, repeated ids and repeated rows keep their rows; other columns are not
    read and may have any name; an empty table gives no rows. If all documents are held out, every count is 0 and the model has
    uniform weights. Texts are read in whole, some hundred bytes of memory for each word.
    """
    for_long_texts(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text.alias("text"), F.xxhash64("doc_id", text).alias("h"))
    training = own.where("NOT held_out").select("text", "h")
    counts = stored(word_counts(training.select("text"), s), "counts")
    n_all, v_all = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    s = s.for_corpus(n_all)
    top = most_frequent(counts, s.frequent)
    end = np.uint64(word_hash(END)).astype(np.int64)
    ranked = top[top.word != end].head(s.own)
    units = {int(w) & (2**64 - 1): i for i, w in enumerate(ranked.word)} | {word_hash(END): s.own}
    # volumes of all units: frequent words have their own
    frequent = F.array(*[F.lit(int(w)) for w in ranked.word]) if len(ranked) else F.array().cast("array<long>")
    of_units = np.zeros((s.units, 2))
    for u, c, v in counts.where(~F.array_contains(frequent, F.col("word"))).groupBy("unit").agg(F.sum("c"), F.count("*")).collect():
        of_units[u] = c, v
    of_units[: len(ranked)] = np.stack([ranked.c.to_numpy(float), np.ones(len(ranked))], 1)
    lost = np.log10(of_units[:, 0] + 0.5 * (of_units[:, 1] + 1))

    # the weights start as the units' own distribution
    start = np.zeros(s.features * s.classes + (1 + s.units) * s.classes * s.inside, np.float32)
    outer, inner = _views(start, s)
    volume = np.full(s.classes * s.inside, 1e-3)
    volume[: s.units] = of_units[:, 0] + 0.5
    inner[: s.classes] = np.log(volume.reshape(s.classes, s.inside))
    outer[0] = np.log(volume.reshape(s.classes, s.inside).sum(1))
    weights = _trained(training, units, start, n_all, s)

    order = np.argsort(top.word.to_numpy(np.int64))
    words, log_c = top.word.to_numpy(np.int64)[order], np.log10(top.c.to_numpy(float)[order] + 0.5)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(units, s)
        u, cs = TaskContext.get().partitionId() << 40, np.zeros(0)
        for b in batches:
            texts = b.column(2).to_pylist()
            for i in range(0, len(texts), 256):
                k, sizes = reader.read(texts[i : i + 256])
                if len(cs) > len(reader.list):
                    cs = cs[:0]
                hashes = reader.hash.view(np.int64)
                fresh = hashes[len(cs) :]
                at = np.minimum(np.searchsorted(words, fresh), max(0, len(words) - 1))
                hit = words[at] == fresh if len(words) else np.zeros(len(fresh), bool)
                cs = np.concatenate([cs, np.where(hit, log_c[at] if len(words) else 0.0, np.nan)])
                doc = np.repeat(np.arange(len(sizes)), sizes)
                unit, c = reader.unit[k], cs[k]
                n = len(sizes)
                model = np.bincount(doc, log_probability(unit, reader.hash[k], sizes, weights, s) - lost[unit], n)
                sure = ~np.isnan(c)
                known = np.bincount(doc[sure], minlength=n)
                sums = np.bincount(doc[sure], c[sure], n)
                # other words: number of times for each text and word
                pair, times = np.unique((doc[~sure].astype(np.int64) << 32) | k[~sure], return_counts=True)
                ends = np.searchsorted(pair >> 32, np.arange(n), side="right")
                rare = hashes[pair & 0xFFFFFFFF]
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (rare, times)]
                part = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([pa.array(range(u, u + n), pa.int64()), part.column(0), part.column(1), pa.array(sizes), pa.array(known, pa.int64()), pa.array(sums), pa.array(model), *lists], ["u", "doc_id", "held_out", "n_tokens", "known", "sums", "model", "words", "times"])
                u += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = own.select("doc_id", "held_out", "text").mapInArrow(job, f"u long, doc_id {kind}, held_out boolean, n_tokens long, known long, sums double, model double, words array<long>, times array<long>")
    rows = stored(rows, "scores")
    asked = rows.select("u", F.inline(F.arrays_zip("words", "times"))).select("u", F.col("words").alias("word"), "times")
    c = F.coalesce("c", F.lit(0))
    rare = asked.join(counts.select("word", "c"), "word", "left").groupBy("u").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(c + 0.5)).alias("rest"))
    rare = stored(rare, "rare")
    discard(counts)
    sums = F.col("sums") + F.coalesce("rest", F.lit(0.0))
    base = float(np.log10(n_all + 0.5 * (v_all + 1)))
    return rows.drop("words", "times").join(rare, "u", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (sums - F.col("n_tokens") * base).alias("base_score"), (sums + F.col("model")).alias("score"),
    )
