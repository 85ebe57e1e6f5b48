"""Removal of long strings that occur more than once (operator 10).

The rule: every byte that a string of ``length`` bytes covers goes, if that string also starts anywhere else. A suffix
array answers it by the common prefix of neighbouring suffixes. External induced sorting of all suffixes moves
tens of bytes for each byte of text, more than the disk this library allows itself (see README), so this
operator keeps sampling, naming and induction and drops the order: positions are sampled, named by hashes, and induced from.

1. Sampling. Each window of ``length`` bytes names one position in it, its anchor: the smallest hash of the ``GRAM`` bytes there.
   Equal windows have equal anchors. Consecutive windows with one anchor form a run, about one for 60 bytes.
2. Naming. Runs are named by the hash of their anchor and the hash of all bytes that they cover.
   An anchor that occurs once has only windows that occur once. A run that occurs twice has only windows that
   occur twice. Both are settled by counting names.
3. Induction. What is left are anchors with several different runs: where repeats begin and end. Their windows
   are compared one by one, among the runs of the anchor only.

All steps are aggregates and joins on hashes that Spark deals out and spills; no task needs more than one
chunk of runs in memory. An anchor with very many different runs (a passage that a third of all texts have) is
not compared in one task: its windows are counted by a further aggregate. Rows are joined to counts by name and part, so a
passage that a third of all texts have is spread over ``SALTS`` keys. Names have 64 bits within an anchor of 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from concord.session import discard, for_long_texts, stored

GRAM = 64
#: Low bits of a sampled hash that hold a position; longer texts are sampled in overlapping stretches.
BITS = 24
#: Runs of one anchor up to which a single task compares them, and runs it takes at a time.
HOT, CHUNK = 2_000, 20_000
#: Parts over which the rows of one name are spread: the bits of a long.
SALTS = 64


class Rolling:
    """Polynomial hashes of any byte range of a text, from prefix sums modulo 2**64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1, 2**60)) * 8 + 5
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        size = 1 << (n - 1).bit_length()
        powers = lambda b: np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]))
        self.up, self.down = powers(np.uint64(self.base)), powers(np.uint64(pow(self.base, -1, 1 << 64)))

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if n + 1 > len(self.up):
            self._grow(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, length) -> np.ndarray:
        return (sums[start + length] - sums[start]) * self.down[start]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(data: np.ndarray, one: Rolling, two: Rolling, length: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows, anchor name and run name of each run of a text."""
    gram, stretch, found = min(GRAM, length), 1 << (BITS - 1), []
    for at in range(0, len(data) - length + 1, stretch):
        part = data[at : at + stretch + length - 1]
        n, width = len(part) - length + 1, length - gram + 1
        s1, s2 = one.sums(part), two.sums(part)
        grams = mixed((s1[gram:] - s1[:-gram]) * one.down[: len(part) - gram + 1])
        low = (grams >> np.uint64(BITS) << np.uint64(BITS)) | np.arange(len(grams), dtype=np.uint64)
        k = 1
        while 2 * k <= width:  # the minimum of each window by doubling
            low = np.minimum(low[:-k], low[k:])
            k *= 2
        if k < width:
            low = np.minimum(low[: len(low) - (width - k)], low[width - k :])
        anchor = (low & np.uint64((1 << BITS) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        count = np.diff(np.append(first, n))
        place = mixed((count * 1_000_003 + anchor[first] - first).astype(np.uint64))
        found.append((first + at, count, grams[anchor[first]], mixed(two.of(s2, first, count + length - 1) + place)))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))


def _sampled(own: DataFrame, length: int) -> DataFrame:
    """``u, id, check, first, count, anchor, run``: one row for each text row, with its runs as arrays; ``u`` numbers the rows."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Rolling(1), Rolling(2)
        u = TaskContext.get().partitionId() << 40
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for text in b.column(2).to_pylist():
                for c, v in zip(cols, runs(np.frombuffer(text.encode(), np.uint8), one, two, length)):
                    c.append(v.view(np.int64))
            lists = [pa.array(c, pa.list_(pa.int64())) for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(range(u, u + b.num_rows), pa.int64()), b.column(0), b.column(1), *lists], ["u", "id", "check", "first", "count", "anchor", "run"])
            u += b.num_rows

    lists = ", ".join(f"{c} array<long>" for c in ("first", "count", "anchor", "run"))
    return own.mapInArrow(job, f"u long, id long, check long, {lists}")


def _contents(own: DataFrame, fine: DataFrame, length: int) -> DataFrame:
    """``anchor, runs, u, first, weight, content`` of the runs to compare: the bytes that each covers."""

    def job(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = text.encode()
                for w in wanted:
                    for c, v in zip(cols, (w["anchor"], w["runs"], w["u"], w["first"], w["weight"], data[w["first"] : w["first"] + w["count"] + length - 1])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary())], ["anchor", "runs", "u", "first", "weight", "content"])

    lists = fine.groupBy("id", "check").agg(F.collect_list(F.struct("anchor", "runs", "u", "first", "count", "weight")).alias("wanted"))
    return own.join(lists, ["id", "check"]).select("text", "wanted").mapInArrow(job, "anchor long, runs long, u long, first long, weight long, content binary")


def _windows(contents: list[bytes], two: Rolling, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every window of every content, one content after another, and the numbers of windows."""
    sizes = np.array([len(c) for c in contents], np.int64)
    count = sizes - length + 1
    sums = two.sums(np.frombuffer(b"".join(contents), np.uint8))
    ends = np.cumsum(count)
    start = np.repeat(np.cumsum(sizes) - sizes - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
    return mixed(two.of(sums, start, length)), count


def _stretches(u: np.ndarray, first: np.ndarray, count: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    """``u, low, high``: stretches of windows that occur twice, from a flag for each window of each run."""
    run = np.repeat(np.arange(len(count)), count)
    at = np.flatnonzero(twice)
    new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(run[at]) > 0)]) if len(at) else np.zeros(0, bool)
    low = at[new]
    high = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] if len(at) else low
    begin = np.cumsum(count) - count
    where = first[run[low]] - begin[run[low]]
    return pa.RecordBatch.from_arrays([pa.array(u[run[low]]), pa.array(low + where), pa.array(high + where)], ["u", "low", "high"])


def _compared(contents: DataFrame, length: int) -> DataFrame:
    """``u, low, high``: windows of fine runs that occur twice. Runs of an anchor meet in one task, many anchors at a time."""

    def job(batches):
        two, held, n = Rolling(2), [], 0

        def settle(rows: pa.Table) -> pa.RecordBatch:
            u, first, weight = (rows.column(c).to_numpy() for c in ("u", "first", "weight"))
            h, count = _windows(rows.column("content").to_pylist(), two, length)
            _, same = np.unique(h, return_inverse=True)
            often = np.bincount(same, np.repeat(weight, count))[same] >= 2
            return _stretches(u, first, count, often & np.repeat(weight == 1, count))

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK:  # settle the anchors that are complete
                rows = pa.Table.from_batches(held)
                anchors = rows.column("anchor").to_numpy()
                done = int(np.searchsorted(anchors, anchors[-1]))
                if done:
                    yield settle(rows.slice(0, done))
                held = rows.slice(done).combine_chunks().to_batches()
                n = rows.num_rows - done
        if n:
            yield settle(pa.Table.from_batches(held))

    calm = contents.where(F.col("runs") <= HOT)
    return calm.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(job, "u long, low long, high long")


def _windows_of_hot(contents: DataFrame, length: int) -> DataFrame:
    """``anchor, name, u, low, weight, salt``: every window of the runs of anchors with very many runs."""

    def job(batches):
        two = Rolling(2)
        for b in batches:
            h, count = _windows(b.column("content").to_pylist(), two, length)
            run = np.repeat(np.arange(b.num_rows), count)
            p = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + b.column("first").to_numpy()[run]
            at = pa.array(run)
            yield pa.RecordBatch.from_arrays([b.column("anchor").take(at), pa.array(h.view(np.int64)), b.column("u").take(at), pa.array(p), b.column("weight").take(at)], ["anchor", "name", "u", "low", "weight"])

    hot = contents.where(F.col("runs") > HOT).mapInArrow(job, "anchor long, name long, u long, low long, weight long")
    return hot.withColumn("salt", _salt("u"))


def _twice(contents: DataFrame, length: int) -> DataFrame:
    """``anchor, name, salt``: windows of anchors with very many runs that occur twice, and the parts of the rows that have them."""
    found = _windows_of_hot(contents, length).groupBy("anchor", "name").agg(F.sum("weight").alias("n"), *_salts())
    return found.where("n > 1").selectExpr("anchor", "name", UNFOLD)


def _counted(contents: DataFrame, twice: DataFrame, length: int) -> DataFrame:
    """``u, low, high`` as of ``_compared``, for anchors with very many runs: their windows are counted by an aggregate."""
    found = _windows_of_hot(contents, length).where("weight = 1").join(twice, ["anchor", "name", "salt"])
    return found.select("u", "low", F.col("low").alias("high"))


def removed(docs: DataFrame, length: int = 200) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Null texts count as empty; texts shorter than ``length`` bytes lose nothing; repeated rows are copies of each other and lose all that is
    at least ``length`` long. Null ids pass through; other columns are not read; an empty table gives no rows. A text is read in whole,
    some 60 bytes of memory for each of its bytes; stretches of 8 MB are sampled one after another.
    """
    return _cut(docs, length, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", lambda data, keep, spans: (len(data), int(len(data) - keep.sum()), spans, hashlib.sha256(data[keep].tobytes()).hexdigest()))


def cleaned(docs: DataFrame, length: int = 200) -> DataFrame:
    """``doc_id, text``: the texts that remain; bytes of a character that was cut in two become U+FFFD."""
    return _cut(docs, length, "text string", lambda data, keep, spans: (data[keep].tobytes().decode("utf-8", "replace"),))


def _salt(number: str):
    return F.pmod(F.col(number), F.lit(SALTS)).cast("int")


def _salts() -> list:
    """Aggregates that keep which parts a name has rows in, and the expression that unfolds them."""
    return [F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask")]


UNFOLD = "explode(filter(sequence(0, 63), i -> shiftright(mask, i) & 1L = 1L)) AS salt"


def _cut(docs: DataFrame, length: int, schema: str, outcome) -> DataFrame:
    for_long_texts(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("check"), text.alias("text"))

    sampled = stored(_sampled(own, length), "runs")
    rows = sampled.select("u", "id", "check")
    flat = sampled.select("u", F.inline(F.arrays_zip("first", "count", "anchor", "run"))).select("u", "first", "count", "anchor", "run", _salt("u").alias("salt"))
    # what is counted by name is joined by name and part of the rows, so a name that very many rows have is many keys
    often = flat.groupBy("anchor").agg(F.count("*").alias("times"), *_salts()).where("times > 1").selectExpr("anchor", UNFOLD)
    often = stored(often, "anchors")
    shared = stored(flat.join(often, ["anchor", "salt"]), "shared")
    names = stored(shared.groupBy("anchor", "run").agg(F.count("*").alias("n"), F.min("u").alias("rep"), *_salts()), "names")
    # of runs that occur again all windows do
    again = names.where("n > 1").selectExpr("anchor", "run", UNFOLD)
    whole = shared.join(again, ["anchor", "run", "salt"]).select("u", F.col("first").alias("low"), (F.col("first") + F.col("count") - 1).alias("high"))
    # one run of each name is compared; windows of one that occurs again count twice
    own_names = names.select("anchor", "run", "n", "rep", _salt("run").alias("salt"))
    kinds = own_names.groupBy("anchor").agg(F.count("*").alias("runs"), *_salts()).where("runs > 1").selectExpr("anchor", "runs", UNFOLD)
    kinds = stored(kinds, "kinds")
    fine = own_names.join(kinds, ["anchor", "salt"]).drop("salt").join(shared.drop("salt").withColumnRenamed("u", "rep"), ["anchor", "run", "rep"]).join(rows.withColumnRenamed("u", "rep"), "rep")
    fine = fine.select("id", "check", "anchor", "runs", F.col("rep").alias("u"), "first", "count", F.least("n", F.lit(2)).cast("long").alias("weight"))
    contents = stored(_contents(own, fine, length), "contents")
    twice = stored(_twice(contents, length), "twice")
    parts = whole.unionByName(_compared(contents, length)).unionByName(_counted(contents, twice, length))
    spans = parts.join(rows, "u").groupBy("id", "check").agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("spans"))
    spans = stored(spans, "spans")
    discard(twice, contents, shared, names, kinds, often, sampled)

    def job(batches):
        for b in batches:
            out = []
            for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = np.frombuffer(t.encode(), np.uint8)
                edge = np.zeros(len(data) + 1, np.int64)
                for x in s or ():
                    edge[x["low"]] += 1
                    edge[x["high"] + length] -= 1
                keep = np.cumsum(edge[:-1]) == 0
                gone = np.concatenate([[True], keep, [True]]).astype(np.int8)
                out.append(outcome(data, keep, int((np.diff(gone) == -1).sum())))
            cols = list(zip(*out)) if out else [[] for _ in names_out]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types_out))], ["id", *names_out])

    names_out = [x.split()[0] for x in schema.split(", ")]
    types_out = [pa.int64() if x.endswith("long") else pa.string() for x in schema.split(", ")]
    done = own.join(spans, ["id", "check"], "left").select("id", "text", "spans").mapInArrow(job, f"id long, {schema}")
    return done.select(F.when(F.col("id") != -(1 << 63), F.col("id")).alias("doc_id"), *names_out)
