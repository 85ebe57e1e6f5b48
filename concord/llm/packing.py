"""Best-fit packing of documents into fixed-length sequences (operator 4).

Only piece lengths decide a packing, and there are at most ``capacity`` of them, so the plan is made
from the histogram of lengths, a table whose size the capacity bounds. In the plan:

* pieces over a third of the capacity go at most two to a sequence: from the longest down, each takes
  the longest partner that still fits (a greedy matching, which for two items a bin uses the fewest bins);
* smaller pieces, longest first, go to the tightest gap that holds them (best fit), and open new
  sequences only where no gap does.

A plan row places a run of equal pieces, so every piece finds its place from its rank among pieces of its
length. Ranks are dealt over salted groups: a length that a third of all pieces have is no hot key. Where the order of the documents counts, the groups are stretches of their files, ranks
follow that order, and so do the numbers of the sequences.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import chain, islice
from unicodedata import category, is_normalized, normalize, ucd_3_2_0

import numpy as np
import pyarrow as pa
import regex
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window as W, functions as F

from concord.operators.ordering import numbered
from concord.session import discard, for_long_texts, stored

#: Words a worker remembers before it starts afresh, and their ids; bounds memory only.
CACHE, IDS = 500_000, 8_000_000

#: Words after which waiting texts are encoded.
WORDS = 200_000


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class _Lists:
    """Lists of ids one after another, found by their numbers."""

    def __init__(self) -> None:
        self.flat, self.at, self.used, self.n = np.zeros(1 << 16, np.uint32), np.zeros(1 << 15, np.int64), 0, 0

    def __len__(self) -> int:
        return self.n

    def extend(self, ids: np.ndarray, ends: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(ends) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[self.n + 1 : self.n + 1 + len(ends)] = self.used + ends
        self.used += len(ids)
        self.n += len(ends)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the lists with these numbers in a row, and the lists' lengths."""
        start = self.at[numbers]
        size = self.at[numbers + 1] - start
        ends = np.cumsum(size)
        return self.flat[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], size


def _latest(numbers: _Numbers, seen: int) -> list[str]:
    return list(islice(reversed(numbers), len(numbers) - seen))[::-1]


class WordEncoder:
    """Token ids of whole texts by a ``tokenizers`` file whose pieces never cross white space.

    A text is normalised as the library does it: NFC, then lower case. The library encodes each distinct piece once (runs of
    letters, of signs, single digits: the file's own pattern); a text's ids are its words' ids in a row, a word's those of
    its pieces. Texts go to the library whole if they have a special string or characters on which Python and the library
    differ, or if lower-casing undoes the NFC, which the library would then do to the pieces.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        with open(path, encoding="utf-8") as f:
            self.pattern = regex.compile(json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # the library's NFC may not know marks that are younger than its tables
        self.young = {c for c in map(chr, range(0x300, 0x20000)) if category(c)[0] == "M" and ucd_3_2_0.category(c) == "Cn"}
        self.whole = re.compile("|".join(["[\x1c-\x1f\u03a3]", *(re.escape(t.content) for t in added.values())]))
        self._forget()

    def _forget(self) -> None:
        self.known, self.parts = _Numbers(), _Numbers()  # words, and the pieces they consist of
        self.words, self.pieces = _Lists(), _Lists()  # ids of each

    def _learn(self) -> None:
        """Encode the words that got a number since the last call: their new pieces go to the library."""
        new = _latest(self.known, len(self.words))
        own = [self.pattern.findall(w) for w in new]
        consists = np.fromiter(map(self.parts.__getitem__, chain.from_iterable(own)), np.int64)
        fresh = _latest(self.parts, len(self.pieces))
        for i in range(0, len(fresh), 2048):
            some = fresh[i : i + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) != len(some):  # the library cuts one of them otherwise
                each = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in some]
                ids, ends = np.array(list(chain.from_iterable(each)), np.int64), np.cumsum([len(x) for x in each])
            self.pieces.extend(ids, ends)
        ids, sizes = self.pieces.gather(consists)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([len(x) for x in own], dtype=np.int64)]
        self.words.extend(ids, ends)

    def batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        waiting: list[np.ndarray | None] = []
        first = size = 0
        for i, text in enumerate(texts):
            plain = text.isascii()
            lower = (text if plain else normalize("NFC", text)).lower()
            if self.whole.search(text) or not (plain or is_normalized("NFC", lower) and self.young.isdisjoint(text)):
                waiting.append(None)
            else:
                words = lower.split()
                waiting.append(np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)))
                size += len(words)
            if size > WORDS or i == len(texts) - 1:
                self._learn()
                for k, own in enumerate(waiting):
                    yield self.words.gather(own)[0] if own is not None else np.array(self.tokenizer.encode(texts[first + k], add_special_tokens=False).ids, np.uint32)
                waiting, first, size = [], i + 1, 0
                if len(self.known) > CACHE or self.words.used + self.pieces.used > IDS:
                    self._forget()


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, also: str = "") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece; longer documents are cut at the capacity. Columns in ``also`` (a schema) are kept."""
    more = [x.split()[0] for x in also.split(",") if x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(vocabulary)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoder.batch(b.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k in range(0, len(ids), capacity):
                    part = ids[k : k + capacity]
                    row.append(i)
                    piece.append(k // capacity)
                    start.append(k)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *(b.column(x).take(pa.array(row, pa.int64())) for x in more)], ["doc_id", "piece", "start", "length", "ids_crc32", *more])

    for_long_texts(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)
    return own.mapInArrow(run, ", ".join(["doc_id long, piece int, start long, length long, ids_crc32 long", *[also] * bool(also)]))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``(length, first rank, pieces, pieces per sequence, first sequence, offset)`` of a packing.

    ``counts`` has the number of pieces of each length from 1 to ``capacity``. A row places its pieces
    side by side, so many to a sequence, from an offset on.
    """
    left, taken, rows = dict(counts), dict.fromkeys(counts, 0), []
    gaps: list[int] = []  # sorted; ``free`` has the runs (first sequence, sequences) with each gap
    free: dict[int, list[tuple[int, int]]] = {}
    sequences = 0

    def place(size: int, n: int, each: int, first: int, offset: int) -> None:
        rows.append((size, taken[size], n, each, first, offset))
        taken[size] += n
        left[size] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in free:
                free[gap] = []
                insort(gaps, gap)
            free[gap].append((first, n))

    large = sorted(s for s in counts if 3 * s > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        at = bisect_right(large, capacity - a) - 1
        while at >= 0 and left[large[at]] < (2 if large[at] == a else 1):
            if not left[large[at]]:
                large.pop(at)
            at -= 1
        b = large[at] if at >= 0 else None
        if b is None:
            n = left[a] if 2 * a > capacity else 1
            place(a, n, 1, sequences, 0)
            leave(capacity - a, sequences, n)
        elif a == b:
            n = left[a] // 2
            place(a, 2 * n, 2, sequences, 0)
            leave(capacity - 2 * a, sequences, n)
        else:
            n = min(left[a], left[b])
            place(a, n, 1, sequences, 0)
            place(b, n, 1, sequences, a)
            leave(capacity - a - b, sequences, n)
        sequences += n

    for s in sorted((s for s in counts if 3 * s <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(gaps, s)
            if at == len(gaps):
                gap, first, n = capacity, sequences, -(-left[s] // (capacity // s))
                sequences += n
            else:
                gap = gaps[at]
                first, n = free[gap].pop()
                if not free[gap]:
                    del free[gap], gaps[at]
            each = gap // s
            full = min(n, left[s] // each)
            if full:
                place(s, full * each, each, first, capacity - gap)
                leave(gap - each * s, first, full)
            if full < n and left[s]:
                k = left[s]
                place(s, k, k, first + full, capacity - gap)
                leave(gap - k * s, first + full, 1)
                full += 1
            if full < n:
                leave(gap, first + full, n - full)
    return rows


#: Rows of a file that are ranked together.
STRETCH = 1 << 16


def in_order(docs: DataFrame) -> DataFrame | None:
    """Documents with ``__file`` and ``__at``, their place in the Parquet files that they are read from, by name; None if they are not read from such."""
    try:
        return docs.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    except AnalysisException:
        return None


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, ordered: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    Null and empty texts are one piece that holds the end id alone. Null and repeated ``doc_id`` and repeated
    rows each keep their own pieces; other columns are not read; an empty table gives no rows. If ``ordered``, documents of
    stored files are taken in their order: of pieces of one length the earlier ones come first, and sequences are numbered from 0 by their earliest piece.
    """
    spark = docs.sparkSession
    placed = in_order(docs) if ordered else None
    # a row's number is written with it, so that equal rows, which no hash tells apart, are dealt to many groups
    cut = pieces(docs, vocabulary, capacity, end_id).withColumn("row", F.monotonically_increasing_id()) if placed is None else pieces(placed, vocabulary, capacity, end_id, "__file string, __at long")
    parts = stored(cut, "pieces")
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # at most ``capacity`` rows
    salts = max(8, sum(counts.values()) // 200_000)
    rows = plan(counts, capacity)  # a few rows for each length
    places = F.broadcast(spark.createDataFrame(rows, "length long, first long, n long, each long, seq long, off long"))
    if placed is None:
        salted, order = parts.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts))), ["row"]
    else:
        salted, order = parts.withColumn("salt", F.struct("__file", F.floor(F.col("__at") / STRETCH).alias("n"))), ["__at", "piece"]
    before = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .withColumn("base", F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n"))
        .select("length", "salt", "base")
    )
    own = W.partitionBy("length", "salt").orderBy(*order)
    ranked = salted.withColumn("k", F.row_number().over(own) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("k") + F.col("base"))
    at = F.col("rank") - F.col("first")
    found = ranked.join(places, "length").where((at >= 0) & (at < F.col("n"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("seq") + F.expr("(rank - first) div each")).alias("sequence_id"),
        (F.col("off") + (at % F.col("each")) * F.col("length")).alias("offset"), *(["__file", "__at"] if placed is not None else []),
    )
    if placed is None:
        return found
    found = stored(found, "packed")
    earliest = found.groupBy("sequence_id").agg(F.min(F.struct("__file", "__at", "piece")).alias("__first"))
    numbers = numbered(earliest, "__first", name="__number")[0].select("sequence_id", "__number")
    return found.join(numbers, "sequence_id").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("__number").alias("sequence_id"), "offset")
