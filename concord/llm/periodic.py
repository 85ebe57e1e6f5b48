"""Periodic runs of words inside each document (operator 11).

A run is a stretch of consecutive words with smallest period ``q`` that is at least ``max(least, times * q)`` words long and that
no neighbouring word extends with the same period. Every such run has a Lyndon root: a factor of ``q`` words that is the longest
Lyndon word at its place under one of the two orders of the words, the given one or its reverse. So each order is scanned from right to
left with a stack of Lyndon factors; a factor that is followed by its own copy is extended to both sides.

Words are compared as numbers. Longest common extensions are found by binary search over rolling hashes modulo 2^64 and then verified on
the words themselves; where a hash is deceived, the first differing word is looked up directly, so results never depend on hashes.

Only stretches whose four-word strings occur more than once are scanned. Every word of a run lies in such a string (of at
least ``max(6, 4q)`` words, each four in a row recur ``q`` words on or before), so nothing is lost and prose costs one sort.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from concord.session import for_long_texts

MASK = (1 << 64) - 1
#: Fixed odd multipliers of the rolling hash and of its word numbers.
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

#: Words of a stretch that are hashed together when repeated strings are looked for.
GRAM = 4

#: Words of the texts that are looked at together; one longer text is looked at alone.
WORDS = 400_000


class Extensions:
    """Longest common extensions inside one sequence of word numbers."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.n = ids, len(ids)
        powers = np.full(self.n + 1, BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX)
        mixed ^= mixed >> np.uint64(29)
        sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mixed * powers[:-1], dtype=np.uint64, out=sums[1:])
        self.sums, self.powers = memoryview(sums), memoryview(powers)

    def alike(self, i: int, j: int, k: int) -> bool:
        """Whether the hashes of ``k`` words from ``i`` and from ``j > i`` agree."""
        h = self.sums
        return not ((h[i + k] - h[i]) * self.powers[j - i] - (h[j + k] - h[j])) & MASK

    def forward(self, i: int, j: int, most: int) -> int:
        """How many words from ``i`` and from ``j > i`` agree, up to ``most``."""
        low, high = 0, most
        while low < high:
            k = (low + high + 1) // 2
            if self.alike(i, j, k):
                low = k
            else:
                high = k - 1
        other = np.flatnonzero(self.ids[i : i + low] != self.ids[j : j + low])
        return int(other[0]) if len(other) else low

    def backward(self, i: int, j: int, most: int) -> int:
        """How many words before ``i`` and before ``j > i`` agree, up to ``most``."""
        low, high = 0, most
        while low < high:
            k = (low + high + 1) // 2
            if self.alike(i - k, j - k, k):
                low = k
            else:
                high = k - 1
        other = np.flatnonzero(self.ids[i - low : i] != self.ids[j - low : j])
        return low - 1 - int(other[-1]) if len(other) else low


def stretch_runs(ids: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """``start, length, period`` of the runs of one sequence, in order. ``times`` is at least 2."""
    n, found = len(ids), set()
    if n < max(least, times):
        return []
    ext = Extensions(ids)
    for order in (ids, -ids):
        s, end, last = memoryview(np.ascontiguousarray(order, np.int64)), array("q", bytes(8 * n)), {}
        for i in range(n - 1, -1, -1):
            j, a = i + 1, s[i]
            while j < n:
                b = s[j]
                if a == b:
                    # the factors from i and from j: if one begins the other, the shorter is the smaller
                    most = min(j - i, end[j] - j)
                    k = 1
                    while k < most and k < 4 and s[i + k] == s[j + k]:
                        k += 1
                    if k == 4 and k < most:
                        k = ext.forward(i, j, most)
                    if (j - i >= end[j] - j) if k == most else s[i + k] > s[j + k]:
                        break
                elif a > b:
                    break
                j = end[j]
            end[i] = j
            p = j - i
            if j + p > n or s[i] != s[j] or not ext.alike(i, j, p):
                continue  # a run of three periods and more has a root that is followed by its copy
            known = last.get(p)
            if known and known[0] <= i and j <= known[1]:
                continue  # stretches of one period overlap by less than it
            right = ext.forward(i, j, n - j)
            if right < p:
                continue
            left = ext.backward(i, j, i)
            last[p] = (i - left, j + right)
            if j + right - i + left >= max(least, times * p):
                found.add((i - left, j + right - i + left, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated_stretches(keys: np.ndarray, parts: np.ndarray, least: int = 6) -> list[tuple[int, int]]:
    """Stretches ``from, to`` of words that lie in a string of four that their part has twice; ``parts`` are numbers that never fall.

    Stretches are looked at again on their own, as parts, while that takes much away.
    """
    n = len(keys)
    at = np.arange(n)
    while True:
        if len(at) < least:
            return []
        k = keys[at].view(np.uint64)
        m = len(at) - GRAM + 1
        one = (at[GRAM - 1 :] - at[:m] == GRAM - 1) & (parts[at[GRAM - 1 :]] == parts[at[:m]])
        h = parts[at[:m]].astype(np.uint64) * np.uint64(MIX)
        for x in range(GRAM):
            h = (h ^ k[x : x + m]) * np.uint64(BASE)
            h ^= h >> np.uint64(32)
        places = np.flatnonzero(one)
        h = h[places]
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        twice = np.zeros(len(places), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        step = np.zeros(len(at) + 1, np.int64)
        np.add.at(step, places[twice], 1)
        np.add.at(step, places[twice] + GRAM, -1)
        kept = at[np.cumsum(step[:-1]) > 0]
        if not len(kept):
            return []
        cut = (np.diff(kept) > 1) | (parts[kept[1:]] != parts[kept[:-1]])
        opens = np.concatenate([[0], np.flatnonzero(cut) + 1])
        lengths = np.diff(np.concatenate([opens, [len(kept)]]))
        long = np.repeat(lengths >= least, lengths)
        kept, number = kept[long], np.repeat(np.arange(len(opens)), lengths)[long]
        if len(kept) > 0.8 * len(at):
            opens, lengths = opens[lengths >= least], lengths[lengths >= least]
            return [] if not len(kept) else _spans(kept, number)
        parts = parts.copy()
        parts[kept] = number
        at = kept


def _spans(places: np.ndarray, number: np.ndarray) -> list[tuple[int, int]]:
    first = np.concatenate([[0], np.flatnonzero(number[1:] != number[:-1]) + 1])
    last = np.concatenate([first[1:], [len(places)]]) - 1
    return list(zip(places[first].tolist(), (places[last] + 1).tolist()))


def word_runs(texts: list[list[bytes]], least: int = 6, times: int = 4) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    keys = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(hash, t), np.int64, len(t)) for t in texts)])
    starts, out = np.concatenate([[0], np.cumsum(sizes)]), [[] for _ in texts]
    spans = repeated_stretches(keys, np.repeat(np.arange(len(texts)), sizes), least)
    if not spans:
        return out
    owners = np.searchsorted(starts, [a for a, _ in spans], "right") - 1
    for (a, b), doc in zip(spans, owners.tolist()):
        base, seen = int(starts[doc]), {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in texts[doc][a - base : b - base]], np.int64)
        out[doc] += [(a - base + s, k, p) for s, k, p in stretch_runs(ids, least, times)]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length over period; ties to the smallest start, then period. ``runs`` are in that order."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that a run has after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, p in runs:
        step[start + p] += 1
        step[start + length] -= 1
    keep = np.cumsum(step[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def split_words(doc_id, text: bytes) -> list[bytes]:
    """Words between white space of ASCII."""
    return text.split()


def planted_words(doc_id, text: bytes) -> list[bytes]:
    """Words of a text; one document of ten gets a periodic end, by the checksum of its id (a null id counts as empty)."""
    words = text.split()
    h = crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


OUT = "doc_id {id}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, words_of: Callable = split_words) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`` of every document.

    ``start, length, period`` are those of the run with the greatest length over period (ties: smallest start, then period); they are null for
    documents without runs, as for null and empty texts. The digests are of all runs and of the words that are left when each run
    keeps its first period only. Null and repeated ids and repeated rows keep their rows, an empty table gives none, other
    columns may have any name. Whole texts are read, in one pass without a shuffle; memory follows the longest text.
    """
    for_long_texts(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def rows(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        out = []
        for doc_id, words, runs in zip(ids, texts, word_runs(texts, least, times)):
            best = best_run(runs)
            more = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            every = "".join(f"{s},{k},{p}\n" for s, k, p in runs)
            out.append((doc_id, len(runs), *more, sha256(every.encode()).hexdigest(), sha256(b" ".join(collapsed(words, runs))).hexdigest()))
        return out

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, size, out = [], [], 0, []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = words_of(doc_id, text.as_buffer().to_pybytes() if text.is_valid else b"")
                ids.append(doc_id)
                texts.append(words)
                size += len(words)
                if size >= WORDS:
                    out += rows(ids, texts)
                    ids, texts, size = [], [], 0
            out += rows(ids, texts)
            columns = list(zip(*out)) or [()] * 8
            kinds = [b.schema.field(0).type, *[pa.int64()] * 5, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f"c{i}" for i in range(8)])

    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return own.mapInArrow(found, OUT.format(id=kind))
