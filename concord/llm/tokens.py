"""Token counts by prefix dynamic programming (operator 1).

A byte-level BPE splits a text into pieces and merges inside each piece. For one
piece, ``last[i]`` is the only token that can end a correct encoding of its first
``i`` bytes: a token that ends there and that the merges keep apart from
``last[i - len(token)]``. Then ``count[i] = count[i - len(token)] + 1`` is the exact
token count of every prefix, found in one pass without encoding any prefix again.

Pieces are cut by the vocabulary's public pattern. A text's prefix table is the sum of
its pieces' tables; pieces repeat, so every worker keeps tables of pieces it has met.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from concord.session import for_long_texts

#: Fixed value: the splitting pattern of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries of each of a worker's three tables (chunks, prefixes, token pairs) before it starts afresh; bounds memory only.
CACHE = 600_000

#: Longer pieces (bytes) have a table of their own, which is dropped after the piece.
LONG = 200


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts of every prefix, for one ``tokenizers`` byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = _byte_letters()
        as_bytes = lambda s: bytes(letter[c] for c in s)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        added = set(self.special)
        self.vocab = {as_bytes(t) for t in spec["model"]["vocab"] if t not in added}
        self.rank = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(merges)}
        self.halves = {a + b: (a, b) for a, b in self.rank}
        self.ends: dict[bytes, list] = {}
        self.starts: dict[bytes, list] = {}
        sizes: dict[bytes, set[int]] = {}
        for t in self.vocab:  # lengths of the tokens with the same last three bytes
            if len(t) > 2:
                sizes.setdefault(t[-3:], {2, 1}).add(len(t))
        self.sizes = {k: tuple(sorted(v, reverse=True)) for k, v in sizes.items()}
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.states: dict[bytes, tuple[bytes, int]] = {b"": (b"", 0)}
        self.chunks: dict[str, int] = {}

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts at a token's edge while it forms, each with the rank of the merge that takes it up."""
        found, taken = [], len(self.rank)
        while True:
            found.append((token, taken))
            if token not in self.halves:
                return found
            taken = self.rank[self.halves[token]]
            token = self.halves[token][side]

    def _kept_apart(self, a: bytes, b: bytes) -> bool:
        """Whether the merges encode ``a + b`` as exactly these two tokens.

        They do unless some part at the end of ``a`` and some part at the start of ``b`` merge before
        either is taken up inside its own token. Of equal merges the left one comes first.
        """
        if len(self.apart) >= CACHE:
            self.apart.clear()
        for side, token, spines in ((1, a, self.ends), (0, b, self.starts)):
            if token not in spines:
                spines[token] = self._spine(token, side)
        rank = self.rank
        fits = True
        for x, x_taken in self.ends[a]:
            for y, y_taken in self.starts[b]:
                r = rank.get((x, y))
                if r is not None and r < x_taken and r <= y_taken:
                    fits = False
        self.apart[a, b] = fits
        return fits

    def piece(self, data: bytes) -> list[int]:
        """Token count of every prefix of one piece: entry ``i`` is that of ``data[:i + 1]``."""
        if len(data) > LONG:
            return self._long(data)[1:].tolist()
        self._extend(data)
        return [self.states[data[:i]][1] for i in range(1, len(data) + 1)]

    def _extend(self, data: bytes) -> int:
        """Fill the table of (last token, count) for every prefix of a piece; the whole piece's count.

        Pieces share prefixes, so the pass starts after the longest prefix in the table.
        """
        if len(data) > LONG:
            return self._long(data)[-1]
        states, vocab, apart, sizes, few = self.states, self.vocab, self.apart, self.sizes, (2, 1)
        if len(states) > CACHE:
            states.clear()
            states[b""] = (b"", 0)
        end = len(data)
        while data[:end] not in states:
            end -= 1
        while end < len(data):
            end += 1
            for size in sizes.get(data[max(0, end - 3) : end], few):  # longest token first
                token = data[end - size : end]
                if size <= end and token in vocab:
                    before, n = states[data[: end - size]]
                    fits = size == end or apart.get((before, token))
                    if fits is None:
                        fits = self._kept_apart(before, token)
                    if fits:
                        states[data[:end]] = (token, n + 1)
                        break
        return states[data][1]

    def _long(self, data: bytes) -> array:
        """Token counts of all prefixes of a long piece, the empty one first: the same pass over arrays by position."""
        vocab, apart, sizes, few = self.vocab, self.apart, self.sizes, (2, 1)
        last, count = array("i", [0]), array("q", [0])  # length of the last token, tokens
        for end in range(1, len(data) + 1):
            for size in sizes.get(data[max(0, end - 3) : end], few):  # longest token first
                token, at = data[max(0, end - size) : end], end - size
                if at >= 0 and token in vocab:
                    before = data[at - last[at] : at]
                    fits = at == 0 or apart.get((before, token))
                    if fits is None:
                        fits = self._kept_apart(before, token)
                    if fits:
                        last.append(size)
                        count.append(count[at] + 1)
                        break
            else:
                raise KeyError(data[max(0, end - 3) : end])
        return count

    def _segments(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            if m.start() > at:
                yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def table(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets of the piece ends and the exact token count of the text up to each."""
        ends, counts = [], []
        for part, special in self._segments(text):
            for p in [part] if special else self.pattern.findall(part):
                data = p.encode()
                ends.append(len(data))
                counts.append(1 if special else self._extend(data))
        return np.cumsum(ends, dtype=np.int64), np.cumsum(counts, dtype=np.int64)

    def prefix_count(self, text: str, n_chars: int, table: tuple[np.ndarray, np.ndarray] | None = None) -> int:
        """Token count of ``text[:n_chars]`` from the text's table.

        Only the pieces at the cut are looked at: white space on both sides of a cut can form one
        piece, so the count restarts two pieces before it.
        """
        ends, counts = table or self.table(text)
        data = text.encode()
        cut = len(text[:n_chars].encode())
        back = max(0, int(np.searchsorted(ends, cut, side="right")) - 2)
        head, seen = (int(ends[back - 1]), int(counts[back - 1])) if back else (0, 0)
        tail = self._segments(data[head:cut].decode())
        return seen + sum(1 if s else sum(self._extend(p.encode()) for p in self.pattern.findall(t)) for t, s in tail)

    def _chunks(self, text: str) -> tuple[list[str], list[int]] | None:
        """The text cut before blanks, and the token count of each chunk; None where a blank may not open a piece."""
        if self.cut is not None and self.cut.search(text):
            return None
        parts, known = text.split(" "), self.chunks
        parts[1:] = [" " + p for p in parts[1:]]
        new = [p for p in parts if p not in known]
        if any(p == " " or p[:1] == " " and p[1:2].isspace() for p in new):
            return None
        for p in new:
            known[p] = sum(self._extend(x.encode()) for x in self.pattern.findall(p))
        counts = list(map(known.__getitem__, parts))
        for p in new:
            if len(p) > 100:
                known.pop(p, None)
        if len(known) > CACHE:
            known.clear()
        return parts, counts

    def count(self, text: str) -> int:
        """Token count of the whole text: the last entry of its prefix table.

        Texts whose blanks are single are cut at blanks, since a blank opens a piece of its own there.
        """
        return self.fit(text, None)[0]

    def fit(self, text: str, limit: int | None) -> tuple[int, int]:
        """Token count of the whole text, and the bytes of its longest prefix of whole pieces that has at most ``limit`` tokens.

        Both are read off the prefix counts: at the chunks' ends, or at the pieces' ends where the text isn't cut into chunks.
        """
        found = self._chunks(text)
        if found is None:
            ends, counts = self.table(text)
            total = int(counts[-1]) if len(counts) else 0
            if limit is None or total <= limit:
                return total, int(ends[-1]) if len(ends) else 0
            k = int(np.searchsorted(counts, limit, side="right"))
            return total, int(ends[k - 1]) if k else 0
        parts, counts = found
        total = sum(counts)
        if limit is None or total <= limit:
            return total, -1
        k = int(np.searchsorted(np.cumsum(counts), limit, side="right"))
        return total, len("".join(parts[:k]).encode())


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit, fit_bytes``.

    ``fit_bytes`` is where a text may be cut to have at most ``limit`` tokens: after the last whole piece that fits (all bytes
    for texts within the limit). Null texts count as empty (0 bytes, 0 tokens); null and repeated ``doc_id`` pass through; other
    columns are not read; an empty table gives no rows. One pass over the scan, no shuffle; memory is one batch, the bounded
    caches and, for a piece of very many bytes, 12 bytes for each of them.
    """
    for_long_texts(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(vocabulary)
        for b in batches:
            found = [counter.fit(t, limit) for t in b.column(1).to_pylist()]
            n, size = np.array([f[0] for f in found], np.int64), b.column(2).to_numpy()
            cut = np.where(n > limit, np.array([f[1] for f in found], np.int64), size)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(n > limit), pa.array(cut)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_bytes"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n"))
    return own.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long")


def prefix_tables(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The stored prefix tables: ``doc_id, ends, counts`` (byte offset of each piece end, tokens up to there).

    ``element_at`` on these arrays answers truncation and budget questions without encoding again; for a prefix that ends inside a
    piece, ``PrefixCounter.prefix_count`` adds that piece's own table. Empty and null texts have empty arrays.
    """
    for_long_texts(docs.sparkSession)

    def run(batches):
        counter = PrefixCounter(vocabulary)
        for b in batches:
            tables = [counter.table(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t[0] for t in tables], pa.list_(pa.int64())), pa.array([t[1] for t in tables], pa.list_(pa.int64()))], ["doc_id", "ends", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ends array<long>, counts array<long>")
