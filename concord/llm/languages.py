"""Language identification by unigram pieces, summed over all segmentations (operator 13).

Each language has probabilities of the pieces of one fixed public vocabulary. The probability of a stretch of text (a word with its space
before it) is the sum over all its segmentations into pieces, which a forward pass over its bytes gives; a text's is the product over its
stretches. Bytes that are no piece of their own are pieces by byte fallback, so every text has segmentations.

The probabilities are learned by expectation maximisation: forward and backward passes give the expected counts of pieces in each
language's training words; tasks sum them, and the driver sees one row for each language and piece. The training
texts are those of the ``sample`` rows of each language with the smallest hashes, a bounded sample; scores are for whole texts of all documents.
Words are letters in lower case: capitals, which training texts may not have, digits and other signs say nothing.

Passes run over many stretches at a time, in numpy. A word of over ``stretch`` bytes is cut there (between characters), so
segmentations over the cuts are not summed; that bounds the exponents and the memory.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F

from concord.session import for_long_texts, stored

#: Stretches a worker remembers before it starts afresh; bounds memory only.
CACHE = 300_000

#: Each byte's factor, which keeps products of small probabilities away from the smallest doubles.
LIFT = 256.0


@dataclass(frozen=True)
class Settings:
    sample: int = 2000  # training rows of each language
    rounds: int = 4  # of expectation maximisation
    smooth: float = 0.1  # added to each piece's expected count
    stretch: int = 32  # bytes


class Pieces:
    """The pieces of a vocabulary by their bytes, and a tree of their beginnings in arrays."""

    _loaded: dict[str, Pieces] = {}

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.ids: dict[bytes, int] = {}
        for i in range(self.size):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[model.id_to_piece(i).encode()] = i
        for i in range(self.size):
            if model.is_byte(i):
                self.ids.setdefault(bytes([int(model.id_to_piece(i)[1:-1], 16)]), i)
        nodes: dict[bytes, int] = {b"": 0}
        for piece in self.ids:
            for k in range(1, len(piece) + 1):
                nodes.setdefault(piece[:k], len(nodes))
        inner = {n[:-1] for n in nodes if n}
        self.row = np.full(len(nodes), -1, np.int32)  # of the table of next nodes; -1 where no piece goes on
        self.row[[nodes[n] for n in inner]] = np.arange(len(inner))
        self.next = np.zeros((len(inner), 256), np.int32)  # 0: no piece goes on so
        for n, i in nodes.items():
            if n:
                self.next[self.row[nodes[n[:-1]]], n[-1]] = i
        self.piece = np.full(len(nodes), -1, np.int32)
        self.piece[[nodes[n] for n in self.ids]] = list(self.ids.values())

    @classmethod
    def load(cls, path: str) -> Pieces:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]


#: Words are letters with their marks; digits and other signs say nothing of a language.
LETTERS = regex.compile(r"[\p{L}\p{M}]+")


def text_words(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def stretches(words: list[str], most: int) -> list[bytes]:
    """Words, each with the vocabulary's sign for the space before it, in stretches of up to ``most`` bytes."""
    out = []
    for word in words:
        data = f"▁{word}".encode()
        while len(data) > most:
            cut = most
            while cut > most - 4 and data[cut] & 0xC0 == 0x80:
                cut -= 1
            out.append(data[:cut])
            data = data[cut:]
        out.append(data)
    return out


class Arcs:
    """All pieces inside some stretches: stretch, from, to and piece, in order of ``to``."""

    def __init__(self, words: list[bytes], pieces: Pieces):
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat, stops = np.frombuffer(b"".join(words), np.uint8), np.cumsum(self.sizes)
        owner = np.repeat(np.arange(len(words)), self.sizes)
        begin, at, node, found = stops - self.sizes, np.arange(len(flat)), np.zeros(len(flat), np.int32), []
        here, stop = at, stops[owner]
        while len(at):  # all beginnings at once, a byte a round
            node = pieces.next[pieces.row[node], flat[here]]
            live = node > 0
            at, node, here = at[live], node[live], here[live] + 1
            piece = pieces.piece[node]
            hit = piece >= 0
            found.append((at[hit], here[hit], piece[hit]))
            on = (here < stop[at]) & (pieces.row[node] >= 0)
            at, node, here = at[on], node[on], here[on]
        at, here, piece = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        word = owner[at]
        to = here - begin[word]
        order = np.argsort(to.astype(np.int16), kind="stable")
        self.word, self.piece, self.to = word[order], piece[order], to[order]
        self.start = (at - begin[word])[order]
        self.most = int(self.sizes.max(initial=0))
        self.cuts = np.searchsorted(self.to, np.arange(self.most + 2))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """``[byte, stretch, language]``: summed probability of each beginning. ``p`` has each arc's (arc, language), with its lift."""
        sums = np.zeros((self.most + 1, len(self.sizes), p.shape[1]))
        sums[0] = 1
        for to in range(1, self.most + 1):
            x = slice(self.cuts[to], self.cuts[to + 1])
            value = sums[self.start[x], self.word[x]] * p[x]
            for lang in range(p.shape[1]):
                sums[to, :, lang] = np.bincount(self.word[x], value[:, lang], len(self.sizes))
        return sums

    def lifted(self, table: np.ndarray) -> np.ndarray:
        """Probabilities of the arcs from ``[piece, language]``."""
        return table[self.piece] * (LIFT ** np.arange(self.most + 1))[self.to - self.start][:, None]


def log_probabilities(words: list[bytes], table: np.ndarray, pieces: Pieces) -> np.ndarray:
    """``[stretch, language]``: log probability over all segmentations."""
    arcs = Arcs(words, pieces)
    sums = arcs.forward(arcs.lifted(table))
    return np.log(sums[arcs.sizes, np.arange(len(words))]) - (arcs.sizes * np.log(LIFT))[:, None]


def expected_counts(words: list[bytes], n: np.ndarray, lang: np.ndarray, table: np.ndarray, pieces: Pieces) -> np.ndarray:
    """``[piece, language]``: expected uses of the pieces in ``n`` copies of each stretch in its language."""
    arcs = Arcs(words, pieces)
    p = arcs.lifted(table)[np.arange(len(arcs.to)), lang[arcs.word]]
    ahead = arcs.forward(p[:, None])[:, :, 0]
    back = np.zeros((arcs.most + 1, len(words)))
    back[arcs.sizes, np.arange(len(words))] = 1
    for to in range(arcs.most, 0, -1):
        x = slice(arcs.cuts[to], arcs.cuts[to + 1])
        np.add.at(back, (arcs.start[x], arcs.word[x]), back[to, arcs.word[x]] * p[x])
    whole = ahead[arcs.sizes, np.arange(len(words))]
    use = ahead[arcs.start, arcs.word] * p * back[arcs.to, arcs.word] / whole[arcs.word] * n[arcs.word]
    return np.bincount(arcs.piece * table.shape[1] + lang[arcs.word], use, pieces.size * table.shape[1]).reshape(pieces.size, -1)


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of ``doc_id`` as text, modulo 3, is 1. A null ``doc_id`` counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_words(docs: DataFrame, s: Settings) -> DataFrame:
    """``lang, word, n``: stretches of the sampled training texts of each language, with their counts.

    A language's sample is its ``sample`` rows with the smallest hashes of id and text; of equal rows one is in it.
    """
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("h"))
    # hashes are even, so of ``n`` rows those below a share of ``4 * sample / n`` hold the smallest ``sample``; they are few
    share = own.groupBy("lang").agg((4.0 * s.sample / F.approx_count_distinct("h")).alias("share"))
    few = own.join(F.broadcast(share), "lang").where(F.col("h") <= F.col("share") * 2.0**63)  # a row for each language
    few = stored(few.groupBy("lang", "h").agg(F.min("text").alias("text")), "few")
    last = few.groupBy("lang").agg(F.sort_array(F.collect_list("h")).alias("h")).select("lang", F.expr(f"get(h, least({s.sample}, size(h)) - 1)").alias("last"))
    chosen = few.join(F.broadcast(last), "lang").where("h <= last").select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n.update((lang, w) for w in stretches(text_words(text), s.stretch))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.binary()), pa.array(list(n.values()), pa.int64())], ["lang", "word", "n"])

    return chosen.mapInArrow(counted, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, vocabulary: str, s: Settings = Settings()) -> tuple[list[str], np.ndarray]:
    """The learned languages in order, and ``[piece, language]`` probabilities: languages times vocabulary, which is the model."""
    words = stored(training_words(docs, s), "words")
    langs = sorted(r[0] for r in words.select("lang").distinct().collect())
    pieces = Pieces.load(vocabulary)
    table = np.full((pieces.size, len(langs)), 1 / pieces.size)
    place = {x: i for i, x in enumerate(langs)}
    for _ in range(s.rounds if langs else 0):
        small = table.astype(np.float32)

        def partial(batches: Iterator[pa.RecordBatch], small=small) -> Iterator[pa.RecordBatch]:
            own, total = Pieces.load(vocabulary), np.zeros(small.shape)
            for b in batches:
                for i in range(0, b.num_rows, 4000):
                    c = b.slice(i, 4000)
                    lang = np.array([place[x] for x in c.column(0).to_pylist()], np.int64)
                    total += expected_counts(c.column(1).to_pylist(), c.column(2).to_numpy().astype(float), lang, small.astype(float), own)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        rows = words.mapInArrow(partial, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(table.shape)
        counts[rows["piece"].to_numpy(), rows["lang"].to_numpy()] = rows["n"].to_numpy()
        counts = np.round(counts, 6) + s.smooth  # sums come in any order
        table = counts / counts.sum(axis=0)
    return langs, table


class _Numbers(dict):
    """Numbers stretches in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Scorer:
    """Log probabilities of whole texts in each language; a word's are computed once."""

    def __init__(self, table: np.ndarray, pieces: Pieces, s: Settings):
        self.table, self.pieces, self.settings = table, pieces, s
        self._forget()

    def _forget(self) -> None:
        self.known, self.value = _Numbers(), np.zeros((0, self.table.shape[1]))

    def _learn(self) -> None:
        """Values of the words that got a number since the last call."""
        new = list(islice(reversed(self.known), len(self.known) - len(self.value)))[::-1]
        values = [self.value]
        for i in range(0, len(new), 10_000):
            parts = [stretches([w], self.settings.stretch) for w in new[i : i + 10_000]]
            logs = log_probabilities([x for p in parts for x in p], self.table, self.pieces)
            at = np.cumsum([0, *map(len, parts)])
            sums = np.concatenate([np.zeros((1, logs.shape[1])), np.cumsum(logs, axis=0)])
            values.append(sums[at[1:]] - sums[at[:-1]])
        self.value = np.concatenate(values)

    def batch(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > CACHE:
            self._forget()
        rows = [np.fromiter(map(self.known.__getitem__, w), np.int64, len(w)) for w in map(text_words, texts)]
        self._learn()
        return np.array([self.value[r].sum(axis=0) for r in rows]).reshape(len(texts), self.table.shape[1])


def predicted_languages(docs: DataFrame, vocabulary: str, s: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document, from its text alone.

    ``score`` is the posterior probability of the predicted language when all learned languages are equally likely beforehand; ties go to
    the first by name. Texts that are null or have no letter are ``und`` with score 0, and so is every text when no language was learned. Null
    and repeated ids and repeated rows keep their rows, an empty table gives none; other columns may have any name.
    """
    for_long_texts(docs.sparkSession)
    langs, table = fit(docs, vocabulary, s)
    small = table.astype(np.float32)  # languages times vocabulary

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(small.astype(float), Pieces.load(vocabulary), s)
        for b in batches:
            names, scores = [], []
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                z = scorer.batch(c.column(2).to_pylist())
                best = z.argmax(axis=1)
                some = c.column(3).to_pylist()
                names += [langs[k] if ok else "und" for k, ok in zip(best.tolist(), some)]
                scores.append(np.where(some, 1 / np.exp(z - z.max(axis=1)[:, None]).sum(axis=1), 0.0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))], ["doc_id", "held_out", "lang_pred", "score"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text.alias("text"), text.rlike(r"\p{L}").alias("some"))
    if not langs:
        return own.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return own.mapInArrow(predicted, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")
