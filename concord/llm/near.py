"""Near-duplicate classes by Order MinHash (operator 2).

Texts are lower-cased words without punctuation. Their k-mers (``k`` words in a row) are labelled by occurrence.
An Order MinHash sketch takes the ``sampled`` smallest k-mers under a random order and hashes them in their
order of appearance in the text, so it favours pairs with a small edit distance. Texts that share any of the
``tables`` sketches are candidates.

Two texts are linked when their alignment has a similarity of ``similarity`` or more. The alignment is banded: shared
k-mers no further apart than the band that this similarity allows are chained in text order, and the longest
chain ``m`` of texts with ``a`` and ``b`` k-mers gives ``m / (a + b - m)``.

Candidates are never paired with each other directly. A bucket's leader is the text whose sketches occur most often
(in a group of variants, the original), and every text is aligned with the leaders of its buckets: one pair for
each text and leader. Texts of one leader that this has not connected are decided by their differences ``D(x)`` from what most
of the group have. For a link between ``u`` and ``w``, ``D(u)`` and ``D(w)`` must share so many k-mers that they meet in a prefix of
``D(w)`` of about half its length; rare k-mers come first there, and few texts share those. So no
link between candidates that matters for the classes is lost, and a large group of variants costs a few pairs for each
text. Identical texts are one node throughout.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from concord.operators.components import connected_components
from concord.session import discard, for_long_texts, stored

WORD = re.compile(r"\w+")
#: Stands for a null identifier in join keys.
NO_ID = -(1 << 63)
MIX = np.uint64(0x9E3779B97F4A7C15)

#: Words a worker remembers before it starts afresh; bounds memory only.
CACHE = 300_000


@dataclass(frozen=True)
class Settings:
    k: int = 5
    sampled: int = 3
    tables: int = 16
    similarity: float = 0.8
    seed: int = 11


class Words(dict):
    """Hashes of words, computed when first asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmers(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-mers of a text, labelled by occurrence; a shorter text is one k-mer of all its words."""
    w = words.astype(np.uint64)
    if not len(w):
        return w
    k = min(k, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = mixed((h + w[i : len(w) - k + 1 + i]) * MIX + np.uint64(k))
    order = np.argsort(h, kind="stable")
    same = np.concatenate([[False], h[order][1:] == h[order][:-1]])
    if same.any():
        at = np.arange(len(h))
        label = np.empty(len(h), np.uint64)
        label[order] = at - np.maximum.accumulate(np.where(same, 0, at))
        h = mixed(h + label * MIX)
    return h


def sketches(h: np.ndarray, s: Settings) -> np.ndarray:
    """``tables`` hashes, each of the ``sampled`` smallest k-mers in text order."""
    seeds = mixed(np.arange(1, s.tables + 1, dtype=np.uint64) * MIX + np.uint64(s.seed))
    n, out, some = min(s.sampled, len(h)), [], max(1, 1_000_000 // len(h))
    for i in range(0, s.tables, some):  # few tables at a time for very long texts
        seed = seeds[i : i + some, None]
        at = np.sort(np.argpartition(mixed(h[None, :] ^ seed), n - 1, axis=1)[:, :n], axis=1)
        x = seed[:, 0]
        for j in range(n):
            x = mixed(x * MIX + h[at[:, j]])
        out.append(x)
    return np.concatenate(out)


def chain(a: np.ndarray, b: np.ndarray, s: Settings) -> int:
    """K-mers in the longest chain of shared k-mers in both texts' order, within the band; 0 if a link is impossible."""
    need = s.similarity * (len(a) + len(b)) / (1 + s.similarity)
    if min(len(a), len(b)) < need:
        return 0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = math.floor(len(a) + len(b) - 2 * need) + 1
    close = np.abs(i - j) <= band
    if close.sum() < need:
        return 0
    i, j = i[close], j[close]
    tails: list[int] = []  # the smallest end of a chain of each length
    for x in j[np.argsort(i)].tolist():
        if not tails or x > tails[-1]:
            tails.append(x)
        else:
            tails[bisect_left(tails, x)] = x
    return len(tails)


def linked(a: np.ndarray, b: np.ndarray, s: Settings) -> bool:
    m = chain(a, b, s)
    return m > 0 and m >= s.similarity * (len(a) + len(b) - m) - 1e-9


def _words(text: str | None, known: Words) -> tuple[bytes, np.ndarray]:
    words = WORD.findall((text or "").lower())
    return xxhash.xxh3_128_digest(" ".join(words)), np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _doc_column(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("check"))


def sketched(docs: DataFrame, s: Settings) -> DataFrame:
    """``doc_id, check, node, n, sketch``: a node is a normalised text, ``n`` its number of k-mers, ``check`` a hash of the raw text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            node, size, flat = [], [], []
            for text in b.column(1).to_pylist():
                key, words = _words(text, known)
                h = kmers(words, s.k)
                node.append(key)
                size.append(len(h))
                flat.append(sketches(h, s).view(np.int64) if len(h) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(node, pa.binary()), pa.array(size, pa.int32()), pa.array(flat, pa.list_(pa.int64()))], ["doc_id", "check", "node", "n", "sketch"])

    return _doc_column(docs).mapInArrow(run, "doc_id long, check long, node binary, n int, sketch array<long>")


def _texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """``node, words`` of the needed nodes, from the one row that stands for each."""

    def run(batches):
        known = Words()
        for b in batches:
            found = [_words(t, known) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())], ["doc_id", "node", "words"])

    every = _doc_column(docs).mapInArrow(run, "doc_id long, node binary, words binary")
    own = every.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).join(needed.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))), ["node", "doc_id"])
    return own.select("node", "words").dropDuplicates(["node"])


def _aligned(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """``a, b, na, nb, d, linked`` of every pair; ``d`` k-mers are in one of the two texts only."""
    left = texts.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    right = texts.select(F.col("node").alias("b"), F.col("words").alias("wb"))

    def run(batches):
        for t in batches:
            na, nb, d, ok = [], [], [], []
            for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist()):
                x, y = (kmers(np.frombuffer(z, np.uint64), s.k) for z in (x, y))
                na.append(len(x))
                nb.append(len(y))
                d.append(len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True)))
                ok.append(linked(x, y, s))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), *(pa.array(v, pa.int32()) for v in (na, nb, d)), pa.array(ok)], ["a", "b", "na", "nb", "d", "linked"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb").mapInArrow(run, "a binary, b binary, na int, nb int, d int, linked boolean")


def _differences(groups: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """``leader, node, ca, open, n, d, place, element`` of every row ``a, b, ca, open, usual``: the k-mers in which the text differs from its group.

    The group's text has the leader's k-mers but for the ``usual`` differences. A row with place -1 comes before them.
    """
    left = texts.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    right = texts.select(F.col("node").alias("b"), F.col("words").alias("wb"))

    def run(batches):
        for t in batches:
            out: list[list] = [[] for _ in range(5)]
            for i, (x, y, usual) in enumerate(zip(*(t.column(c).to_pylist() for c in (2, 3, 4)))):
                x, y = (kmers(np.frombuffer(z, np.uint64), s.k) for z in (x, y))
                if usual:
                    y = np.setxor1d(y, np.array(usual, np.int64).view(np.uint64), assume_unique=True)
                diff = np.concatenate([np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)])
                new = len(x) - (len(x) + len(y) - len(diff)) // 2
                diff = np.concatenate([np.sort(diff[:new]), np.sort(diff[new:])])
                n = len(diff)
                for c, v in zip(out, ([i] * (n + 1), [len(x)] * (n + 1), [n] * (n + 1), range(-1, n), [0, *diff.view(np.int64).tolist()])):
                    c.extend(v)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([*(t.column(c).take(at) for c in (1, 0, 5, 6)), *(pa.array(c, pa.int32()) for c in out[1:4]), pa.array(out[4], pa.int64())], ["leader", "node", "ca", "open", "n", "d", "place", "element"])

    rows = groups.join(left, "a").join(right, "b").select("a", "b", "wa", "wb", "usual", "ca", "open")
    return rows.mapInArrow(run, "leader binary, node binary, ca binary, open boolean, n int, d int, place int, element long")


def _undecided(first: DataFrame, texts: DataFrame, components: DataFrame, s: Settings) -> DataFrame:
    """``a, b``: the pairs within leaders' groups that may be linked and are not connected yet.

    For a link between ``u`` and ``w``, which differ from their group's text in ``D(u)`` and ``D(w)``, at most a share ``f`` of
    their k-mers may differ, so ``D(u)`` and ``D(w)`` must share ``(|D(u)| + |D(w)| - f * (n(u) + n(w))) / 2``. ``slack`` is the least ``|D(u)| - f * n(u)`` of the
    texts that are not connected to the leader: ``w`` shares one of its first ``|D(w)|`` + 1 - that many with each.
    Where that number is 0 or less, both are also that close to the text that is closest to the group's.
    """
    f = (1 - s.similarity) / (1 + s.similarity)
    part = lambda name, out: components.select(F.col("node").alias(name), F.col("component").alias(out))
    rows = first.select("a", "b").join(part("a", "ca"), "a", "left").join(part("b", "cb"), "b", "left")
    rows = rows.select("a", "b", F.coalesce("ca", "a").alias("ca"), (F.coalesce("ca", "a") != F.coalesce("cb", "b")).alias("open"))
    sizes = stored(rows.groupBy("b").agg(F.count("*").alias("members"), F.count_if("open").alias("opened")).where("members > 1 AND opened > 0"), "sizes")
    rows = stored(rows.join(sizes, "b"), "groups")
    plain = _differences(rows.withColumn("usual", F.lit(None).cast("array<long>")), texts, s)
    usual = plain.where("place >= 0").groupBy("leader", "element").agg(F.count("*").alias("times")).join(sizes.select(F.col("b").alias("leader"), "members"), "leader")
    usual = usual.where("times > members / 2").groupBy("leader").agg(F.collect_list("element").alias("usual"))
    usual = stored(usual.withColumnRenamed("leader", "b"), "usual")
    diffs = stored(_differences(rows.join(usual, "b", "left"), texts, s), "differences")
    own = diffs.where("place < 0").select("leader", "node", "ca", "open", "n", "d", (F.col("d") - F.col("n") * f).alias("q"))
    # texts so close to the group's that they need not share a difference: all are compared with the closest
    best = stored(own.groupBy("leader").agg(F.min(F.struct("q", "node", "ca")).alias("m")), "closest")
    close = own.join(best, "leader").where((F.col("q") + F.col("m.q") <= 1e-9) & (F.col("ca") != F.col("m.ca"))).select(F.col("node").alias("a"), F.col("m.node").alias("b"))
    slack = stored(own.where("open").groupBy("leader").agg(F.min("q").alias("slack")), "slack")
    # rare differences first; one that a single text has cannot be shared
    each = diffs.where("place >= 0").drop("place")
    often = each.groupBy("leader", "element").agg(F.count("*").alias("times"))
    place = F.row_number().over(W.partitionBy("leader", "node").orderBy("times", "element")) - 1
    each = each.join(often, ["leader", "element"]).withColumn("place", place).where("times > 1")
    known = stored(each.join(own.join(slack, "leader").select("leader", "node", "slack"), ["leader", "node"]), "known")
    u = known.where("open").select("leader", "element", F.col("node").alias("a"), F.col("n").alias("na"), F.col("d").alias("da"), F.col("place").alias("pa"), "ca")
    shared = F.ceil((F.col("slack") + F.col("d") - F.col("n") * f) / 2 - 1e-9)
    w = known.where((shared <= 0) | (F.col("place") <= F.col("d") - shared)).select("leader", "element", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("d").alias("db"), F.col("place").alias("pb"), F.col("ca").alias("cb"))
    must = (F.col("da") + F.col("db") - (F.col("na") + F.col("nb")) * f) / 2 - 1e-9
    meet = (u["leader"] == w["leader"]) & (u["element"] == w["element"]) & (F.col("ca") != F.col("cb"))
    meet &= F.least("na", "nb") >= F.greatest("na", "nb") * s.similarity - 1e-9
    meet &= F.least(F.col("da") - F.col("pa"), F.col("db") - F.col("pb")) >= must  # for the first that they share
    pairs = u.join(w, meet).select("a", "b").unionByName(close)
    found = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "undecided")
    discard(sizes, rows, usual, diffs, best, slack, known)
    return found


def near_classes(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per document: ``doc_id, class_id, class_size, links``.

    ``class_id`` is the smallest ``doc_id`` of the documents connected by links (null only if none of them has an id),
    ``class_size`` their number, ``links`` the number of other texts that were found linked to the document's text (0 for a
    text that only has copies; texts that are connected already are not compared further). Texts equal after normalisation are one text; so are all texts without words, null
    and empty ones included. Repeated rows and ids keep their rows. Other columns are not read; an empty table gives no rows. A text
    is read in whole, and its memory is some 200 bytes a word. Pairs within a leader's group are only made between texts that share a
    rare difference and as many differences as a link needs; their number is bounded by the pairs of such near misses.
    """
    return _classified(docs, s).select("doc_id", "class_id", "class_size", "links")


def _classified(docs: DataFrame, s: Settings) -> DataFrame:
    """``doc_id, check, component, class_id, class_size, links`` of every row."""
    for_long_texts(docs.sparkSession)
    rows = stored(sketched(docs, s), "sketch")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = stored(nodes, "nodes")
    buckets = nodes.select("node", "n", F.posexplode("sketch").alias("table", "value")).select("node", "n", F.xxhash64("table", "value").alias("bucket"))
    sizes = stored(buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    shared = stored(buckets.join(sizes, "bucket"), "buckets")
    fame = stored(shared.groupBy("node").agg(F.sum("size").alias("fame")), "fame")
    leaders = stored(shared.join(fame, "node").groupBy("bucket").agg(F.max(F.struct("fame", "node"))["node"].alias("b")), "leaders")
    pairs = stored(shared.join(leaders, "bucket").where("node != b").select(F.col("node").alias("a"), "b").distinct(), "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc_id"), "node")
    texts = stored(_texts(docs, needed), "words")
    first = stored(_aligned(pairs, texts, s), "first")

    early = first.where("linked").select("a", "b")
    more = _undecided(first, texts, connected_components(early, "a", "b"), s)
    second = stored(_aligned(more, texts, s), "second")
    edges = early.unionByName(second.where("linked").select("a", "b"))
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    discard(sizes, shared, fame, leaders, pairs, first, more, second, texts)
    components = connected_components(edges, "a", "b")
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    placed = nodes.select("node", "doc_id", "copies").join(components, "node", "left").join(degree, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    classes = placed.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    classes = stored(placed.join(classes, "component").select("node", "component", "class_id", "class_size", F.coalesce("links", F.lit(0)).alias("links")), "classes")
    discard(nodes, edges)
    return rows.select("doc_id", "check", "node").join(classes, "node").select("doc_id", "check", "component", "class_id", "class_size", "links")


def drop_near_copies(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One whole row of each class, with all columns of ``docs``: that with the smallest ``doc_id``.

    Rows without ids come last; of rows repeated with one id and text, the one with the smallest hash of all columns stays.
    """
    lowest = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "check")).alias("m")
    keep = _classified(docs, s).groupBy("component").agg(lowest).select(F.coalesce("m.doc_id", F.lit(NO_ID)).alias("__id"), F.col("m.check").alias("__check"))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__check"))
    one = rows.join(keep, ["__id", "__check"]).groupBy("__id", "__check").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"))
    return one.select("__row.*")
