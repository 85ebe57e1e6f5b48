"""Approximate nearest neighbours: inverted file with product-quantised residuals (operator 9).

Coarse centroids and residual codebooks are fitted on a bounded sample. Every distinct vector is indexed in the lists of its two nearest
centroids, with one byte for each part of its residual. There are about ``sqrt(n)`` lists, as many as the sample supports.

A query visits the lists of its nearest centroids. How many is measured, not set: for ``probes`` queries the true neighbours are
found among all vectors in one pass, and as many lists are visited as these need for a recall of ``recall``. In clustered data these are
few; in data without clusters neighbours lie in many lists, and no index of this kind changes that.

A residual is coded by its direction; its length and what the code leaves of it are kept beside the code, so that near and far groups are coded
equally well. A code gives an estimate of an entry's distance to a query. How far off it may be depends on the bar, the distance that an entry has
to be below, on the length of what its code leaves, and on the angle between the two; only that angle is measured, on the probes and their true
neighbours, so that queries whose neighbours are close do not loosen the bars of those whose neighbours are far.
A query's best estimates are measured first, and the distance of the ``k``-th of them is its bar. Then every entry
of its lists whose estimate allows it to be below the bar is measured exactly, in double precision on the
original vectors. So it is the data that says how many are measured, and a query gets no rows from a block that holds nothing near it.

Lists are packed into blocks of bounded size, and the codes of a block meet the queries that visit it in one stream: codes first, then
any number of queries, batch by batch.

Copies of a vector are one entry with its smallest ids, so a vector that a third of all rows have is no hot list. Centroids, codebooks
and list sizes reach the driver, and the probes with their neighbours; nothing else does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from concord.session import discard, for_long_texts, stored


@dataclass(frozen=True)
class Settings:
    sample: int = 100_000  # vectors that centroids and codebooks are fitted on, at most
    each: int = 8  # sampled vectors for each list, at least
    assign: int = 2  # lists of a vector
    part: int = 2  # components of a vector that one code byte covers
    first: int = 40  # entries of the best estimates that a query's bar is taken from
    block: int = 4096  # codes of a block, at least
    blocks: int = 128  # so many blocks, where that takes no larger ones than ``largest``
    largest: int = 1 << 20
    probes: int = 100
    recall: float = 0.985  # of the probes' neighbours, those that are in visited lists
    close: float = 0.99  # and those that their codes allow for
    seed: int = 5

    def codes(self, n: int) -> int:
        return max(self.block, min(self.largest, -(-self.assign * n // self.blocks)))

    def lists(self, n: int) -> int:
        return max(1, min(round(n**0.5), self.sample // self.each, n // self.each))

    def sampled(self, n: int) -> int:
        return min(n, self.sample, max(20_000, 32 * self.lists(n)))


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, j], minlength=k) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return nearest_few(x, c, 1)[:, 0]


def nearest_few(x: np.ndarray, c: np.ndarray, few: int) -> np.ndarray:
    """The ``few`` nearest rows of ``c`` for each row of ``x``, nearest first."""
    few, square = min(few, len(c)), (c**2).sum(1)
    out = np.empty((len(x), few), np.int64)
    for i in range(0, len(x), 512):
        d = square - 2 * x[i : i + 512] @ c.T
        if few == 1:
            out[i : i + 512, 0] = d.argmin(1)
            continue
        own = np.argpartition(d, few - 1, axis=1)[:, :few]
        out[i : i + 512] = np.take_along_axis(own, np.take_along_axis(d, own, 1).argsort(1, kind="stable"), 1)
    return out


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # lists x dimension
    books: list[np.ndarray]  # for each part of a residual of length 1: codewords x components
    cuts: list[slice]
    unit: float  # the usual length of a residual; lengths are counted in it

    def codes(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of vectors in lists, the lengths of their residuals, and the squared lengths of what the codes leave."""
        rest = (x - self.centroids[lists]) / self.unit
        size = np.sqrt((rest**2).sum(1))
        way = _directions(rest)
        code = np.stack([nearest(way[:, p], b) for p, b in zip(self.cuts, self.books)], 1).astype(np.uint8)
        size = size.astype(np.float32)
        return code, size, ((rest - self.decoded(code, size)) ** 2).sum(1).astype(np.float32)

    def decoded(self, code: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (np.concatenate([b[code[:, m]] for m, b in enumerate(self.books)], 1) * size[:, None]).astype(np.float32)

    def estimates(self, q: np.ndarray, j: int, rest: np.ndarray) -> np.ndarray:
        """Squared distances of queries to what the codes of a list's entries say, less the error of their arithmetic."""
        u = ((q - self.centroids[j]) / self.unit).astype(np.float32)
        own = (u**2).sum(1)[:, None]
        return np.maximum(own - 2 * u @ rest.T + (rest**2).sum(1), 0) - 4e-6 * own


def _swing(bar: np.ndarray, left: np.ndarray) -> np.ndarray:
    """How much an entry at the squared distance ``bar`` can be farther by its code than ``bar + left``: all if both point the same way, a share else."""
    return 2 * np.sqrt(bar * left)


def _directions(rest: np.ndarray) -> np.ndarray:
    size = np.sqrt((rest**2).sum(1, keepdims=True))
    return rest / np.where(size > 0, size, 1)


def _rows(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)


def fit(nodes: DataFrame, n: int, s: Settings) -> Index:
    """Centroids and codebooks from about ``sampled`` vectors, those with the smallest hashes of their entry."""
    most = s.sampled(n)
    share = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(np.ceil(min(1.0, 1.1 * most / n) * (1 << 20)))
    x = np.stack(nodes.where(share).select("node", "v").toArrow().sort_by("node")["v"].to_numpy()).astype(np.float64)
    x = x[np.random.default_rng(s.seed).permutation(len(x))[:most]]
    centroids = kmeans(x, min(len(x), s.lists(n)), s.seed)
    # lists next to each other in number are near each other, so that a query's lists are in few blocks
    groups = nearest(centroids, kmeans(centroids, max(1, round(len(centroids) ** 0.5)), s.seed))
    centroids = centroids[np.argsort(groups, kind="stable")]
    rest = x - centroids[nearest(x, centroids)]
    unit = float(np.sqrt((rest**2).sum(1).mean())) or 1.0
    rest = _directions(rest)
    cuts = [slice(i, min(i + s.part, x.shape[1])) for i in range(0, x.shape[1], s.part)]
    books = [kmeans(rest[:20_000, c], min(256, len(x), 20_000), s.seed + 1 + i, 5) for i, c in enumerate(cuts)]
    return Index(centroids, books, cuts, unit)


def usable(table: DataFrame) -> DataFrame:
    """``vec_id, v``: rows with an id, and a vector that is not null or zero and has only finite components."""
    fine = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    fine &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(fine)


def _distance(a: Column, b: Column) -> Column:
    """Euclidean, in double precision."""
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda t, x: t + x))


def nearest_vectors(table: DataFrame, every: int = 100, k: int = 10, s: Settings = Settings(), figures: dict | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: for rows whose ``vec_id`` is divisible by ``every``, the ``k`` nearest.

    Ties go to the smaller ``vec_id``. A query takes no row with its own id; of query rows with one id the smallest vector is used, and
    repeated candidate rows each count. Vectors of another length than most are compared with those of their length, all of
    them. Null, zero and non-finite vectors take no part; other columns are not read; an empty table gives no rows. Enough
    lists are visited to hold ``k`` candidates, or all of them. ``figures`` gets the numbers of lists and of vectors visited and of pairs measured.
    """
    for_long_texts(table.sparkSession)
    whole = usable(table)
    # copies of a vector: its smallest ids, how often each occurs
    at = F.dense_rank().over(W.partitionBy("v").orderBy("vec_id"))
    ids = whole.withColumn("at", at).where(F.col("at") <= k + 1).groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).alias("times"))
    nodes = ids.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "times"))).alias("ids"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), F.size("v").alias("d"), "v", "ids"), "vectors")
    queries = whole.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = stored(queries.join(nodes.select("v", "node", "d"), "v").select(F.col("vec_id").alias("query_id"), "node", "d", "v"), "queries")
    most = nodes.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    d = most["d"] if most else 0
    pairs = asked.where(F.col("d") != d).select(F.col("node").alias("q"), F.col("v").alias("w"), "d").distinct().join(nodes.where(F.col("d") != d), "d").select("q", "ids", _distance(F.col("w"), F.col("v")).alias("score"))
    if most:
        pairs = pairs.unionByName(_searched(nodes.where(F.col("d") == d), asked.where(F.col("d") == d), d, most["count"], k, s, figures))
    near = pairs.select("q", F.inline("ids"), "score").select("q", "vec_id", "times", "score")
    rank = F.row_number().over(W.partitionBy("q").orderBy("score", "vec_id"))
    near = near.withColumn("n", rank).where(F.col("n") <= 2 * k + 2).groupBy(F.col("q").alias("node")).agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score", "times"))).alias("near"))
    own = asked.select("query_id", "node").join(stored(near, "near"), "node")
    others = own.select("query_id", F.explode(F.filter("near", lambda x: x.vec_id != F.col("query_id"))).alias("x")).select("query_id", "x.*")
    # a row for each candidate row
    rows = others.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id", "copy"))
    return rows.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _neighbours_of(nodes: DataFrame, probes: np.ndarray, own: np.ndarray, k: int, centre: np.ndarray) -> DataFrame:
    """``probe, node``: the ``k`` entries nearest to each probe, by one pass over all vectors."""
    probes = probes - centre

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(probes), k), np.inf)
        ids = np.zeros((len(probes), k), np.int64)
        for b in batches:
            x = _rows(b.column(1), probes.shape[1]) - centre
            d = (x**2).sum(1) - 2 * probes @ x.T
            node = b.column(0).to_numpy()
            d[own[:, None] == node] = np.inf
            d, node = np.concatenate([best, d], 1), np.concatenate([ids, np.broadcast_to(node, d.shape)], 1)
            at = np.argpartition(d, k - 1, axis=1)[:, :k]
            best, ids = np.take_along_axis(d, at, 1), np.take_along_axis(node, at, 1)
        probe, at = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(probe, pa.int64()), pa.array(ids[probe, at]), pa.array(best[probe, at])], ["probe", "node", "score"])

    rank = F.row_number().over(W.partitionBy("probe").orderBy("score", "node"))
    found = nodes.select("node", "v").mapInArrow(job, "probe long, node long, score double")
    return found.withColumn("n", rank).where(F.col("n") <= k).select("probe", "node")


def _firsts(order: tuple, *columns: np.ndarray, most: int, of: tuple) -> list[np.ndarray]:
    """The first ``most`` rows of each group of equal ``of`` in an order (last key first), which has these as its first keys."""
    at = np.lexsort(order)
    new = np.concatenate([[True], np.any([x[at][1:] != x[at][:-1] for x in of], axis=0)]) if len(at) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    place = np.arange(len(at)) - start[np.cumsum(new) - 1]
    return [c[at[place < most]] for c in columns]


def _searched(nodes: DataFrame, asked: DataFrame, d: int, n: int, k: int, s: Settings, figures: dict | None) -> DataFrame:
    """``q, ids, score``: for each entry that is asked about, the entries that its bar leaves, with their true distance."""
    spark, index = nodes.sparkSession, fit(nodes, n, s)
    lists, most = len(index.centroids), s.codes(n)

    def place(batches):
        for b in batches:
            x = _rows(b.column(1), d)
            near = nearest_few(x, index.centroids, s.assign)
            at, own = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
            code, size, left = index.codes(x[at], own)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(size), pa.array(left)], ["node", "list", "code", "size", "left"])

    codes = stored(nodes.select("node", "v").mapInArrow(place, "node long, list int, code binary, size float, left float"), "codes")
    held = {r[0]: r[1] for r in codes.groupBy("list").count().collect()}  # a row for each list
    sizes = np.array([held.get(i, 0) for i in range(lists)])
    first, parts, block, room = np.zeros(lists, np.int64), np.maximum(1, -(-sizes // most)), 0, most
    for i in range(lists):  # lists in a row share a block while they fit; a larger one has blocks of its own
        if sizes[i] > room:
            block, room = block + 1, most
        first[i] = block
        room -= sizes[i]
        if parts[i] > 1:
            block, room = block + int(parts[i]), most

    # the probes are few, and so are their neighbours and the codes of these
    unique = asked.groupBy("node").agg(F.first("v").alias("v"))
    rows = unique.orderBy(F.xxhash64("node"), "node").limit(s.probes).toArrow()
    probes, own = np.stack(rows["v"].to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, d)), rows["node"].to_numpy()
    true = _neighbours_of(nodes, probes, own, min(k, n), index.centroids.mean(0))
    place_of = np.argsort(nearest_few(probes, index.centroids, lists), axis=1)
    known = true.join(codes, "node").join(nodes.select("node", "v"), "node").collect() if len(rows) else []
    need, angles, bars = {}, {}, {}
    for r in known:  # the bar of a probe is its farthest neighbour
        bars[r.probe] = max(bars.get(r.probe, 0.0), float((((probes[r.probe] - np.array(r.v, np.float64)) / index.unit) ** 2).sum()))
    for r in known:
        at, q = (r.probe, r.node), probes[r.probe]
        rest = index.decoded(np.frombuffer(r.code, np.uint8)[None], np.array([r.size], np.float32))
        over = float(index.estimates(q[None], r.list, rest)[0, 0]) - r.left - bars[r.probe]
        swing = float(_swing(bars[r.probe], r.left))
        need[at] = min(need.get(at, lists), int(place_of[r.probe][r.list]))
        angles[at] = min(angles.get(at, 1.0), over / swing if swing > 0 else 0.0)
    upto = lambda x, share: sorted(x)[min(len(x) - 1, int(np.ceil(share * len(x))) - 1)]
    visited = upto(need.values(), s.recall) + 1 if need else lists
    angle = min(1.0, max(0.0, upto(angles.values(), s.close))) if angles else 1.0
    if figures is not None:
        order = np.argsort(place_of, axis=1)
        figures |= {"vectors": n, "lists": lists, "visited lists": visited, "angle": round(angle, 3), "codes read for a query": round(float(np.mean(np.sort(sizes[order[:, :visited]].sum(1)))) if len(rows) else 0)}

    def visits(batches):
        for b in batches:
            q = _rows(b.column(1), d)
            row, to, which = [], [], []
            for i, near in enumerate(nearest_few(q, index.centroids, lists)):
                enough = int(np.searchsorted(np.cumsum(sizes[near]), 2 * s.assign * (k + 1))) + 1
                near = near[: max(enough, visited)]
                blocks = np.concatenate([np.arange(first[j], first[j] + parts[j]) for j in near])
                owner = np.repeat(near, parts[near])
                for x in np.unique(blocks):
                    row.append(i)
                    to.append(x)
                    which.append(owner[blocks == x].astype(np.int32).tobytes())
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), b.column(0).take(at), pa.array(which, pa.binary()), b.column(1).take(at), b.column(2).take(at)], ["block", "node", "code", "v", "bar"])

    kind = nodes.schema["v"].dataType.simpleString()
    where = spark.createDataFrame(list(zip(range(lists), first.tolist(), parts.tolist())), "list int, first long, parts long")  # a row for each list
    entries = codes.join(F.broadcast(where), "list").select((F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block"), "node", "code", F.lit(None).cast(kind).alias("v"), F.lit(None).cast("double").alias("bar"), "list", "size", "left")

    def candidates(asks: DataFrame, below: bool) -> DataFrame:
        """``q, node, about``: the ``k`` best of each block by their estimates, or all that may be ``below`` the query's bar."""

        def search(batches):
            block, held, ready = None, [], None
            for b in batches:
                which, is_ask = b.column("block").to_numpy(), np.asarray(b.column("v").is_valid())
                edges = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (is_ask[1:] != is_ask[:-1])])).tolist() + [b.num_rows]
                for i, j in zip(edges, edges[1:]):
                    if which[i] != block:
                        block, held, ready = which[i], [], None
                    part = b.slice(i, j - i)
                    if not is_ask[i]:
                        held.append(part)
                        continue
                    if ready is None:
                        if not held:
                            continue
                        t = pa.Table.from_batches(held).sort_by("list")
                        ready = t["node"].to_numpy(), t["list"].to_numpy(), np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(t.num_rows, -1), t["size"].to_numpy(), t["left"].to_numpy()
                        held = []
                    for m in range(0, len(part), 128):
                        yield from found(part.slice(m, 128), *ready)

        def found(part, node, of, code, size, left):
            q, ids = _rows(part.column("v"), d), part.column("node").to_numpy()
            bar = (part.column("bar").to_numpy(zero_copy_only=False) / index.unit) ** 2
            wants = [np.frombuffer(x, np.int32) for x in part.column("code").to_pylist()]
            wanted, row = np.concatenate(wants), np.repeat(np.arange(len(q)), [len(x) for x in wants])
            best = []
            for j in np.unique(wanted):
                rows, (lo, hi) = row[wanted == j], np.searchsorted(of, [j, j + 1])
                for at in range(lo, hi, 8192):
                    cut = slice(at, min(hi, at + 8192))
                    about = index.estimates(q[rows], j, index.decoded(code[cut], size[cut]))
                    if below:  # a number that is not finite is measured
                        upper = bar[rows, None] * (1 + 1e-5)
                        x, y = np.nonzero(~(about - left[cut] - angle * _swing(upper, left[cut]) > upper))
                        yield result(ids[rows[x]], node[cut][y], about[x, y])
                    else:
                        about += left[cut]
                        few = min(k + 1, about.shape[1])
                        y = np.argpartition(about, few - 1, axis=1)[:, :few].ravel()
                        x = np.repeat(np.arange(len(rows)), few)
                        best.append((rows[x], node[cut][y], about[x, y]))
            if best:
                x, y, about = map(np.concatenate, zip(*best))
                x, y, about = _firsts((about, y, x), x, y, about, most=1, of=(x, y))  # an entry may be in two of the lists
                x, y, about = _firsts((about, x), x, y, about, most=k + 1, of=(x,))
                yield result(ids[x], y, about)

        def result(q, node, about):
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(node), pa.array(about.astype(np.float32))], ["q", "node", "about"])

        calls = asks.mapInArrow(visits, f"block long, node long, code binary, v {kind}, bar double")
        stream = entries.unionByName(calls, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.col("v").isNotNull())
        return stream.mapInArrow(search, "q long, node long, about float").where("q <> node").groupBy("q", "node").agg(F.min("about").alias("about"))

    own = unique.select(F.col("node").alias("q"), F.col("v").alias("w"))
    measured = lambda pairs: pairs.join(nodes, "node").join(own, "q").select("q", "node", "ids", _distance(F.col("w"), F.col("v")).alias("score"))
    rank = F.row_number().over(W.partitionBy("q").orderBy("about", "node"))
    likely = candidates(unique.withColumn("bar", F.lit(None).cast("double")), below=False).withColumn("n", rank).where(F.col("n") <= s.first)
    near = measured(likely.select("q", "node")).select("q", "node", "score")
    rank = F.row_number().over(W.partitionBy("q").orderBy("score", "node"))
    near = stored(near.withColumn("n", rank).where(F.col("n") <= k), "next")
    bars = near.where(F.col("n") == k).select(F.col("q").alias("node"), F.col("score").alias("bar"))
    below = candidates(unique.join(bars, "node", "left").select("node", "v", "bar"), below=True).select("q", "node")
    # copies of the query's own vector are its nearest
    short = stored(below.unionByName(near.select("q", "node")).distinct().unionByName(unique.select(F.col("node").alias("q"), "node")), "shortlist")
    if figures is not None:
        figures |= {"pairs measured": short.count()}
    discard(codes, near)
    return measured(short).drop("node")
