"""Merges of the lists of two services, which keep both orders as far as they agree."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

OUT = "id string, track_ids array<string>, added long, removed long"


def labelled(tracks: list[str]) -> list[tuple[str, int]]:
    """Tracks with their occurrence, so that a track that a list has twice is two items."""
    seen: Counter = Counter()
    out = []
    for t in tracks:
        out.append((t, seen[t]))
        seen[t] += 1
    return out


def in_both_orders(ours: list, theirs: list) -> list:
    """The longest common subsequence of lists without repeated items; of several the one that ends first in ``theirs``, step by step."""
    at = {x: i for i, x in enumerate(theirs)}
    ends: list[int] = []  # the smallest place in theirs where a chain of each length ends
    last: list[int] = []  # the index in ``common`` of that end
    common = [x for x in ours if x in at]
    before = [-1] * len(common)
    for n, x in enumerate(common):
        k = bisect_left(ends, at[x])
        before[n] = last[k - 1] if k else -1
        ends[k:k + 1], last[k:k + 1] = [at[x]], [n]
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(common[n])
        n = before[n]
    return out[::-1]


def merge(ours: list, theirs: list, base: list | None, both: bool) -> list:
    """Items of both lists in an order that keeps theirs and ours wherever they agree; between agreed items ours come first.

    With a base, items of it stay if neither side has dropped them. Without one all items stay, or with ``both`` those on both sides.
    """
    mine, other, old = set(ours), set(theirs), set(base or [])
    stays = (mine & other) if both else ((mine | other) - old) | (mine & other & old)
    ours, theirs = [x for x in ours if x in stays], [x for x in theirs if x in stays]
    out: list = []
    done: set = set()

    def take(items: list) -> None:
        for x in items:
            if x not in done:
                done.add(x)
                out.append(x)

    i = j = 0
    places = {x: n for n, x in enumerate(ours)}, {x: n for n, x in enumerate(theirs)}
    for x in [*in_both_orders(ours, theirs), None]:
        a, b = (len(ours), len(theirs)) if x is None else (places[0][x], places[1][x])
        take(ours[i:a])
        take(theirs[j:b])
        if x is not None:
            take([x])
        i, j = a + 1, b + 1
    return out


def merged_lists(ours: DataFrame, theirs: DataFrame, base: DataFrame | None = None, how: str = "union") -> DataFrame:
    """``id, track_ids, added, removed`` of every list of either side: ``id, track_ids`` merged by ``union`` or ``intersection``.

    With ``base``, the lists as both sides had them last, a union is a three-way merge: what one side has dropped since goes, what one side has added comes.
    A list that only one side has is merged with an empty one; lists and tracks that are null count as empty and as no track. ``added`` and ``removed``
    are against ``ours``. A track that a list has more than once counts by occurrence. One row holds a list, which bounds the memory.
    """
    side = lambda df, name: df.select("id", F.col("track_ids").alias(name))
    rows = side(ours, "o").join(side(theirs, "t"), "id", "full_outer")
    rows = rows.join(side(base, "b"), "id", "left") if base is not None else rows.withColumn("b", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<string>")
    rows = rows.select("id", *(F.filter(F.coalesce(c, none), lambda x: x.isNotNull()).alias(c) for c in ("o", "t", "b")))
    both = {"union": False, "intersection": True}[how]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, added, removed = [], [], []
            for o, t, b in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                mine = labelled(o)
                out = merge(mine, labelled(t), labelled(b), both)
                lists.append([x for x, _ in out])
                added.append(len(set(out) - set(mine)))
                removed.append(len(set(mine) - set(out)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.string())), pa.array(added, pa.int64()), pa.array(removed, pa.int64())], ["id", "track_ids", "added", "removed"])

    return rows.mapInArrow(run, OUT)
