"""Mixing sources to target weights by proportionate-fair scheduling (operator 5).

A source's documents are cut into blocks of equal text volume. With weight ``w`` (a share of all slots), block ``j`` of a
source may be placed from slot ``floor(j / w)`` on and must be placed before slot ``ceil((j + 1) / w)``. One slot after
another takes, of what is released, the block with the earliest deadline. Weights that fill every slot always allow this, and
at each slot a source has had less than one block more or less than its weight asks for.

Sources of about the same weight (within 2.2 %) form a class and get equal weights. The schedule is made for the classes, and a class's
slots go to its sources in turn, which keeps each of them within one block as well. There are at most ``STEPS`` classes for
each doubling of the weight, however many sources there are, so the schedule's period and the fold that computes it are bounded.
Shares of classes are whole, so the schedule repeats after a period, and a document finds its slot by arithmetic on its block number.

Block numbers come from running sums over groups salted by a hash of id and text, so a source with a third of all rows, or with
a third of all ids null, is no hot key. Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from concord.session import stored

#: Classes for each doubling of the weight.
STEPS = 32


def _key(source: Column) -> Column:
    """A source's key; a null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def source_classes(volumes: DataFrame, weights: dict[str, float] | None, alpha: float) -> DataFrame:
    """``skey, w, class, turn``: every source of ``skey, volume`` that has a weight, and its turn in its class.

    Weights are those given, or the volume to the power ``alpha``. A source that a given table leaves out has none.
    """
    if weights is None:
        w = F.pow(F.greatest(F.col("volume"), F.lit(1)).cast("double"), F.lit(float(alpha)))
    else:
        given = F.create_map(*[x for k, v in weights.items() for x in (F.lit(f"s{k}"), F.lit(float(v)))]) if weights else F.lit(None)
        w = F.coalesce(F.try_element_at(given, F.col("skey")), F.lit(0.0)) if weights else F.lit(0.0)
    own = volumes.withColumn("w", F.round(w, 6)).where("w > 0").withColumn("class", F.floor(F.log2("w") * STEPS))
    # turns follow a hash of the key, in parts, so that a class of very many sources is numbered by many tasks
    own = own.withColumn("o", F.md5(F.col("skey").cast("binary"))).withColumn("part", F.substring("o", 1, 2))
    before = own.groupBy("class", "part").agg(F.count("*").alias("n"))
    before = before.withColumn("base", F.sum("n").over(W.partitionBy("class").orderBy("part")) - F.col("n")).drop("n")
    k = F.row_number().over(W.partitionBy("class", "part").orderBy("o", "skey")) - 1
    return own.withColumn("k", k).join(before, ["class", "part"]).select("skey", "w", "class", (F.col("base") + F.col("k")).alias("turn"))


def class_shares(sources: DataFrame, slots: int) -> DataFrame:
    """``class, members, share, total``: whole shares of the slots of a period by largest remainder, at least one each.

    A period has ``slots`` slots, or 16 for each class if that is more.
    """
    every = W.partitionBy(F.lit(0))  # classes are few
    at = sources.groupBy("class").agg(F.count("*").alias("members"), F.sum(F.col("w").cast("decimal(38,6)")).cast("double").alias("w"))
    at = at.withColumn("n", F.count("*").over(every)).withColumn("total", F.greatest(F.lit(slots), 16 * F.col("n")))
    # one slot each first, the others by weight
    at = at.withColumn("exact", F.col("w") / F.sum(F.col("w").cast("decimal(38,6)")).over(every).cast("double") * (F.col("total") - F.col("n")))
    at = at.withColumn("whole", F.floor("exact")).withColumn("spare", F.col("total") - F.col("n") - F.sum("whole").over(every))
    by_rest = F.row_number().over(every.orderBy(F.desc(F.round(F.col("exact") - F.col("whole"), 9)), "class"))
    share = 1 + F.col("whole") + F.when(by_rest <= F.col("spare"), 1).otherwise(0)
    return at.select("class", "members", share.cast("long").alias("share"), F.col("total").cast("long").alias("total"))


def schedule(shares: DataFrame, key: str = "class") -> DataFrame:
    """``key, share, total, turn, slot``: the slot of block number ``turn`` of a key within one period.

    One fold over the slots of the period, in chunks of about its square root. The state has a count for each key and the keys
    picked in the chunk.
    """
    one = shares.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), "share"))).alias("s"), F.max("total").alias("total"))
    picked = one.withColumn("chunk", F.ceil(F.sqrt("total"))).where("total > 0").selectExpr("s", "total", """
        aggregate(
          sequence(0L, (total - 1) div chunk),
          struct(transform(s, x -> 0L) AS done, cast(array() AS array<array<int>>) AS picks),
          (all, c) -> transform(array(aggregate(
            sequence(c * chunk, least(total, (c + 1) * chunk) - 1),
            struct(all.done AS done, cast(array() AS array<int>) AS picks),
            (acc, slot) -> transform(
              array(array_min(filter(
                transform(s, (x, i) -> struct(
                  ((acc.done[i] + 1) * total + x.share - 1) div x.share AS deadline,
                  -x.share AS heavier, i AS i, (acc.done[i] * total) div x.share AS released)),
                x -> x.released <= slot)).i),
              pick -> struct(
                transform(acc.done, (d, i) -> if(i = pick, d + 1, d)) AS done,
                concat(acc.picks, array(pick)) AS picks)
            )[0])),
            r -> struct(r.done AS done, concat(all.picks, array(r.picks)) AS picks))[0],
          all -> flatten(all.picks)
        ) AS picks
    """)  # fmt: skip
    by_slot = picked.selectExpr("s", "total", "posexplode(picks) AS (slot, i)").selectExpr(f"s[i].k AS {key}", "s[i].share AS share", "total", "slot")
    return by_slot.withColumn("turn", F.row_number().over(W.partitionBy(key).orderBy("slot")) - 1)


def mixed(docs: DataFrame, block: int = 20_000, slots: int = 1000, weights: dict[str, float] | None = None, alpha: float = 0.7) -> DataFrame:
    """Every document with its place in the mixture: ``doc_id, source, block, slot, in_mix``.

    ``block`` is a block's volume in characters. A document belongs to the block in which it starts within its
    source (order: a hash of ``doc_id`` and text). ``slot`` orders the mixture; a source that has run out is passed over.
    ``in_mix`` marks the slots up to the corpus' own number of blocks: what a source has beyond its target weight comes
    after them. With given weights, sources without weight have null slots and are not in the mixture. No row is dropped.
    Null texts have no volume, a null source is one source, null and repeated ``doc_id`` and repeated rows all get a place; a text
    of any length belongs to one block. Other columns are not read; an empty table gives no rows.
    """
    return _placed(docs, ["doc_id", "source"], block, slots, weights, alpha).select("row.*", "block", "slot", "in_mix")


def mixture(docs: DataFrame, block: int = 20_000, slots: int = 1000, weights: dict[str, float] | None = None, alpha: float = 0.7) -> DataFrame:
    """The documents that are in the mixture, with all columns of ``docs``."""
    return _placed(docs, docs.columns, block, slots, weights, alpha).where("in_mix").select("row.*")


def interleaved(docs: DataFrame, block: int = 20_000, slots: int = 1000, weights: dict[str, float] | None = None, alpha: float = 0.7) -> DataFrame:
    """Every document in the order of the schedule, with all columns of ``docs``: partitions are ranges of slots, rows are sorted inside.

    Written, the files by name have that order. No row is dropped: what a source has beyond the mixture comes in its
    later slots, and sources without weight come last.
    """
    at = [F.asc_nulls_last("slot"), F.asc("o"), F.asc("row.doc_id")]
    return _placed(docs, docs.columns, block, slots, weights, alpha).repartitionByRange(*at).sortWithinPartitions(*at).select("row.*")


def _placed(docs: DataFrame, names: list[str], block: int, slots: int, weights: dict[str, float] | None, alpha: float) -> DataFrame:
    """``row`` (a struct of the named columns), ``o`` (a hash of id and text), ``block, slot, in_mix``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text).cast("binary"))
    own = docs.select(F.struct(*names).alias("row"), _key(F.col("source")).alias("skey"), F.char_length(text).cast("long").alias("volume"), order.alias("o"))
    keyed = own.withColumn("salt", F.substring("o", 1, 2))
    sums = stored(keyed.groupBy("skey", "salt").agg(F.sum("volume").alias("v"), F.count("*").alias("n")), "mix")
    volumes = sums.groupBy("skey").agg(F.sum("v").alias("volume"))
    sources = stored(source_classes(volumes, weights, alpha), "sources")
    shares = class_shares(sources, slots)
    tables = schedule(shares).groupBy("class").agg(F.first("share").alias("share"), F.first("total").alias("total"), F.transform(F.sort_array(F.collect_list(F.struct("turn", "slot"))), lambda x: x.slot).alias("at"))
    tables = stored(tables.join(shares.select("class", "members"), "class"), "schedule")  # a row for each class, one number for each slot
    # the mixture is as long as the corpus: so many slots as all blocks of the weighted sources take
    end = volumes.join(sources.select("skey"), "skey").agg(F.coalesce(F.sum(F.expr(f"volume div {block} + 1")), F.lit(0))).first()[0]
    before = sums.withColumn("base", F.sum("v").over(W.partitionBy("skey").orderBy("salt")) - F.col("v")).select("skey", "salt", "base")
    before = before.join(sources.select("skey", "class", F.col("turn").alias("first")), "skey", "left")
    inside = W.partitionBy("skey", "salt").orderBy("o", F.col("row.doc_id")).rowsBetween(W.unboundedPreceding, 0)
    placed = keyed.withColumn("start", F.sum("volume").over(inside) - F.col("volume"))
    placed = placed.join(before, ["skey", "salt"]).withColumn("block", F.expr(f"(start + base) div {block}"))
    placed = placed.join(F.broadcast(tables), "class", "left").withColumn("n", F.expr("block * members + first"))
    place = F.expr("(n div share) * total + element_at(at, cast(n % share AS int) + 1)")
    return placed.select("row", "o", "block", place.alias("slot"), F.coalesce(place < F.lit(end), F.lit(False)).alias("in_mix"))
