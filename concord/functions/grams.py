"""Pairs of letters as a filter before edit distances.

A title of ``n`` letters, with a sign before and after it, has ``n + 1`` pairs of neighbours. One edit changes at most two of them, so titles with a
similarity of at least ``s`` (edits are at most ``1 - s`` of the longer length) share at least ``(2 s - 1) n + 1`` of a title's pairs. Whatever
order its pairs are put in, one of the first ``n + 1`` less that many, plus one, is then among the other's. The rarest come first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: From this similarity on the filter is worth its joins.
USEFUL = 0.65


def letter_pairs(title: str) -> str:
    """SQL of the pairs of a title."""
    return f"transform(sequence(1, length({title}) + 1), i -> substr(concat('^', {title}, '$'), i, 2))"


def met(asked: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of ``asked`` (``s_title_key, t_artist_key, least`` and more) with each ``t_title_key`` of the artist that can have the ``least`` similarity.

    ``names`` has ``t_artist_key, t_title_key``; ``least`` is over a half. Some that are found do not have it.
    """
    own = names.join(asked.select("t_artist_key").distinct(), "t_artist_key", "left_semi")
    index = own.select("t_artist_key", "t_title_key", F.explode(F.array_distinct(F.expr(letter_pairs("t_title_key")))).alias("pair"))
    often = index.groupBy("pair").agg(F.count("*").alias("times"))
    # pairs of each title, rarest first; one that no target has is rarest
    titles = asked.select("s_title_key").distinct().select("s_title_key", F.explode(F.expr(letter_pairs("s_title_key"))).alias("pair"))
    ranked = titles.join(often, "pair", "left").groupBy("s_title_key").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "pair"))).alias("pairs"))
    some = F.expr("greatest(1, length(s_title_key) + 1 - CAST(ceil((2 * least - 1) * length(s_title_key) + 1 - 1e-6D) AS INT) + 1)")
    first = asked.join(ranked, "s_title_key").withColumn("pair", F.explode(F.array_distinct(F.transform(F.slice("pairs", 1, some), lambda x: x["pair"])))).drop("pairs")
    return first.join(index, ["t_artist_key", "pair"]).drop("pair").distinct()
