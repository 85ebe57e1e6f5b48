"""Matching of records between two services: overrides, codes, rare-word blocking, scores, decisions.

A record has ``ord`` (stable input order), ``id, title, artist, album, code, seconds, a_id, b_id, availability``; bit 1 of the
availability means service a, bit 2 service b.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from concord.functions import grams
from concord.functions.similarity import Policy, parts_sql, score_sql, similarity_sql
from concord.functions.text import album_key, artist_key, title_key
from concord.session import stored

FLAGS = {"a": 1, "b": 2}


def on_service(service: str):
    return F.col("availability").bitwiseAND(FLAGS[service]) != 0


def keyed(records: DataFrame) -> DataFrame:
    """Records with their normalised keys, computed once."""
    return records.withColumns({"title_key": title_key(F.col("title")), "artist_key": artist_key(F.col("artist")), "album_key": album_key(F.col("album")), "code_key": F.when(F.length("code") > 0, F.upper("code"))})


def words(records: DataFrame, key: str = "artist_key") -> DataFrame:
    """``ord, word``: the distinct words of each record's key."""
    return records.select("ord", F.explode(F.array_distinct(F.split(key, " "))).alias("word")).where("word <> ''")


def postings(target: DataFrame) -> DataFrame:
    """``word, df``: how many target records have the word."""
    return words(target).groupBy("word").agg(F.count("*").alias("df"))


def rare_words(source: DataFrame, frequencies: DataFrame, common: int = 500) -> DataFrame:
    """``ord, word, df, rn``: each source's rarest word, and all others that at most ``common`` targets have; ties by word."""
    rank = F.row_number().over(W.partitionBy("ord").orderBy("df", "word"))
    return words(source).join(frequencies, "word").withColumn("rn", rank).where((F.col("rn") == 1) | (F.col("df") <= common))


def _side(df: DataFrame, prefix: str, *more: str) -> DataFrame:
    cols = ("ord", "id", "title_key", "artist_key", "album_key", "seconds", "code_key", *more)
    return df.select(*(F.col(c).alias(f"{prefix}_{c}") for c in cols))


def code_pairs(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source and target sides of equal codes; of several targets the first in order counts."""
    first = F.row_number().over(W.partitionBy("t_code_key").orderBy("t_ord"))
    best = _side(target.where(F.col("code_key").isNotNull()), "t").withColumn("n", first).where("n = 1").drop("n")
    return _side(source, "s").join(best, F.col("s_code_key") == F.col("t_code_key"))


def artist_pairs(source: DataFrame, target: DataFrame, p: Policy = Policy()) -> DataFrame:
    """``s_artist_key, t_artist_key, artist_sim, better``: artists that share a rare word, compared once each.

    ``better`` is how many target records the artists have that are listed before this one, most similar first.
    """
    sizes = target.groupBy(F.col("artist_key").alias("t_artist_key")).agg(F.count("*").alias("n"))
    found = sizes.select("*", F.explode(F.array_distinct(F.split("t_artist_key", " "))).alias("word")).where("word <> ''")
    df = found.groupBy("word").agg(F.sum("n").alias("df"))
    asked = source.select(F.col("artist_key").alias("s_artist_key")).distinct()
    asked = asked.select("*", F.explode(F.array_distinct(F.split("s_artist_key", " "))).alias("word")).where("word <> ''")
    rarest = F.row_number().over(W.partitionBy("s_artist_key").orderBy("df", "word"))
    chosen = asked.join(df, "word").withColumn("rn", rarest).where((F.col("rn") == 1) | (F.col("df") <= p.common_word)).drop("rn", "df")
    both = chosen.join(found, "word").groupBy("s_artist_key", "t_artist_key").agg(F.first("n").alias("n"))
    both = both.selectExpr("*", f"{similarity_sql('s_artist_key', 't_artist_key')} AS artist_sim")
    upto = F.sum("n").over(W.partitionBy("s_artist_key").orderBy(F.desc("artist_sim"), "t_artist_key").rowsBetween(W.unboundedPreceding, W.currentRow))
    return both.withColumn("better", upto - F.col("n")).drop("n")


def key_pairs(source: DataFrame, target: DataFrame, p: Policy = Policy()) -> DataFrame:
    """``s_title_key, s_artist_key, t_title_key, t_artist_key, title_sim, artist_sim, pre``: names that share a rare word.

    A name (title and artist key) is compared once, however many records have it. Of each source name's ranked target names only
    those are kept that its best ``candidates`` target records can come from.

    That takes two steps, so that a word which very many names share does not mean that all of them are compared. A name is first compared with
    those of its most similar artists that have four times ``candidates`` records between them, which gives a bar: the score of its last candidate
    among them. Another artist's names have to reach it. Their titles need a similarity for that which depends on the artist; where it is high,
    only titles are looked at that share one of the name's rarest pairs of letters (module ``grams``), else those of a length that can reach it.
    """
    keys = ["s_title_key", "s_artist_key"]
    names = target.groupBy(F.col("title_key").alias("t_title_key"), F.col("artist_key").alias("t_artist_key")).agg(F.count("*").alias("n"))
    asked = source.select(F.col("title_key").alias("s_title_key"), F.col("artist_key").alias("s_artist_key")).distinct()
    # few bytes of names become many pairs, so names are dealt to all cores, not by their size
    spark = source.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    asked = asked.repartition(tasks, F.xxhash64(*keys))
    artists = stored(artist_pairs(source, target, p), "artists")
    wide = 4 * p.candidates
    near, far = artists.where(F.col("better") < wide).drop("better"), artists.where(F.col("better") >= wide).drop("better")
    compared = f"{similarity_sql('s_title_key', 't_title_key')} AS title_sim"
    pre = "title_sim * 0.6D + artist_sim * 0.4D AS pre"
    first = asked.join(near, "s_artist_key").join(names, "t_artist_key").selectExpr(*keys, "t_title_key", "t_artist_key", "n", "artist_sim", compared)
    upto = F.sum("n").over(W.partitionBy(*keys).orderBy(F.desc("pre")).rangeBetween(W.unboundedPreceding, W.currentRow))
    equal = F.sum("n").over(W.partitionBy(*keys, "pre"))
    best = lambda rows: rows.withColumn("better", upto - equal).where(F.col("better") < p.candidates).drop("better", "n")
    if far.isEmpty():
        return best(first.selectExpr("*", pre))
    names, first = stored(names, "names"), stored(first, "near_names").selectExpr("*", pre)
    bars = first.withColumn("upto", upto).where(F.col("upto") >= p.candidates).groupBy(*keys).agg(F.max("pre").alias("bar"))
    some = asked.join(bars, keys).join(far, "s_artist_key").withColumn("least", (F.col("bar") - 1e-9 - F.col("artist_sim") * 0.4) / 0.6).where("least <= 1")
    some = stored(some, "far_artists").repartition(tasks, F.xxhash64(*keys))
    ratio = "least(length(s_title_key), length(t_title_key)) / greatest(length(s_title_key), length(t_title_key), 1)"
    reach = F.expr(f"coalesce({ratio}, 0) >= least - 1e-9D OR s_title_key = t_title_key")
    open_ = some.where(F.col("least") < grams.USEFUL).alias("x").join(names.alias("y"), (F.col("x.t_artist_key") == F.col("y.t_artist_key")) & reach)
    rest = [*keys, "y.t_title_key", "y.t_artist_key", "y.n", "artist_sim", "bar"]
    few = grams.met(some.where(F.col("least") >= grams.USEFUL), names).alias("x").join(names.alias("y"), ["t_artist_key", "t_title_key"]).where(reach)
    second = open_.select(*rest).unionByName(few.select(*keys, "t_title_key", "t_artist_key", "n", "artist_sim", "bar"))
    second = stored(second.selectExpr(*keys, "t_title_key", "t_artist_key", "n", "artist_sim", compared, "bar"), "far_names").selectExpr("*", pre).where("pre >= bar - 1e-9D").drop("bar")
    return best(first.unionByName(second))


def _ranked(source: DataFrame, target: DataFrame, p: Policy) -> DataFrame:
    """``s_title_key, s_artist_key, best``: each source name's ranked candidates, at most ``candidates``."""
    t = _side(target, "t")
    first = F.row_number().over(W.partitionBy("t_title_key", "t_artist_key").orderBy("t_ord"))
    t = t.withColumn("n", first).where(F.col("n") <= p.candidates).drop("n")  # no source takes more of one name
    rank = F.row_number().over(W.partitionBy("s_title_key", "s_artist_key").orderBy(F.desc("pre"), "t_ord"))
    best = key_pairs(source, target, p).join(t, ["t_title_key", "t_artist_key"]).withColumn("pre_rank", rank).where(F.col("pre_rank") <= p.candidates)
    return best.groupBy("s_title_key", "s_artist_key").agg(F.collect_list(F.struct("pre_rank", "pre", "title_sim", "artist_sim", *t.columns)).alias("best"))


def word_pairs(source: DataFrame, target: DataFrame, p: Policy = Policy()) -> DataFrame:
    """Ranked candidate pairs: those that share a rare word, the best ``candidates`` by pre-score, then order."""
    return _side(source, "s").join(_ranked(source, target, p), ["s_title_key", "s_artist_key"]).select("*", F.inline("best")).drop("best")


def with_candidates(source: DataFrame, target: DataFrame, p: Policy = Policy(), *more: str) -> DataFrame:
    """Source sides with ``best``, the array of their candidates: a code hit alone where there is one, else ranked by words.

    A source is one row throughout, and a name of very many sources is joined by many tasks. Columns ``more`` stay with each source.
    """
    side = F.struct(*_side(target, "t").columns)
    first = _side(target, "t").where("t_code_key IS NOT NULL").groupBy(F.col("t_code_key").alias("code")).agg(F.min_by(side, "t_ord").alias("hit"))
    own = _side(source, "s", *more).join(first, F.col("s_code_key") == F.col("code"), "left").drop("code")
    open_ = own.where("hit IS NULL").select(F.col("s_title_key").alias("title_key"), F.col("s_artist_key").alias("artist_key"))
    hit = ", ".join(f"'{c}', hit.{c}" for c in _side(target, "t").columns)
    alone = f"array(named_struct('pre_rank', 1, 'pre', CAST(NULL AS DOUBLE), 'title_sim', 1D, 'artist_sim', 1D, {hit}))"
    both = own.join(_ranked(open_, target, p), ["s_title_key", "s_artist_key"], "left")
    return both.withColumn("best", F.expr(f"if(hit IS NOT NULL, {alone}, best)")).drop("hit")


def scored(pairs: DataFrame, p: Policy = Policy()) -> DataFrame:
    """Component scores and the score of every candidate pair."""
    parts = parts_sql("title_sim", "artist_sim", "s_", "t_", p)
    rows = pairs.selectExpr("*", *(f"{x} AS {name}" for name, x in parts.items()))
    return rows.selectExpr("*", f"{score_sql('', p)} AS score", "if(by_code, 'isrc', 'fuzzy') AS method").drop("by_code")


def decided(sources: DataFrame, p: Policy = Policy(), *more: str) -> DataFrame:
    """``ord, source_id, decision, method, candidate_id, score, candidates`` of every source side with its candidates ``best``, and its columns ``more``.

    The best of equal scores is the one with the better pre-rank. Ambiguous sources keep up to ``shown`` candidates of the band.
    """
    parts = ", ".join(f"'{name}', {x}" for name, x in parts_sql("x.title_sim", "x.artist_sim", "s_", "x.t_", p).items())
    rows = sources.selectExpr(*more, "s_ord AS ord", "s_id AS source_id", f"transform(best, x -> named_struct('rank', x.pre_rank, 'id', x.t_id, {parts})) AS c")
    scores = f"transform(c, x -> named_struct('less', -({score_sql('x.', p)}), 'rank', x.rank, 'id', x.id, 'method', if(x.by_code, 'isrc', 'fuzzy')))"
    rows = rows.selectExpr(*more, "ord", "source_id", f"sort_array(filter({scores}, x -> x.less IS NOT NULL)) AS c")
    rows = rows.selectExpr(*more, "ord", "source_id", "get(c, 0) AS top", "get(c, 1).less - get(c, 0).less AS lead", f"slice(filter(c, x -> -x.less >= {p.ambiguous}D AND -x.less < {p.auto}D), 1, {p.shown}) AS close")
    clear = f"coalesce(lead >= {p.margin}D, true)" if p.margin > 0 else "true"
    rows = rows.selectExpr("*", f"CASE WHEN -top.less >= {p.auto}D AND {clear} THEN 'auto' WHEN size(close) > 0 THEN 'ambiguous' ELSE 'no_match' END AS decision")
    kept = "CASE decision WHEN 'auto' THEN array(top) WHEN 'ambiguous' THEN close END"
    rows = rows.selectExpr("*", f"transform({kept}, x -> named_struct('candidate_id', x.id, 'score', -x.less)) AS candidates")
    return rows.selectExpr(*more, "ord", "source_id", "decision", "if(decision = 'no_match', NULL, top.method) AS method", "get(candidates, 0).candidate_id AS candidate_id", "get(candidates, 0).score AS score", "candidates")


def _decided_once(own: DataFrame, goal: DataFrame, rejects: DataFrame | None, p: Policy) -> DataFrame:
    """Decisions of sources. Sources that are alike in all that a decision depends on are decided once, and the decisions are stored.

    So scores are computed once, whatever is asked of the decisions afterwards: a condition on them is otherwise evaluated inside the scan of the candidates,
    with all scores again for each of its parts.
    """
    alike = ["title_key", "artist_key", "album_key", "seconds", "code_key"]
    if rejects is not None:
        own, alike = own.join(rejects, "id", "left"), [*alike, "rejected"]
    kinds = own.groupBy(*alike).agg(F.min("ord").alias("ord"), F.min_by("id", "ord").alias("id"))
    kinds = stored(kinds, "kinds")
    rows = with_candidates(kinds, goal, p, *alike[5:])
    if rejects is not None:
        rows = rows.withColumn("best", F.expr("if(s_rejected IS NULL, best, filter(best, x -> NOT array_contains(s_rejected, x.t_id)))"))
    kept = [f"s_{c}" for c in alike]
    out = stored(decided(rows, p, *kept).drop("ord", "source_id"), "decided")
    same = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in alike]
    return own.join(out, same).select("ord", F.col("id").alias("source_id"), *(c for c in out.columns if c not in kept))


def matched(records: DataFrame, source: str, target: str, mappings: DataFrame | None = None, exclusions: DataFrame | None = None, p: Policy = Policy(), pending_only: bool = False) -> DataFrame:
    """Decisions for all records on the source service, or for those not on the target yet.

    A manual mapping (``source_service, source_track_id, target_service, target_track_id, confidence``) decides first. Then a ``skip`` exclusion
    (``track_id, target_service, kind, candidate_id``), then candidates without those of ``reject`` exclusions: a rejected code hit
    leaves no match. Repeated source ids are decided once.
    """
    asks = on_service(source) & ~on_service(target) if pending_only else on_service(source)
    first = asks & (F.row_number().over(W.partitionBy("id", asks).orderBy("ord")) == 1)
    every = stored(keyed(records.withColumn("asks", first)), "keyed")  # keys are computed once, by the tasks of the shuffle, and read several times
    own, goal = every.where("asks").drop("asks"), every.where(on_service(target)).drop("asks")
    blank = "cast(null as array<struct<candidate_id:string,score:double>>)"
    done = []
    if mappings is not None:
        m = mappings.where((F.col("source_service") == source) & (F.col("target_service") == target))
        m = m.select(F.col("source_track_id").alias("key"), "target_track_id", "confidence")
        hit = own.withColumn("key", F.coalesce(f"{source}_id", "id")).join(m, "key")
        score = F.coalesce("confidence", F.lit(1.0))
        done.append(hit.select("ord", F.col("id").alias("source_id"), F.lit("auto").alias("decision"), F.lit("manual").alias("method"), F.col("target_track_id").alias("candidate_id"), score.alias("score"), F.array(F.struct(F.col("target_track_id").alias("candidate_id"), score.alias("score"))).alias("candidates")))
        own = own.join(hit.select("ord"), "ord", "left_anti")
    rejects = None
    if exclusions is not None:
        e = exclusions.where(F.col("target_service") == target)
        skips = e.where("kind = 'skip'").select(F.col("track_id").alias("id")).distinct()
        done.append(own.join(skips, "id", "left_semi").select("ord", F.col("id").alias("source_id"), F.lit("skipped").alias("decision"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("candidate_id"), F.lit(None).cast("double").alias("score"), F.expr(blank).alias("candidates")))
        own = own.join(skips, "id", "left_anti")
        rejects = e.where("kind = 'reject'").groupBy(F.col("track_id").alias("id")).agg(F.sort_array(F.collect_set("candidate_id")).alias("rejected"))
    out = _decided_once(own, goal, rejects, p)
    for d in done:
        out = out.unionByName(d)
    return out


def statistics(decisions: DataFrame) -> DataFrame:
    """Counts of the decisions and the share of automatic ones, 0 for none."""
    n = lambda d: F.count_if(F.col("decision") == d).alias(d)
    out = decisions.agg(F.count("*").alias("total"), *(n(d) for d in ("auto", "ambiguous", "no_match", "skipped")))
    return out.withColumn("auto_rate", F.when(F.col("total") > 0, F.col("auto") / F.col("total")).otherwise(0.0))


def outcomes(decisions: DataFrame, run_id: str | None, source: str, target: str, at=None) -> DataFrame:
    """Fact rows of decisions: score and candidate count are those of the decision."""
    return decisions.select(
        F.lit(run_id).cast("string").alias("run_id"), (F.current_timestamp() if at is None else at).alias("recorded_at"),
        F.lit(source).alias("source_service"), F.lit(target).alias("target_service"), F.col("source_id").alias("source_track_id"),
        "decision", "method", F.array_max(F.transform("candidates", lambda x: x.score)).alias("top_score"),
        F.coalesce(F.when(F.size("candidates") >= 0, F.size("candidates")), F.lit(0)).cast("long").alias("candidate_count"),
    )


def pending_resolutions(records: DataFrame, directions: list[tuple[str, str]], **options) -> DataFrame:
    """Ambiguous records that are not on the target, with details of their candidates, by artist and title for each direction."""
    out = None
    for n, (source, target) in enumerate(directions):
        found = matched(records, source, target, pending_only=True, **options).where("decision = 'ambiguous'")
        rows = found.select("source_id", F.posexplode("candidates").alias("place", "c")).select("source_id", "place", "c.candidate_id", "c.score")
        details = records.select(F.col("id").alias("candidate_id"), F.col("title").alias("candidate_title"), F.col("artist").alias("candidate_artist"))
        own = records.select(F.col("id").alias("source_id"), "title", "artist")
        rows = rows.join(details, "candidate_id", "left").join(own, "source_id").withColumns({"direction": F.lit(f"{source}>{target}"), "step": F.lit(n)})
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("step", "artist", "title", "source_id", "place").drop("step")


def resolved(records: DataFrame, catalogue: DataFrame, source: str, target: str, hits: int = 5, p: Policy = Policy()) -> DataFrame:
    """A second pass for records without a match: catalogue rows found by their search text are tried as candidates."""
    first = matched(records, source, target, p=p)
    open_ = records.join(first.where("decision = 'no_match'").select(F.col("source_id").alias("id")), "id", "left_semi")
    from concord.functions.text import base_key, search_text

    ask = open_.select("id", base_key(search_text(F.col("title"), F.col("artist"))).alias("q"))
    found = catalogue.withColumn("q", base_key(search_text(F.col("title"), F.col("artist"))))
    rank = F.row_number().over(W.partitionBy("q").orderBy("ord"))
    more = found.withColumn("n", rank).where(F.col("n") <= hits).join(ask.select("q").distinct(), "q", "left_semi").drop("q", "n")
    again = matched(open_.unionByName(more, allowMissingColumns=True), source, target, p=p)
    again = again.join(open_.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return first.where("decision <> 'no_match'").unionByName(again)


def parsed_choices(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Answers of a resolver with ``action`` and ``choice``: ``3`` chooses, ``x3`` rejects, ``s`` or nothing skips, ``q`` ends, others are invalid.

    Numbers count from 1.
    """
    own = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    number = F.regexp_extract(own, r"^x?([1-9][0-9]{0,8})$", 1)
    action = F.when(own.isin("", "s"), "skip").when(own == "q", "quit").when(number == "", "invalid").when(own.startswith("x"), "reject").otherwise("choose")
    return answers.withColumn("action", action).withColumn("choice", F.when(number != "", number.cast("int")))
