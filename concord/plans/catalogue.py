"""Registered reconciliation queries and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.functions import ids, similarity as sim, text
from concord.operators import matching, merging, metrics, stores, syncing
from concord.plans import adapters as A, oracles as O
from concord.session import table

P = sim.Policy()
RARE = sim.Policy(common_word=100)
STRICT = sim.Policy(common_word=100, ambiguous=0.8)
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def _sides(spark, sf_dir, codes=False):
    every = matching.keyed(A.parts(spark, sf_dir, codes))
    return every.where(matching.on_service("a")), every.where(matching.on_service("b"))


# ---- normalisation and identifiers


@query("norm_title", f"SELECT doc_id, {O.title('text')} AS k FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.title_key(F.col("text")).alias("k"))


@query("norm_artist", f"SELECT doc_id, {O.artist('text')} AS k FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.artist_key(F.col("text")).alias("k"))


@query("norm_album", f"SELECT doc_id, {O.album('text')} AS k FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.album_key(F.col("text")).alias("k"))


@query("canonical_track_id", """
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'isrc:' || upper('us' || p_partkey)
        ELSE substr(sha256(lower(p_name) || '|' || lower(p_brand) || '|' || CASE WHEN p_size % 5 = 0 THEN '' ELSE lower(p_type) END || '|' || CASE WHEN p_size % 7 = 0 THEN 0 ELSE (p_size * 1000 + 1500) // 1000 END), 1, 32) END AS id
    FROM part""")
def _(spark, d):
    size = F.col("p_size").cast("long")
    seconds = F.when(size % 7 != 0, ids.whole_seconds(size * 1000 + 1000))
    code = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" us"), F.col("p_partkey").cast("string"), F.lit("\t")))
    album = F.when(size % 5 != 0, F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", ids.record_id(F.concat(F.lit(" "), "p_brand"), F.col("p_name"), album, seconds, code).alias("id"))


@query("canonical_playlist_id", "SELECT DISTINCT conv_id, role, substr(sha256(lower(role) || '|' || 'conv ' || conv_id), 1, 32) AS id FROM conversations")
def _(spark, d):
    name = F.concat(F.lit("Conv "), F.col("conv_id").cast("string"))
    return table(spark, d, "conversations").select("conv_id", "role").distinct().select("conv_id", "role", ids.list_id(F.col("role"), name).alias("id"))


@query("members_digest", f"""
    WITH l AS (SELECT conv_id, list(md5(coalesce(text, '')) ORDER BY turn, md5(coalesce(text, ''))) AS ids FROM conversations GROUP BY conv_id)
    SELECT 'c' || conv_id AS id, {O.digest('ids')} AS digest FROM l""")
def _(spark, d):
    source, _ = A.conversation_lists(spark, d)
    return source.select("id", ids.members_digest(F.col("track_ids")).alias("digest"))


@query("op_keys", """
    SELECT DISTINCT 'update_members:l:' || l_partkey || ':d' AS key, 'update_members' AS kind, 'l:' || l_partkey AS entity, 'd' AS digest FROM lineitem""")
def _(spark, d):
    key = ids.op_key(F.lit("update_members"), F.concat(F.lit("l:"), F.col("l_partkey").cast("string")), F.lit("d"))
    return table(spark, d, "lineitem").select("l_partkey").distinct().select(key.alias("key"), ids.parse_op_key(key).alias("p")).select("key", "p.*")


# ---- similarities and predicates


@query("similarity_pairs", f"""
    WITH n AS (SELECT DISTINCT p_brand, lower(p_name) AS n FROM part)
    SELECT a.p_brand, a.n AS a, b.n AS b, {O.sim('a.n', 'b.n')} AS s FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.n < b.n""")
def _(spark, d):
    n = table(spark, d, "part").select("p_brand", F.lower("p_name").alias("n")).distinct()
    pairs = n.withColumnRenamed("n", "a").join(n.withColumnRenamed("n", "b"), "p_brand").where("a < b")
    return pairs.select("p_brand", "a", "b", sim.similarity(F.col("a"), F.col("b")).alias("s"))


@query("multi_field_similarity", f"""
    WITH n AS (SELECT DISTINCT p_brand, p_type, lower(p_name) AS n FROM part)
    SELECT a.p_brand, a.p_type AS ta, b.p_type AS tb, a.n AS a, b.n AS b, {O.sim('a.n', 'b.n')} * {O.dbl('0.4')} + {O.sim('lower(a.p_type)', 'lower(b.p_type)')} * {O.dbl('0.35')} AS s
    FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.n = b.n AND a.p_type < b.p_type""")
def _(spark, d):
    n = table(spark, d, "part").select("p_brand", "p_type", F.lower("p_name").alias("n")).distinct()
    pairs = n.select("p_brand", F.col("p_type").alias("ta"), F.col("n").alias("a"), "n").join(n.select("p_brand", F.col("p_type").alias("tb"), F.col("n").alias("b"), "n"), ["p_brand", "n"]).where("ta < tb")
    s = sim.multi_field_similarity([(F.col("a"), F.col("b"), 0.4), (F.col("ta"), F.col("tb"), 0.35)])
    return pairs.select("p_brand", "ta", "tb", "a", "b", s.alias("s"))


@query("duration_score", f"""
    WITH n AS (SELECT DISTINCT p_brand, CAST(CASE WHEN p_size % 9 > 0 THEN p_size END AS BIGINT) AS n FROM part)
    SELECT a.p_brand, coalesce(a.n, -1) AS a, coalesce(b.n, -1) AS b, {O.duration('a.n', 'b.n')} AS s, a.n IS NULL OR b.n IS NULL OR abs(a.n - b.n) <= 5 AS near, a.n IS NULL OR b.n IS NULL OR abs(a.n - b.n) <= 2 AS nearer, coalesce(abs(a.n - b.n), -1) AS diff
    FROM n a JOIN n b ON a.p_brand = b.p_brand""")
def _(spark, d):
    n = table(spark, d, "part").select("p_brand", F.when(F.col("p_size") % 9 > 0, F.col("p_size").cast("long")).alias("n")).distinct()
    a, b = F.col("a"), F.col("b")
    pairs = n.withColumnRenamed("n", "a").join(n.withColumnRenamed("n", "b"), "p_brand")
    or_none = lambda x: F.coalesce(x, F.lit(-1))
    return pairs.select("p_brand", or_none(a).alias("a"), or_none(b).alias("b"), sim.duration_score(a, b).alias("s"), sim.within_tolerance(a, b).alias("near"), sim.within_tolerance(a, b, strict=True).alias("nearer"), or_none(F.abs(a - b)).alias("diff"))


@query("code_predicates", """
    WITH c AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'US-ABC-' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 7, '0') WHEN 1 THEN 'usabc' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 7, '0') WHEN 2 THEN 'USABC' || p_partkey ELSE '' END AS code FROM part)
    SELECT p_partkey, code, regexp_matches(replace(code, '-', ''), '^[A-Z0-9]{12}$') AS valid, code <> '' AS same FROM c""")
def _(spark, d):
    k, r = F.col("p_partkey"), F.col("p_partkey") % 4
    n = F.lpad((k % 100000).cast("string"), 7, "0")
    code = F.when(r == 0, F.concat(F.lit("US-ABC-"), n)).when(r == 1, F.concat(F.lit("usabc"), n)).when(r == 2, F.concat(F.lit("USABC"), k.cast("string"))).otherwise("")
    return table(spark, d, "part").select("p_partkey", code.alias("code")).select("*", sim.valid_code(F.col("code")).alias("valid"), sim.same_code(F.col("code"), F.lower("code")).alias("same"))


# ---- blocking, scoring, deciding


@query("isrc_match", f"WITH {O.PARTS}, {O.CODE_PAIRS} SELECT s AS source, t AS target FROM hits")
def _(spark, d):
    source, target = _sides(spark, d, codes=True)
    return matching.code_pairs(source, target).select(F.col("s_ord").alias("source"), F.col("t_ord").alias("target"))


@query("token_postings", f"WITH {O.PARTS}, {O.pairs()} SELECT word, df FROM df")
def _(spark, d):
    return matching.postings(_sides(spark, d)[1])


def _rare(common):
    def run(spark, d):
        source, target = _sides(spark, d)
        return matching.rare_words(source, matching.postings(target), common).select("ord", "word", "df", F.col("rn").cast("long").alias("rn"))

    return run


for _n in (500, 50):
    query(f"rare_words_{_n}", f"WITH {O.PARTS}, {O.pairs(_n)} SELECT ord, word, df, rn FROM rare")(_rare(_n))


@query("candidates_top50", f"WITH {O.PARTS}, {O.pairs()} SELECT s, t, pre, pr FROM ranked")
def _(spark, d):
    source, target = _sides(spark, d)
    return matching.word_pairs(source, target, P).select(F.col("s_ord").alias("s"), F.col("t_ord").alias("t"), "pre", F.col("pre_rank").cast("long").alias("pr"))


@query("score_pairs", f"WITH {O.PARTS}, {O.pairs()} SELECT s, t, ts, ars, als, ds, score FROM fuzzy")
def _(spark, d):
    source, target = _sides(spark, d)
    s = matching.scored(matching.word_pairs(source, target, P), P)
    return s.select(F.col("s_ord").alias("s"), F.col("t_ord").alias("t"), F.col("title_score").alias("ts"), F.col("artist_score").alias("ars"), F.col("album_score").alias("als"), F.col("duration_score").alias("ds"), "score")


def _decision_rows(found):
    return found.select("ord", "source_id", "decision", "method", "candidate_id", "score", F.coalesce(F.when(F.size("candidates") >= 0, F.size("candidates")), F.lit(0)).cast("long").alias("n_candidates"))


@query("match_decisions", f"WITH {O.PARTS}, {O.pairs()}, {O.decisions('fuzzy', 'src')} SELECT * FROM decided")
def _(spark, d):
    return _decision_rows(matching.matched(A.parts(spark, d), "a", "b", p=P))


@query("match_decisions_rare", f"WITH {O.PARTS}, {O.pairs(100)}, {O.decisions('fuzzy', 'src')} SELECT * FROM decided")
def _(spark, d):
    return _decision_rows(matching.matched(A.parts(spark, d), "a", "b", p=RARE))


_WITH_CODES = f"{O.PARTS}, {O.CODE_PAIRS}, {O.pairs(100, 'rest')}, both_ways AS (SELECT s, t, pr, score, method FROM hits UNION ALL SELECT s, t, pr, score, method FROM fuzzy), {O.decisions('both_ways', 'src')}"


_STRICT = _WITH_CODES.replace(O.decisions("both_ways", "src"), O.decisions("both_ways", "src", "0.8"))


@query("match_cascade", f"WITH {_WITH_CODES} SELECT * FROM decided")
def _(spark, d):
    return _decision_rows(matching.matched(A.parts(spark, d, codes=True), "a", "b", p=RARE))


@query("match_stats", f"""WITH {_WITH_CODES}, n AS (SELECT CAST(count(*) AS BIGINT) AS total, {', '.join(f"CAST(count(*) FILTER (WHERE decision = '{x}') AS BIGINT) AS {x}" for x in ('auto', 'ambiguous', 'no_match', 'skipped'))} FROM decided)
    SELECT *, CASE WHEN total > 0 THEN CAST(auto AS DOUBLE) / total ELSE 0 END AS auto_rate FROM n""")
def _(spark, d):
    return matching.statistics(matching.matched(A.parts(spark, d, codes=True), "a", "b", p=RARE))


_OVERRIDDEN = f"""{O.PARTS}, manual AS (SELECT ord, id AS source_id, 'auto' AS decision, 'manual' AS method, 'p' || (ord + 1) AS candidate_id, CASE WHEN ord % 3 = 0 THEN CAST(0.99 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS score, CAST(1 AS BIGINT) AS n_candidates FROM src WHERE ord % 7 = 0),
    skipped AS (SELECT ord, id AS source_id, 'skipped' AS decision, CAST(NULL AS VARCHAR) AS method, CAST(NULL AS VARCHAR) AS candidate_id, CAST(NULL AS DOUBLE) AS score, CAST(0 AS BIGINT) AS n_candidates FROM src WHERE ord % 7 > 0 AND ord % 11 = 0),
    open_ AS (SELECT * FROM src WHERE ord % 7 > 0 AND ord % 11 > 0),
    firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ord) AS n FROM tgt WHERE code IS NOT NULL) WHERE n = 1),
    hits AS (SELECT o.ord AS s, f.ord AS t, 1 AS pr, CAST(0.95 AS DOUBLE) AS score, 'isrc' AS method FROM open_ o JOIN firsts f ON o.code = f.code),
    rest AS (SELECT * FROM open_ WHERE ord NOT IN (SELECT s FROM hits)), {O.pairs(100, 'rest')},
    kept AS (SELECT s, t, pr, score, method FROM hits UNION ALL SELECT s, t, pr, score, method FROM fuzzy),
    left_over AS (SELECT * FROM kept WHERE NOT (s % 3 = 0 AND t = s - 1)), {O.decisions('left_over', 'open_')}"""


@query("override_cascade", f"WITH {_OVERRIDDEN} SELECT * FROM decided UNION ALL SELECT * FROM manual UNION ALL SELECT * FROM skipped")
def _(spark, d):
    m, e = A.overrides(spark, d)
    return _decision_rows(matching.matched(A.parts(spark, d, codes=True), "a", "b", m, e, RARE))


@query("match_outcomes", f"""WITH {_OVERRIDDEN}, every AS (SELECT * FROM decided UNION ALL SELECT * FROM manual UNION ALL SELECT * FROM skipped)
    SELECT 'run-1' AS run_id, source_id AS source_track_id, decision, method, score AS top_score, n_candidates AS candidate_count FROM every""")
def _(spark, d):
    m, e = A.overrides(spark, d)
    return matching.outcomes(matching.matched(A.parts(spark, d, codes=True), "a", "b", m, e, RARE), "run-1", "a", "b").drop("recorded_at", "source_service", "target_service")


@query("pending_resolutions", f"""WITH {O.PARTS}, {O.pairs(100)}, best AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, pr) AS rk FROM fuzzy),
    amb AS (SELECT s FROM best WHERE rk = 1 AND score >= {O.dbl('0.65')} AND score < {O.dbl('0.85')}),
    n AS (SELECT best.*, row_number() OVER (PARTITION BY best.s ORDER BY rk) AS k FROM best JOIN amb USING (s) WHERE score >= {O.dbl('0.65')})
    SELECT 'p' || s AS source_id, k - 1 AS place, 'p' || t AS candidate_id, score, b.p_brand AS candidate_title, b.p_name AS candidate_artist, a.p_brand AS title, a.p_name AS artist, 'a>b' AS direction
    FROM n JOIN parts a ON a.ord = s JOIN parts b ON b.ord = t WHERE k <= 5""")
def _(spark, d):
    found = matching.pending_resolutions(A.parts(spark, d), [("a", "b")], p=RARE)
    return found.withColumn("place", F.col("place").cast("long"))


# ---- merging and stores


@query("keyed_merge", """
    WITH r AS (
        SELECT c_custkey AS k, c_name AS n, c_acctbal AS bal, 0 AS kind FROM customer
        UNION ALL SELECT s_suppkey, s_name, s_acctbal, 1 FROM supplier UNION ALL SELECT s_suppkey, s_name, s_acctbal, 2 FROM supplier
    ), t AS (
        SELECT *, k * 3 + kind AS ord, CASE WHEN k % 4 = 0 THEN NULL ELSE n END AS artist, CASE WHEN k % 5 > 1 THEN n END AS album, CASE WHEN k % 2 = 0 THEN 'C' || (k // 2) END AS code,
               CASE WHEN k % 3 = 0 THEN CAST(floor(bal) AS BIGINT) END AS seconds, CASE WHEN kind < 2 THEN 's' || k END AS a_id, CASE WHEN kind > 0 THEN 't' || k END AS b_id, CASE kind WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END AS av
        FROM r
    )
    SELECT min(ord) AS ord, arg_min('r' || ord, ord) AS id, arg_max(n, ord) AS title, arg_max(artist, ord) FILTER (WHERE artist IS NOT NULL) AS artist, arg_min(album, ord) FILTER (WHERE album IS NOT NULL) AS album, arg_min(code, ord) FILTER (WHERE code IS NOT NULL) AS code,
           coalesce(arg_min(seconds, ord) FILTER (WHERE seconds IS NOT NULL), -1) AS seconds, arg_max(a_id, ord) FILTER (WHERE a_id IS NOT NULL) AS a_id, arg_max(b_id, ord) FILTER (WHERE b_id IS NOT NULL) AS b_id, CAST(bit_or(av) AS INTEGER) AS availability, CAST(count(*) AS BIGINT) AS merged
    FROM t GROUP BY k""")
def _(spark, d):
    return merging.merged(A.accounts(spark, d)).drop("explicit").withColumn("seconds", F.coalesce("seconds", F.lit(-1)))


@query("renamed_ids", """
    WITH r AS (SELECT c_custkey AS k, 0 AS kind FROM customer UNION ALL SELECT s_suppkey, 1 FROM supplier UNION ALL SELECT s_suppkey, 2 FROM supplier)
    SELECT 'r' || (k * 3 + kind) AS old_id, 'r' || min(k * 3 + kind) OVER (PARTITION BY k) AS id FROM r""")
def _(spark, d):
    return merging.renamed_ids(A.accounts(spark, d))


@query("playlist_members", "SELECT 'c' || conv_id AS id, string_agg(md5(coalesce(text, '')), ',' ORDER BY turn, md5(coalesce(text, ''))) AS members, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY conv_id")
def _(spark, d):
    source, _ = A.conversation_lists(spark, d)
    return source.select("id", F.concat_ws(",", "track_ids").alias("members"), F.size("track_ids").cast("long").alias("n"))


@query("exclusion_state", """
    SELECT 'p' || p_partkey AS track_id, 'b' AS target_service, p_partkey % 11 = 0 AS skipped, CASE WHEN p_partkey % 3 = 0 THEN 'p' || (p_partkey - 1) ELSE '' END AS rejected
    FROM part WHERE p_partkey % 2 = 1 AND (p_partkey % 11 = 0 OR p_partkey % 3 = 0)""")
def _(spark, d):
    return stores.exclusion_state(A.overrides(spark, d)[1]).withColumn("rejected", F.concat_ws(",", "rejected"))


@query("mapping_upsert", """
    SELECT 'a' AS source_service, 'x' || p_partkey AS source_track_id, 'b' AS target_service, CASE WHEN p_partkey % 5 = 0 THEN 'new' ELSE 'p' || (p_partkey + 1) END AS target_track_id,
           CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_size % 2 = 0 THEN greatest(p_size / CAST(50 AS DOUBLE), CAST(0.99 AS DOUBLE)) ELSE CAST(1 AS DOUBLE) END WHEN p_partkey % 3 = 0 THEN CAST(0.99 AS DOUBLE) END AS confidence
    FROM part WHERE p_partkey % 2 = 1 AND (p_partkey % 7 = 0 OR p_partkey % 5 = 0)""")
def _(spark, d):
    m, e = A.overrides(spark, d)
    k = F.col("p_partkey")
    c = table(spark, d, "part").where((k % 2 == 1) & (k % 5 == 0)).select(F.lit("a").alias("source_service"), F.concat(F.lit("x"), k.cast("string")).alias("source_track_id"), F.lit("b").alias("target_service"), F.lit("new").alias("target_track_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") / F.lit(50.0)).alias("score"))
    return stores.choose(m, e, c)[0]


# ---- differences


_LISTS = """l AS (SELECT conv_id, list(md5(coalesce(text, '')) ORDER BY turn, md5(coalesce(text, ''))) AS ids,
    coalesce(list(md5(coalesce(text, '')) ORDER BY turn, md5(coalesce(text, ''))) FILTER (WHERE conv_id % 2 = 0 OR role <> 'assistant'), []) AS theirs FROM conversations GROUP BY conv_id)"""
_LIST_OPS = f"""{_LISTS}, ops AS (SELECT CASE WHEN conv_id % 3 = 0 THEN 'create_list' ELSE 'update_members' END AS op, 'b' AS service, 'c' || conv_id AS entity_id, conv_id, ids, {O.digest('ids')} AS digest FROM l WHERE conv_id % 3 = 0 OR ids <> theirs)"""


@query("playlist_diff", f"WITH {_LIST_OPS} SELECT op, service, entity_id, array_to_string(ids, ',') AS members, op || ':b-' || entity_id || CASE WHEN op = 'update_members' THEN ':' || digest ELSE '' END AS op_key FROM ops")
def _(spark, d):
    return syncing.list_ops(*A.conversation_lists(spark, d), "b").withColumn("members", F.concat_ws(",", "members"))


@query("playlist_incremental", f"""WITH {_LIST_OPS}, s AS (SELECT *, conv_id % 5 < 3 AS known, conv_id % 5 = 0 AS same FROM ops)
    SELECT CASE WHEN known THEN 'update_members' ELSE op END AS op, service, entity_id, array_to_string(ids, ',') AS members,
           CASE WHEN known OR op = 'update_members' THEN 'update_members:b-' || entity_id || ':' || digest ELSE op || ':b-' || entity_id END AS op_key
    FROM s WHERE NOT same""")
def _(spark, d):
    ops = syncing.list_ops(*A.conversation_lists(spark, d), "b")
    k = F.expr("cast(substr(list_id, 2) as bigint)")
    state = syncing.digest_state(ops).where(k % 5 < 3).withColumn("digest", F.when(k % 5 == 0, F.col("digest")).otherwise("old"))
    return syncing.changed_only(ops, state).withColumn("members", F.concat_ws(",", "members"))


@query("track_diff", f"WITH {_STRICT} SELECT 'add_track' AS op, 'b' AS service, source_id AS entity_id, 'add_track:b-' || source_id AS op_key FROM decided WHERE decision = 'no_match'")
def _(spark, d):
    return syncing.track_ops(matching.matched(A.parts(spark, d, codes=True), "a", "b", pending_only=True, p=STRICT), "b").drop("members")


@query("diff_summary", f"""WITH {_STRICT}, {_LIST_OPS}, every AS (SELECT 'add_track' AS op, 'b' AS service FROM decided WHERE decision = 'no_match' UNION ALL SELECT op, service FROM ops)
    SELECT op, service, CAST(count(*) AS BIGINT) AS n FROM every GROUP BY op, service""")
def _(spark, d):
    source, target = A.conversation_lists(spark, d)
    return syncing.diff_summary(syncing.library_diff(A.parts(spark, d, codes=True), source, "a", "b", target, STRICT))


# ---- the matching queries above with the reference's limits (500 and 0.65)


def _full(name: str, low: str = "0.65"):
    """Registers ``name`` with "_full": its SQL with the limits of the default policy."""
    sql = ORACLES[name].replace(O.pairs(100, "rest"), O.pairs(500, "rest")).replace(O.pairs(100), O.pairs())
    return query(f"{name}_full", sql.replace(O.decisions("both_ways", "src", low), O.decisions("both_ways", "src")))


@_full("match_cascade")
def _(spark, d):
    return _decision_rows(matching.matched(A.parts(spark, d, codes=True), "a", "b", p=P))


@_full("match_stats")
def _(spark, d):
    return matching.statistics(matching.matched(A.parts(spark, d, codes=True), "a", "b", p=P))


@_full("override_cascade")
def _(spark, d):
    m, e = A.overrides(spark, d)
    return _decision_rows(matching.matched(A.parts(spark, d, codes=True), "a", "b", m, e, P))


@_full("match_outcomes")
def _(spark, d):
    m, e = A.overrides(spark, d)
    return matching.outcomes(matching.matched(A.parts(spark, d, codes=True), "a", "b", m, e, P), "run-1", "a", "b").drop("recorded_at", "source_service", "target_service")


@_full("pending_resolutions")
def _(spark, d):
    found = matching.pending_resolutions(A.parts(spark, d), [("a", "b")], p=P)
    return found.withColumn("place", F.col("place").cast("long"))


@_full("track_diff", "0.8")
def _(spark, d):
    return syncing.track_ops(matching.matched(A.parts(spark, d, codes=True), "a", "b", pending_only=True, p=P), "b").drop("members")


@_full("diff_summary", "0.8")
def _(spark, d):
    source, target = A.conversation_lists(spark, d)
    return syncing.diff_summary(syncing.library_diff(A.parts(spark, d, codes=True), source, "a", "b", target, P))


# ---- checkpoints


_LOG = """log AS (SELECT 'o' || (l_orderkey % 50) AS run_id, CASE WHEN max(l_linenumber) > 1 THEN 'update_members:l:' || l_partkey || ':d' ELSE 'add_track:' || l_partkey END AS op_key,
    CASE WHEN max(l_returnflag) = 'R' THEN 'failed' ELSE 'done' END AS status, CASE WHEN max(l_linenumber) > 2 THEN 'm' || max(l_linenumber) || ',z' END AS previous, max(l_shipdate) AS t, l_orderkey * 100000 + l_partkey AS ord, l_partkey FROM lineitem GROUP BY l_orderkey, l_partkey)"""


@query("resume_remaining", f"WITH {_LOG} SELECT DISTINCT op_key FROM log WHERE op_key NOT IN (SELECT op_key FROM log WHERE run_id = 'o7' AND status = 'done')")
def _(spark, d):
    log = A.line_log(spark, d)
    return syncing.remaining(log.select("op_key").distinct(), log, "o7")


@query("rollback_plan", f"WITH {_LOG} SELECT op_key, 'l:' || l_partkey AS entity_id, previous AS members, CAST(row_number() OVER (ORDER BY t DESC, ord DESC) AS BIGINT) AS step FROM log WHERE run_id = 'o7' AND status = 'done' AND previous IS NOT NULL")
def _(spark, d):
    from concord.operators.ordering import numbered

    plan, _ = numbered(syncing.rollback_plan(A.line_log(spark, d), "o7"), F.desc("updated_at"), F.desc("ord"))
    return plan.select("op_key", "entity_id", F.concat_ws(",", "members").alias("members"), (F.col("n") + 1).alias("step"))


@query("checkpoint_upsert", f"""WITH {_LOG}, old AS (SELECT run_id, op_key, max(status) AS status, max(previous) AS previous FROM log WHERE ord % 3 > 0 GROUP BY run_id, op_key), new AS (SELECT run_id, op_key, min(status) AS status, max(previous) AS previous FROM log WHERE ord % 3 = 0 GROUP BY run_id, op_key)
    SELECT coalesce(n.run_id, o.run_id) AS run_id, coalesce(n.op_key, o.op_key) AS op_key, coalesce(n.status, o.status) AS status, coalesce(n.previous, o.previous) AS previous FROM old o FULL JOIN new n ON o.run_id = n.run_id AND o.op_key = n.op_key""")
def _(spark, d):
    log = A.line_log(spark, d)
    previous = F.concat_ws(",", F.from_json("previous_track_ids", "array<string>"))
    flat = log.withColumn("previous_track_ids", F.when(F.col("previous_track_ids").isNotNull(), previous))
    agg = lambda df, status: df.groupBy("run_id", "op_key").agg(status("status").alias("status"), F.max("previous_track_ids").alias("previous_track_ids"), F.max("error").alias("error"), F.max("updated_at").alias("updated_at"))
    out = stores.checkpoint_upsert(agg(flat.where("ord % 3 > 0"), F.max), agg(flat.where("ord % 3 = 0"), F.min))
    return out.select("run_id", "op_key", "status", F.col("previous_track_ids").alias("previous"))


@query("run_totals", f"""WITH {_LOG}, n AS (SELECT run_id, CAST(count(*) FILTER (WHERE status = 'done') AS BIGINT) AS succeeded, CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS failed, CAST(count(*) AS BIGINT) AS operations FROM log GROUP BY run_id)
    SELECT *, CAST(succeeded AS DOUBLE) / operations AS success_rate FROM n""")
def _(spark, d):
    return syncing.run_totals(A.line_log(spark, d))


# ---- metrics


_OUTCOMES = """o AS (SELECT CASE WHEN user_id % 7 > 0 THEN 'u' || user_id ELSE '(none)' END AS run_id, ts, CASE event_type WHEN 'click' THEN 'auto' WHEN 'view' THEN 'ambiguous' WHEN 'purchase' THEN 'no_match' ELSE 'skipped' END AS decision,
    CASE WHEN event_type <> 'error' THEN value / CAST(500 AS DOUBLE) END AS score FROM events),
    r AS (SELECT 'u' || user_id AS run_id, min(ts) AS started, CASE WHEN user_id % 4 = 0 THEN 'completed' ELSE 'failed' END AS status FROM events WHERE user_id % 2 = 0 GROUP BY user_id)"""


@query("run_metrics", f"""WITH {_OUTCOMES}, g AS (SELECT run_id, CAST(count(*) AS BIGINT) AS matches, {', '.join(f"CAST(count(*) FILTER (WHERE decision = '{x}') AS BIGINT) AS {x}" for x in ('auto', 'ambiguous', 'no_match'))}, avg(score) AS mean_score, min(ts) AS first FROM o GROUP BY run_id)
    SELECT coalesce(g.run_id, r.run_id) AS run_id, coalesce(r.status, CASE WHEN g.run_id = '(none)' THEN 'unassigned' ELSE 'dry_run' END) AS status, coalesce(started, first) AS start, coalesce(matches, 0) AS matches, coalesce(auto, 0) AS auto, coalesce(ambiguous, 0) AS ambiguous, coalesce(no_match, 0) AS no_match, round(mean_score, 6) AS mean_score, CAST(auto AS DOUBLE) / matches AS auto_rate
    FROM g FULL JOIN r ON g.run_id = r.run_id""")
def _(spark, d):
    return metrics.run_metrics(*A.event_outcomes(spark, d)).withColumn("mean_score", F.round("mean_score", 6))


@query("confidence_histogram", f"""WITH {_OUTCOMES}, k AS (SELECT DISTINCT run_id, decision FROM o WHERE score IS NOT NULL), b AS (SELECT run_id, decision, least(greatest(CAST(trunc(score * 10) AS BIGINT), 0), 9) AS bucket, count(*) AS n FROM o WHERE score IS NOT NULL GROUP BY ALL)
    SELECT k.run_id, k.decision, CAST(i AS BIGINT) AS bucket, CAST(coalesce(n, 0) AS BIGINT) AS n FROM k CROSS JOIN range(10) x(i) LEFT JOIN b ON b.run_id = k.run_id AND b.decision = k.decision AND b.bucket = i""")
def _(spark, d):
    return metrics.confidence_histogram(A.event_outcomes(spark, d)[0])


@query("timer_stats", """WITH g AS (SELECT event_type AS name, list_sort(list(value)) AS v, round(avg(value), 6) AS mean FROM events GROUP BY event_type)
    SELECT name, CAST(len(v) AS BIGINT) AS count, mean, v[1] AS min, v[len(v)] AS max, v[len(v) // 2 + 1] AS p50, v[CAST(floor(len(v) * CAST(0.95 AS DOUBLE)) AS BIGINT) + 1] AS p95, v[CAST(floor(len(v) * CAST(0.99 AS DOUBLE)) AS BIGINT) + 1] AS p99 FROM g""")
def _(spark, d):
    return metrics.timer_statistics(table(spark, d, "events").withColumnRenamed("event_type", "name")).withColumn("mean", F.round("mean", 6))


@query("error_top5", "SELECT props AS kind, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'error' GROUP BY props ORDER BY n DESC, kind LIMIT 5")
def _(spark, d):
    return metrics.error_top(table(spark, d, "events").where("event_type = 'error'").withColumnRenamed("props", "kind"), 5)


@query("recent_errors", "SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def _(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").withColumn("ord", F.col("event_id"))
    return metrics.recent_errors(e).select("event_id", "ts")


@query("metric_totals", "SELECT 'counter' AS kind, event_type AS name, round(sum(value), 4) AS value FROM events GROUP BY event_type UNION ALL SELECT 'gauge', event_type, arg_max(value, ts) FROM events GROUP BY event_type")
def _(spark, d):
    e = table(spark, d, "events").select(F.explode(F.array(F.lit("counter"), F.lit("gauge"))).alias("kind"), F.col("event_type").alias("name"), "value", "ts")
    return metrics.collected(e).withColumn("value", F.round("value", 4))


@query("library_summary", "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE c_custkey % 3 <> 1) AS BIGINT) AS on_a, CAST(count(*) FILTER (WHERE c_custkey % 3 <> 0) AS BIGINT) AS on_b, CAST(count(*) FILTER (WHERE c_custkey % 3 = 2) AS BIGINT) AS on_both FROM customer")
def _(spark, d):
    return metrics.library_summary(table(spark, d, "customer").select((F.col("c_custkey") % 3 + 1).cast("int").alias("availability")))


@query("library_search", "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red')")
def _(spark, d):
    q = F.lower(F.lit("RED"))
    return table(spark, d, "part").where(F.lower("p_name").contains(q) | F.lower("p_brand").contains(q)).select("p_partkey", "p_name", "p_brand")


@query("direction_filter", "SELECT 'p' || p_partkey AS id FROM part WHERE p_partkey % 2 = 1")
def _(spark, d):
    return syncing.pending_sources(A.parts(spark, d), "a", "b").select("id")


@query("search_text", """SELECT DISTINCT p_brand || ' (Live) [2017 Remaster]' AS title, trim(concat_ws(' ', trim(regexp_replace(p_brand || ' (Live) [2017 Remaster]', '\\s*(\\([^)]*\\)|\\[[^\\]]*\\])', '', 'g')), p_name)) AS q FROM part""")
def _(spark, d):
    title = F.concat("p_brand", F.lit(" (Live) [2017 Remaster]"))
    return table(spark, d, "part").select(title.alias("title"), text.search_text(title, F.col("p_name")).alias("q")).distinct()


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").k.alias("k"))


@query("eval_quality", """WITH c AS (SELECT CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS BIGINT) AS fn FROM labels)
    SELECT *, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / (tp + fn) AS recall, CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) AS f1 FROM c""")
def _(spark, d):
    return metrics.evaluation(table(spark, d, "labels"), "quality", "toxic")


# ---- look-ups, runs, reports


@query("point_lookup", "SELECT p_partkey AS ord, 'p' || p_partkey AS id FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part WHERE p_brand = 'Brand#11')")
def _(spark, d):
    return stores.find(A.parts(spark, d), "title", "Brand#11").select("ord", "id")


@query("recent_runs", f"WITH {_OUTCOMES} SELECT run_id AS id, status FROM r ORDER BY started DESC, run_id DESC LIMIT 10")
def _(spark, d):
    return stores.recent_runs(A.event_outcomes(spark, d)[1], 10).select("id", "status")


@query("library_stats", "SELECT *, least(on_a, on_b) AS both FROM (SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE c_custkey % 3 <> 1) AS BIGINT) AS on_a, CAST(count(*) FILTER (WHERE c_custkey % 3 <> 0) AS BIGINT) AS on_b FROM customer)")
def _(spark, d):
    return metrics.library_stats(table(spark, d, "customer").select((F.col("c_custkey") % 3 + 1).cast("int").alias("availability")))


@query("error_summary", "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(DISTINCT props) AS BIGINT) AS kinds, CAST(count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 1 HOUR) AS BIGINT) AS last_hour FROM events WHERE event_type = 'error'")
def _(spark, d):
    return metrics.error_summary(table(spark, d, "events").where("event_type = 'error'").withColumnRenamed("props", "kind"), "2024-01-02 00:00:00")


@query("dry_run_report", f"WITH {_LIST_OPS} SELECT CAST(count(*) AS BIGINT) AS operations, CAST(0 AS BIGINT) AS tracks, CAST(count(*) FILTER (WHERE op = 'create_list') AS BIGINT) AS created, CAST(count(*) FILTER (WHERE op = 'update_members') AS BIGINT) AS updated FROM ops")
def _(spark, d):
    return syncing.dry_run_report(syncing.list_ops(*A.conversation_lists(spark, d), "b"))


@query("list_order", f"WITH {_LIST_OPS} SELECT entity_id, CAST(row_number() OVER (ORDER BY conv_id DESC) AS BIGINT) AS place, CAST(count(*) OVER () AS BIGINT) AS lists FROM ops")
def _(spark, d):
    ops = syncing.list_ops(*A.conversation_lists(spark, d), "b").withColumn("ord", -F.expr("cast(substr(entity_id, 2) as bigint)"))
    return syncing.list_order(ops).withColumn("place", F.col("place").cast("long"))


@query("run_state", f"""WITH {_LOG}, k AS (SELECT DISTINCT op_key FROM log), own AS (SELECT op_key, max(CAST(status = 'done' AS INTEGER)) AS done FROM log WHERE run_id = 'o7' GROUP BY op_key),
    n AS (SELECT CAST(count(*) AS BIGINT) AS operations, CAST(count(*) FILTER (WHERE done = 1) AS BIGINT) AS succeeded, CAST(count(*) FILTER (WHERE done = 0) AS BIGINT) AS failed FROM k LEFT JOIN own USING (op_key))
    SELECT *, operations - succeeded - failed AS open, CAST(succeeded + failed AS DOUBLE) / operations AS fraction, CASE WHEN operations > succeeded + failed THEN 'cancelled' WHEN failed > 0 THEN 'failed' ELSE 'completed' END AS status FROM n""")
def _(spark, d):
    log = A.line_log(spark, d)
    return syncing.run_state(log.select("op_key"), log, "o7")


@query("resolver_choices", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'choose' WHEN 1 THEN 'reject' WHEN 2 THEN 'skip' WHEN 3 THEN 'quit' ELSE 'invalid' END AS action, CASE WHEN p_partkey % 5 < 2 THEN CAST(p_size AS INTEGER) ELSE -1 END AS choice FROM part""")
def _(spark, d):
    k, n = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    answer = F.when(k == 0, n).when(k == 1, F.concat(F.lit(" X"), n)).when(k == 2, "S").when(k == 3, "q").otherwise("what")
    rows = matching.parsed_choices(table(spark, d, "part").select("p_partkey", answer.alias("answer")))
    return rows.select("p_partkey", "action", F.coalesce("choice", F.lit(-1)).alias("choice"))


@query("insert_or_ignore", "SELECT 'p' || p_partkey AS track_id, CASE WHEN p_partkey % 2 = 0 THEN 'old' ELSE 'new' END AS kind FROM part")
def _(spark, d):
    every = table(spark, d, "part").select("p_partkey", F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("track_id"))
    rows = lambda df, kind: df.select("track_id", F.lit(kind).alias("kind"))
    return stores.insert_or_ignore(rows(every.where("p_partkey % 2 = 0"), "old"), rows(every.unionByName(every), "new"), ["track_id"])


@query("applied_tracks", "SELECT 'p' || p_partkey AS id, CAST(CASE WHEN p_partkey % 2 = 0 THEN 2 WHEN p_partkey % 3 = 0 THEN 3 ELSE 1 END AS INTEGER) AS availability FROM part")
def _(spark, d):
    records = A.parts(spark, d)
    ops = records.where("ord % 3 = 0 AND ord % 2 = 1").select(F.lit("add_track").alias("op"), F.lit("b").alias("service"), F.col("id").alias("entity_id"))
    return syncing.applied_tracks(records, ops).select("id", "availability")


# ---- services (recorded answers), decisions by hand, runs


@query("paged_tracks_a", """SELECT 'x' || p_partkey AS id, p_name AS name, p_brand AS artist, p_type AS album, CAST(p_size AS BIGINT) * 1000 + 499 AS duration_ms, p_partkey % 2 = 0 AS explicit, CASE WHEN p_partkey % 3 = 0 THEN 'us' || p_partkey END AS code
    FROM part WHERE p_partkey % 17 > 0 AND p_partkey % 13 > 0 AND p_partkey % 11 > 0""")
def _(spark, d):
    from concord.sources import paged

    folder, total = A.recorded_tracks(spark, d, "a")
    raw = paged.read_service(spark, [f"recorded://service/t?folder={A.quote(folder)}"], transport="concord.sources.requests:recorded_page", total=total, limit=A.PER_PAGE, rate=1e6)
    found = paged.P.tracks_a(paged.P.parsed(paged.landed(raw), paged.S.PAGE_A))
    return found.withColumn("artist", F.get("artists", F.lit(0))).drop("artists")


@query("paged_tracks_b", """SELECT CASE WHEN p_partkey % 5 = 0 THEN 'c' ELSE 'x' END || p_partkey AS id, p_name AS name, p_brand AS artist, p_type AS album, CAST(p_size AS BIGINT) * 1000 + 500 AS duration_ms, CASE WHEN p_partkey % 3 < 2 THEN CAST(p_partkey % 3 = 0 AS INTEGER) ELSE -1 END AS explicit, CASE WHEN p_partkey % 3 = 0 THEN 'us' || p_partkey END AS code
    FROM part WHERE p_partkey % 17 > 0""")
def _(spark, d):
    from concord.sources import paged

    folder, _ = A.recorded_tracks(spark, d, "b")
    raw = paged.read_service(spark, [f"/t?folder={A.quote(folder)}&limit={A.PER_PAGE}"], base="recorded://service", transport="concord.sources.requests:recorded_page", rate=1e6)
    found = paged.P.tracks_b(paged.P.parsed(paged.landed(raw), paged.S.PAGE_B))
    return found.withColumn("explicit", F.coalesce(F.col("explicit").cast("int"), F.lit(-1)))


@query("catalogue_search", """SELECT p_name || ' ' || p_brand AS q, 'c' || p_partkey AS id, p_name AS name, p_brand AS artist, p_partkey % 2 = 0 AS explicit
    FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS n FROM part) WHERE n <= 5""")
def _(spark, d):
    from concord.session import shared_dir
    from concord.sources import search

    folder = A.recorded_catalogue(spark, d)
    cache = search.search_cache(spark, f"{shared_dir(spark)}/answers-{A.uuid.uuid4().hex}")
    q = table(spark, d, "part").select(text.search_text(F.concat("p_name", F.lit(" (Live)")), F.col("p_brand")).alias("q"))
    more = {"base": "recorded://service", "transport": "concord.sources.requests:recorded_search", "rate": 1e6, "folder": folder, "chunks": 16}
    halves = [q.where(F.crc32(F.col("q").cast("binary")) % 2 == 0), q]  # the second time, half of the answers are known
    found = [search.looked_up(x, "b", cache, **more) for x in halves]
    return found[-1].select("q", "id", "name", "artist", "explicit")


@query("skipped_and_reset", """SELECT 'p' || p_partkey AS track_id, 'b' AS target_service, CASE WHEN p_partkey % 3 = 0 THEN 'reject' ELSE 'skip' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'p' || (p_partkey + 1) ELSE '' END AS candidate_id FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 5 > 0""")
def _(spark, d):
    from concord.operators import resolution

    name = lambda c: F.concat(F.lit("p"), F.expr(c).cast("string"))
    own = table(spark, d, "part").where("p_partkey % 2 = 1").select("p_partkey", name("p_partkey").alias("track_id"), F.concat(F.lit("x"), F.col("p_partkey").cast("string")).alias("source_track_id"))
    m, e = A.overrides(spark, d)
    e = resolution.skip(e.limit(0), own.where("p_partkey % 3 > 0"), "b")
    e = resolution.reject(e, own.where("p_partkey % 3 = 0").withColumn("candidate_id", name("p_partkey + 1")), "b")
    return resolution.reset(m, e, own.where("p_partkey % 5 = 0"), "a", "b")[1]


@query("library_filter", "SELECT 'p' || p_partkey AS id FROM part WHERE p_partkey % 3 = 2 AND contains(lower(p_name), 'red')")
def _(spark, d):
    from concord.operators import resolution

    rows = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("artist"), (F.col("p_partkey") % 3 + 1).cast("int").alias("availability"))
    return resolution.free_text(resolution.library_filter(rows, "both"), "RED").select("id")


def _library(spark, d, remote=None):
    """A library whose records are parts and whose lists are conversations, and a runner on it."""
    from concord.operators import running
    from concord.session import shared_dir

    store = running.library(spark, f"{shared_dir(spark)}/library-{A.uuid.uuid4().hex}")
    lists, _ = A.conversation_lists(spark, d)
    store.commit("start", {"records": A.parts(spark, d, codes=True), "lists": lists.withColumn("name", F.col("id"))})
    return store, running.Runner(store, remote or running.LocalLibrary())


_RUN_OPS = f"""{_WITH_CODES.replace(O.pairs(100, 'rest'), O.pairs(500, 'rest'))}, {_LISTS.replace('l AS', 'll AS')},
    every AS (SELECT 'add_track:b-' || source_id AS op_key FROM decided WHERE decision = 'no_match'
        UNION ALL SELECT CASE WHEN conv_id % 3 = 0 THEN 'create_list:b-c' || conv_id ELSE 'update_members:b-c' || conv_id || ':' || {O.digest('ids')} END FROM ll)"""


@query("run_performed", f"WITH {_RUN_OPS} SELECT op_key, 'done' AS status FROM every")
def _(spark, d):
    store, runner = _library(spark, d)
    runner.perform("a>b")
    return store.read("checkpoints").select("op_key", "status")


def _refused(op):
    """An effect that does not take one list in four."""
    from concord.sources.requests import ServiceError

    if op["members"] is not None and int(op["entity_id"][1:]) % 4 == 0:
        raise ServiceError(400)


@query("run_resumed", f"""WITH {_RUN_OPS.replace("SELECT CASE WHEN conv_id", "SELECT CASE WHEN conv_id % 4 = 0 THEN '4:' ELSE '' END || CASE WHEN conv_id")}
    SELECT CAST(count(*) AS BIGINT) AS operations, CAST(count(*) FILTER (WHERE op_key LIKE 'add_track%' OR op_key LIKE '4:%') AS BIGINT) AS succeeded, CAST(0 AS BIGINT) AS failed, 'completed' AS status, CAST(count(*) AS BIGINT) AS rows FROM every""")
def _(spark, d):
    from concord.operators import running

    store, runner = _library(spark, d, running.Effects(_refused, rate=1e6, parallel=8, batch=1_000_000))
    run = runner.perform("a>b").run_id
    running.Runner(store, running.LocalLibrary()).resume(run)  # lists that were taken are no longer different; tracks are skipped by their rows
    done = store.read("checkpoints").where("status = 'done'").groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("rows"))
    return store.read("runs").join(done, "id").select(F.col("operations_count").alias("operations"), F.col("success_count").alias("succeeded"), F.col("failure_count").alias("failed"), "status", "rows")


@query("run_rolled_back", """SELECT 'c' || conv_id AS id, string_agg(md5(coalesce(text, '')), ',' ORDER BY turn, md5(coalesce(text, ''))) AS members FROM conversations GROUP BY conv_id""")
def _(spark, d):
    store, runner = _library(spark, d)
    lists = store.read("lists").where("b_id is not null")
    ops = lists.select(F.lit("update_members").alias("op"), F.lit("b").alias("service"), F.col("id").alias("entity_id"), F.reverse("track_ids").alias("members")).withColumn("op_key", ids.op_key(F.col("op"), F.concat_ws("-", "service", "entity_id"), ids.members_digest(F.col("members"))))
    runner.rollback(runner.execute(ops, "a>b").run_id)
    return store.read("lists").select("id", F.concat_ws(",", "track_ids").alias("members"))


# ---- stores, projections and differences that had no query


@query("outcomes_in_time", f"WITH {_OUTCOMES.split('r AS (')[0].rstrip().rstrip(',').replace('SELECT CASE WHEN user_id', 'SELECT event_id, CASE WHEN user_id')} SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS place FROM o")
def _(spark, d):
    from concord.operators.ordering import numbered

    return numbered(table(spark, d, "events").select("event_id", F.col("ts").alias("recorded_at")), "recorded_at", "event_id", name="place")[0].select("event_id", "place")


@query("saved_lists", "SELECT 'c' || conv_id AS list_id, CAST(CASE WHEN conv_id % 2 = 0 THEN count(*) ELSE 1 END AS BIGINT) AS n, CAST(CASE WHEN conv_id % 2 = 0 THEN count(*) - 1 ELSE 0 END AS BIGINT) AS last FROM conversations GROUP BY conv_id")
def _(spark, d):
    from pyspark.sql.types import LongType

    lists, _ = A.conversation_lists(spark, d)
    members = lists.select(F.col("id").alias("list_id"), F.lit("old").alias("track_id"), F.lit(0).cast(LongType()).alias("position"))
    new = lists.where("cast(substr(id, 2) as bigint) % 2 = 0").select("id", "track_ids")
    _, after = stores.save_lists(lists.select("id"), members, new)
    return after.groupBy("list_id").agg(F.count("*").alias("n"), F.max("position").alias("last"))


@query("deleted_records", "SELECT 'o' || o_orderkey AS id, CAST(count(*) AS BIGINT) AS children FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 3 > 0 GROUP BY o_orderkey")
def _(spark, d):
    name = lambda c: F.concat(F.lit("o"), F.col(c).cast("string"))
    orders, lines = table(spark, d, "orders").select(name("o_orderkey").alias("id"), "o_orderkey"), table(spark, d, "lineitem").select(name("l_orderkey").alias("order_id"))
    rest, children = stores.delete_records(orders.select("id"), {"lines": (lines, "order_id")}, orders.where("o_orderkey % 3 = 0").select("id"))
    return rest.join(children["lines"].groupBy(F.col("order_id").alias("id")).agg(F.count("*").alias("children")), "id")


@query("run_upsert", """SELECT 'u' || user_id AS id, CASE WHEN user_id % 6 = 0 THEN 'completed' WHEN user_id % 4 = 0 THEN 'completed' ELSE 'failed' END AS status FROM events WHERE user_id % 2 = 0 GROUP BY user_id""")
def _(spark, d):
    runs = A.event_outcomes(spark, d)[1].select("id", "status", "started_at")
    new = runs.where("cast(substr(id, 2) as bigint) % 6 = 0").withColumn("status", F.lit("completed"))
    return stores.upsert(runs, new, ["id"], "started_at").select("id", "status")


@query("digest_upsert", f"WITH {_LIST_OPS} SELECT service, entity_id AS list_id, CASE WHEN conv_id % 5 = 0 THEN digest ELSE 'old' END AS digest FROM ops")
def _(spark, d):
    new = syncing.digest_state(syncing.list_ops(*A.conversation_lists(spark, d), "b"))
    return stores.upsert(new.withColumn("digest", F.lit("old")), new.where("cast(substr(list_id, 2) as bigint) % 5 = 0"), ["service", "list_id"])


_CANONICAL = """SELECT CASE WHEN p_partkey % 3 = 0 THEN 'isrc:US' || p_partkey ELSE substr(sha256({artist} || '|' || lower(p_name) || '|' || lower(p_type) || '|' || p_size), 1, 32) END AS id, p_name AS title, {shown} AS artist, p_type AS album,
    CASE WHEN p_partkey % 3 = 0 THEN 'us' || p_partkey END AS code, CAST(p_size AS BIGINT) AS seconds, {side} AS {mine}, CAST({flag} AS INTEGER) AS availability FROM part"""


@query("canonical_a", _CANONICAL.format(artist="CASE WHEN p_partkey % 7 = 0 THEN 'unknown artist' ELSE lower(p_brand) END", shown="CASE WHEN p_partkey % 7 = 0 THEN 'Unknown Artist' ELSE p_brand END", side="'x' || p_partkey", mine="a_id", flag="1"))
def _(spark, d):
    return A.canonical_parts(spark, d, "a").drop("explicit", "b_id")


@query("canonical_b", _CANONICAL.format(artist="lower(p_brand)", shown="p_brand", side="'x' || p_partkey", mine="b_id", flag="2"))
def _(spark, d):
    return A.canonical_parts(spark, d, "b").drop("explicit", "a_id")


@query("canonical_lists", """WITH l AS (SELECT conv_id, string_agg('isrc:' || upper(md5(coalesce(text, ''))), ',' ORDER BY turn, md5(coalesce(text, ''))) AS ids FROM conversations GROUP BY conv_id)
    SELECT 'apple:c' || conv_id AS id, 'c' || conv_id AS b_id, ids FROM l""")
def _(spark, d):
    from concord.sources import pages

    lists, _ = A.conversation_lists(spark, d)
    none = "CAST(NULL AS STRING)"
    track = f"named_struct('id', x, 'name', x, 'artist', x, 'album', {none}, 'duration_ms', CAST(NULL AS BIGINT), 'explicit', CAST(NULL AS BOOLEAN), 'code', x)"
    raw = lists.selectExpr("id", "id AS name", f"{none} AS description", f"{none} AS owner", f"transform(track_ids, x -> {track}) AS tracks")
    heads, _ = pages.canonical_list_tracks(raw, "b")
    return heads.select("id", "b_id", F.concat_ws(",", "track_ids").alias("ids"))


@query("score_bands", "SELECT event_id, CASE WHEN value / CAST(500 AS DOUBLE) >= CAST(0.85 AS DOUBLE) THEN 'auto' WHEN value / CAST(500 AS DOUBLE) >= CAST(0.65 AS DOUBLE) THEN 'ambiguous' ELSE 'no_match' END AS band FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", sim.band(F.col("value") / F.lit(500.0)).alias("band"))


@query("latest_resumable", f"WITH {_OUTCOMES}, x AS (SELECT * FROM r ORDER BY started DESC, run_id DESC LIMIT 1) SELECT run_id AS id, status FROM x WHERE status <> 'completed'")
def _(spark, d):
    return stores.latest_resumable(A.event_outcomes(spark, d)[1]).select("id", "status")


@query("previous_members", f"WITH {_LIST_OPS} SELECT ops.entity_id, CASE WHEN op = 'update_members' THEN array_to_string(l.theirs, ',') ELSE '-' END AS previous FROM ops JOIN l USING (conv_id)")
def _(spark, d):
    source, target = A.conversation_lists(spark, d)
    rows = syncing.with_previous(syncing.list_ops(source, target, "b"), target)
    return rows.select("entity_id", F.when(F.col("previous_track_ids").isNull(), "-").otherwise(F.concat_ws(",", "previous_track_ids")).alias("previous"))


@query("duration_difference", "SELECT p_partkey, coalesce(abs(CASE WHEN p_size % 9 > 0 THEN CAST(p_size AS BIGINT) END - 25), -1) AS apart FROM part")
def _(spark, d):
    size = F.when(F.col("p_size") % 9 > 0, F.col("p_size").cast("long"))
    return table(spark, d, "part").select("p_partkey", F.coalesce(sim.duration_difference(size, F.lit(25)), F.lit(-1)).alias("apart"))


@query("keyed_merge_explicit", """WITH r AS (SELECT c_custkey AS k, 0 AS kind FROM customer UNION ALL SELECT s_suppkey, 1 FROM supplier UNION ALL SELECT s_suppkey, 2 FROM supplier)
    SELECT 'r' || min(k * 3 + kind) AS id, arg_min(CASE WHEN kind > 0 THEN k % 2 = 0 END, kind) FILTER (WHERE kind > 0) IS NOT NULL AS known, coalesce(arg_min(CASE kind WHEN 1 THEN k % 2 = 0 ELSE k % 5 = 0 END, kind) FILTER (WHERE kind > 0), false) AS explicit FROM r GROUP BY k""")
def _(spark, d):
    k, kind = F.floor(F.col("ord") / 3), F.col("ord") % 3
    rows = A.accounts(spark, d).withColumn("explicit", F.when(kind == 1, k % 2 == 0).when(kind == 2, k % 5 == 0))
    return merging.merged(rows).select("id", F.col("explicit").isNotNull().alias("known"), F.coalesce("explicit", F.lit(False)).alias("explicit"))


#: Parts, one source in nine of which shares no word with any other.
_LONE = O.PARTS.replace("FROM part\n", "FROM (SELECT p_partkey, p_brand, p_type, p_size, CASE WHEN p_partkey % 9 = 1 THEN 'zz' || p_partkey ELSE p_name END AS p_name FROM part)\n")


@query("track_diff_unmatched", f"""WITH {_LONE}, {O.pairs()}, {O.decisions('fuzzy', 'src')}
    SELECT source_id AS entity_id, 'add_track:b-' || source_id AS op_key FROM decided WHERE decision = 'no_match'""")
def _(spark, d):
    lone = F.when(F.col("ord") % 9 == 1, F.concat(F.lit("zz"), F.col("ord").cast("string"))).otherwise(F.col("artist"))
    return syncing.track_ops(matching.matched(A.parts(spark, d).withColumn("artist", lone), "a", "b", pending_only=True, p=P), "b").select("entity_id", "op_key")


@query("both_directions", f"""WITH l AS (SELECT conv_id FROM conversations GROUP BY conv_id), u AS (SELECT 'a' AS service, 'update_members' AS op, conv_id FROM l WHERE conv_id % 3 > 0 UNION ALL SELECT 'b', CASE WHEN conv_id % 3 = 0 THEN 'create_list' ELSE 'update_members' END, conv_id FROM l)
    SELECT op, service, CAST(count(*) AS BIGINT) AS n FROM u GROUP BY op, service""")
def _(spark, d):
    lists, _ = A.conversation_lists(spark, d)
    records = A.parts(spark, d).where("ord % 2 = 1 AND ord % 2 = 0")  # lists only; records have queries of their own
    return syncing.diff_summary(syncing.compute_diff(records, lists, syncing.digest_state(syncing.list_ops(lists, lists, "b")).limit(0), "both"))


@query("evaluation_curve", """WITH e AS (SELECT event_type AS category, CASE WHEN event_id % 50 > 0 THEN least(CAST(floor(value / CAST(500 AS DOUBLE) * 20) AS BIGINT), 20) ELSE -1 END AS bucket, user_id % 3 = 0 AS truth FROM events),
    b AS (SELECT category, bucket, truth FROM e UNION ALL SELECT '(all)', bucket, truth FROM e), c AS (SELECT DISTINCT category FROM b),
    t AS (SELECT c.category, CAST(i AS DOUBLE) / 20 AS threshold, CAST(count(*) FILTER (WHERE truth AND bucket >= i) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE NOT truth AND bucket >= i) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE truth AND bucket < i) AS BIGINT) AS fn
        FROM c CROSS JOIN range(21) r(i) JOIN b ON b.category = c.category GROUP BY c.category, i)
    SELECT category, threshold, tp, fp, fn, coalesce(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) END, -1) AS precision, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END AS recall, CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) AS f1 FROM t""")
def _(spark, d):
    pairs = table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 50 > 0, F.col("value") / F.lit(500.0)).alias("score"), (F.col("user_id") % 3 == 0).alias("truth"))
    rows = metrics.evaluation_curve(pairs, "event_type", "score", "truth", 20)
    return rows.withColumns({"category": F.coalesce("category", F.lit("(all)")), "precision": F.coalesce("precision", F.lit(-1.0))})


_SIDES = """s AS (SELECT conv_id, 'm' || md5(coalesce(text, '')) AS track, turn % 4 <> 1 AS mine, turn % 3 <> 1 AS other, turn % 5 <> 1 AS old FROM conversations),
    x AS (SELECT conv_id, track, CAST(count(*) FILTER (WHERE mine) AS BIGINT) AS a, CAST(count(*) FILTER (WHERE other) AS BIGINT) AS b, CAST(count(*) FILTER (WHERE old) AS BIGINT) AS c FROM s GROUP BY conv_id, track)"""


def _list_sides(spark, d):
    """Conversations as a list of three sides, each without some turns."""
    rows = A.conversation_members(spark, d).withColumn("track_id", F.concat(F.lit("m"), "track_id"))
    heads = rows.select(F.col("list_id").alias("id")).distinct()
    return [stores.lists_with_members(heads, rows.where(f"position % {k} <> 1").select("list_id", "track_id", "position")) for k in (4, 3, 5)]


def _counted(lists):
    return lists.select("id", F.explode("track_ids").alias("track")).groupBy("id", "track").agg(F.count("*").alias("n"))


@query("list_union", f"WITH {_SIDES} SELECT 'c' || conv_id AS id, track, greatest(a, b) AS n FROM x WHERE greatest(a, b) > 0")
def _(spark, d):
    from concord.operators.list_merging import merged_lists

    ours, theirs, _ = _list_sides(spark, d)
    return _counted(merged_lists(ours, theirs))


@query("list_intersection", f"WITH {_SIDES} SELECT 'c' || conv_id AS id, track, least(a, b) AS n FROM x WHERE least(a, b) > 0")
def _(spark, d):
    from concord.operators.list_merging import merged_lists

    ours, theirs, _ = _list_sides(spark, d)
    return _counted(merged_lists(ours, theirs, how="intersection"))


@query("list_three_way", f"WITH {_SIDES}, n AS (SELECT conv_id, track, least(a, b, c) + greatest(greatest(a, b) - c, 0) AS n FROM x) SELECT 'c' || conv_id AS id, track, n FROM n WHERE n > 0")
def _(spark, d):
    from concord.operators.list_merging import merged_lists

    return _counted(merged_lists(*_list_sides(spark, d)))


_DESCRIBED = "CASE WHEN p_partkey % 3 = 0 THEN 'isrc:US' || p_partkey ELSE substr(sha256(lower(p_brand) || '|' || lower(p_name) || '|' || lower(p_type) || '|' || {0}), 1, 32) END"


@query("imported_library", f"""WITH x AS (SELECT {_DESCRIBED.format('p_size')} AS id, 1 AS flag FROM part WHERE p_partkey % 17 > 0 AND p_partkey % 13 > 0 AND p_partkey % 11 > 0
        UNION ALL SELECT {_DESCRIBED.format('(p_size + 1)')}, 2 FROM part WHERE p_partkey % 17 > 0)
    SELECT id, CAST(bit_or(flag) AS INTEGER) AS availability FROM x GROUP BY id""")
def _(spark, d):
    from concord.operators import importing, running
    from concord.session import shared_dir
    from concord.sources import paged

    store = running.library(spark, f"{shared_dir(spark)}/library-{A.uuid.uuid4().hex}")
    more = {"base": "recorded://service", "transport": "concord.sources.requests:recorded_page", "rate": 1e6}
    for service, decode, page in (("a", paged.P.tracks_a, paged.S.PAGE_A), ("b", paged.P.tracks_b, paged.S.PAGE_B)):
        folder, total = A.recorded_tracks(spark, d, service)
        spread = max(1, -(-total // A.READ_BY_ONE))  # ranges of offsets, so that the readers grow with the library
        raw = paged.landed(paged.read_service(spark, [f"/t?folder={A.quote(folder)}"], total=total, limit=A.PER_PAGE, parallel=spread, **more))
        none = spark.createDataFrame([], f"id string, name string, description string, owner string, tracks array<{paged.P.track_type(service)}>")
        importing.imported(store, service, decode(paged.P.parsed(raw, page)), none)
    return store.read("records").select("id", "availability")


# ---- the plain names stand for the published limits; narrowed ones, which cut more, have names of their own

for _n in ("match_cascade", "match_stats", "override_cascade", "match_outcomes", "pending_resolutions", "track_diff", "diff_summary"):
    QUERIES[f"{_n}_narrow"], ORACLES[f"{_n}_narrow"] = QUERIES[_n], ORACLES[_n]
    QUERIES[_n], ORACLES[_n] = QUERIES[f"{_n}_full"], ORACLES[f"{_n}_full"]
    del QUERIES[f"{_n}_full"], ORACLES[f"{_n}_full"]
