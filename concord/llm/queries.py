"""The registered queries of the corpus operators, with their production parameters."""

from __future__ import annotations

import public_tokenizers

from concord.session import table


def op1_token_counts(spark, sf_dir):
    from concord.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op2_order_minhash(spark, sf_dir):
    from concord.llm.near import near_classes

    return near_classes(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark, sf_dir):
    from concord.llm.html import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark, sf_dir):
    from concord.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op5_mixing(spark, sf_dir):
    from concord.llm.mixing import mixed

    return mixed(table(spark, sf_dir, "documents"), block=20_000, slots=1000, alpha=0.7)


def op6_quality_classifier(spark, sf_dir):
    from concord.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark, sf_dir):
    from concord.llm.exact import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op8_language_model(spark, sf_dir):
    from concord.llm.language_model import language_scores

    return language_scores(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark, sf_dir):
    from concord.llm.neighbours import nearest_vectors

    return nearest_vectors(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op10_repeated_strings(spark, sf_dir):
    from concord.llm.repeats import removed

    return removed(table(spark, sf_dir, "documents"), length=200)


def op11_periodic_runs(spark, sf_dir):
    from concord.llm.periodic import periodic_runs, planted_words

    return periodic_runs(table(spark, sf_dir, "documents"), words_of=planted_words)


def op12_resampling(spark, sf_dir):
    from concord.llm.resampling import resampled

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_language_id(spark, sf_dir):
    from concord.llm.languages import predicted_languages

    return predicted_languages(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_order_minhash": op2_order_minhash,
    "op3_html_extraction": op3_html_extraction,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_mixing": op5_mixing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_language_model": op8_language_model,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_repeated_strings": op10_repeated_strings,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_resampling": op12_resampling,
    "op13_language_id": op13_language_id,
}

#: DuckDB SQL for those that SQL can express.
ORACLES: dict[str, str] = {
    "op7_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
            FROM documents
        ), g AS (SELECT h, max(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM d GROUP BY h)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
        FROM d JOIN g USING (h)
    """,
}

ORACLES["op5_mixing"] = """
    WITH RECURSIVE d AS (
        SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey, length(coalesce(text, '')) AS volume,
               md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS o
        FROM documents
    ), b AS (
        SELECT *, CAST((sum(volume) OVER (PARTITION BY skey ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) - volume) // 20000 AS BIGINT) AS block FROM d
    ), v AS (
        SELECT skey, sum(volume) AS volume, round(pow(CAST(greatest(sum(volume), 1) AS DOUBLE), 0.7), 6) AS w FROM d GROUP BY skey
    ), src AS (
        SELECT *, CAST(floor(log2(w) * 32) AS BIGINT) AS cls FROM v
    ), turns AS (
        SELECT *, row_number() OVER (PARTITION BY cls ORDER BY md5(skey)) - 1 AS turn FROM src
    ), c AS (
        SELECT cls, count(*) AS members, CAST(sum(CAST(w AS DECIMAL(30, 6))) AS DOUBLE) AS w, count(*) OVER () AS n FROM src GROUP BY cls
    ), e AS (
        SELECT *, greatest(1000, 16 * n) AS total, w / (SELECT CAST(sum(CAST(w AS DECIMAL(30, 6))) AS DOUBLE) FROM src) * (greatest(1000, 16 * n) - n) AS exact FROM c
    ), shares AS (
        SELECT cls, members, total, CAST(1 + floor(exact) + CASE WHEN row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, cls) <= total - n - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS share FROM e
    ), one AS (
        SELECT list(share ORDER BY cls) AS s, list(cls ORDER BY cls) AS cs, CAST(max(total) AS BIGINT) AS total FROM shares
    ), edf AS (
        SELECT CAST(0 AS BIGINT) AS slot, list_transform(s, lambda x: CAST(0 AS BIGINT)) AS done, CAST(NULL AS BIGINT) AS pick FROM one
        UNION ALL
        SELECT slot + 1, list_transform(done, lambda x, i: x + CASE WHEN i = p THEN 1 ELSE 0 END), p
        FROM (
            SELECT slot, done, list_sort(list_filter(list_transform(s, lambda x, i: {'deadline': ((done[i] + 1) * total + x - 1) // x, 'heavier': -x, 'i': CAST(i AS BIGINT), 'released': (done[i] * total) // x}), lambda x: x.released <= slot))[1].i AS p
            FROM edf, one WHERE slot < total
        )
    ), places AS (
        SELECT cs[pick] AS cls, slot - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS k FROM edf, one WHERE pick IS NOT NULL
    ), z AS (SELECT sum(volume // 20000 + 1) AS stop FROM v)
    SELECT b.doc_id, b.source, b.block, CAST(((b.block * members + turn) // share) * total + places.slot AS BIGINT) AS slot,
           ((b.block * members + turn) // share) * total + places.slot < stop AS in_mix
    FROM b JOIN turns USING (skey) JOIN shares USING (cls) JOIN places ON places.cls = shares.cls AND places.k = (b.block * members + turn) % share, z
"""

ORACLES["op10_repeated_strings"] = """
    WITH t AS (
        SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents
    ), pieces AS (
        SELECT r, 1000 * k AS base, substr(h, 2000 * k + 1, 2398) AS piece FROM (SELECT r, h, unnest(range(0, greatest(0, (length(h) // 2 + 800) // 1000))) AS k FROM t)
    ), w AS (
        SELECT r, base + j AS s, md5_number(substr(piece, 2 * j + 1, 400)) AS name
        FROM (SELECT r, base, piece, unnest(range(0, least(1000, greatest(0, length(piece) // 2 - 199)))) AS j FROM pieces)
    ), twice AS (
        SELECT name FROM w GROUP BY name HAVING count(*) > 1
    ), hit AS (
        SELECT r, s, coalesce(s > lag(s) OVER (PARTITION BY r ORDER BY s) + 200, true) AS opens FROM w SEMI JOIN twice USING (name)
    ), spans AS (
        SELECT r, min(s) AS lo, max(s) + 200 AS hi FROM (SELECT r, s, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY r ORDER BY s) AS g FROM hit) GROUP BY r, g
    ), gaps AS (
        SELECT r, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS a, lo AS b FROM spans
        UNION ALL SELECT r, max(hi), (SELECT length(h) // 2 FROM t WHERE t.r = spans.r) FROM spans GROUP BY r
    ), kept AS (
        SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS rest FROM gaps JOIN t USING (r) GROUP BY r
    ), sums AS (SELECT r, sum(hi - lo) AS gone, count(*) AS n FROM spans GROUP BY r)
    SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
           sha256(unhex(coalesce(rest, h))) AS kept_sha256
    FROM t LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""

ORACLES["op12_resampling"] = r"""
    WITH d AS (
        SELECT 0 AS side, doc_id AS id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents
        UNION ALL SELECT 1, item_id, row_number() OVER (), coalesce(text, '') FROM benchmark
    ), w AS (
        SELECT side, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM d
    ), n AS (
        SELECT side, r, word, count(*) AS n FROM w GROUP BY side, r, word
    ), v AS (
        SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM n)
    ), f AS (
        SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(h) // 2), lambda i: CAST(16 * (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1 AS BIGINT))),
            lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 10000 AS bucket FROM v
    ), b AS (
        SELECT side, r, bucket, sum(n) AS n FROM n JOIN f USING (word) GROUP BY side, r, bucket
    ), c AS (
        SELECT bucket, CAST(sum(n) FILTER (WHERE side = 0) AS BIGINT) AS s, CAST(coalesce(sum(n) FILTER (WHERE side = 1), 0) AS BIGINT) AS t FROM b GROUP BY bucket
    ), g AS (
        SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * ((SELECT sum(s) FROM c) + 10000) AS DOUBLE) / CAST((s + 1) * ((SELECT sum(t) FROM c) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM (SELECT bucket, coalesce(s, 0) AS s, t FROM c)
    ), x AS (
        SELECT r, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS weight FROM b JOIN g USING (bucket) WHERE side = 0 GROUP BY r
    ), z AS (
        SELECT id AS doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, sha256('2024:' || coalesce(CAST(id AS VARCHAR), '')) AS h FROM d LEFT JOIN x USING (r) WHERE side = 0
    ), q AS (
        SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(h, 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM z
    ), k AS (
        SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS rank, count(*) OVER (PARTITION BY n_features >= 20) AS able FROM q
    )
    SELECT doc_id, n_features, weight, score, CAST(CASE WHEN n_features >= 20 AND rank <= able * 10 // 100 THEN rank END AS BIGINT) AS rank FROM k
"""
