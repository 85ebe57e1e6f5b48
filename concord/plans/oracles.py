"""Pieces of DuckDB SQL that express the same computations, for comparison."""

from __future__ import annotations

# Fixed values, stated here once more so that the comparison does not take them from what it checks.
VERSION_PHRASES = ("radio edit", "explicit version", "explicit", "clean version", "clean", "album version", "single version", "acoustic version", "acoustic", "live version", "live", "remix", "remaster", "remastered", "instrumental")
EDITION_PHRASES = ("deluxe edition", "deluxe", "expanded edition", "remastered", "remaster", "anniversary edition", "special edition", "limited edition", "bonus track edition", "explicit version", "clean version")
TITLE_MARKERS = ("feat", "ft", "featuring", "with")
ARTIST_MARKERS = ("feat", "ft", "featuring", "with", "vs", "x")


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def base(x: str) -> str:
    return collapse(rf"regexp_replace(strip_accents(lower({x})), '[^a-z0-9\s]', '', 'g')")


def cut(x: str, markers: tuple[str, ...]) -> str:
    return rf"regexp_replace({x}, '^( *[^ ]+.*?) +(?:{'|'.join(markers)})(?: .*)?$', '\1')"


def without(x: str, phrases: tuple[str, ...]) -> str:
    for p in phrases:
        x = f"replace({x}, '{p}', '')"
    return x


def title(x: str) -> str:
    return collapse(cut(without(base(x), VERSION_PHRASES), TITLE_MARKERS))


def artist(x: str) -> str:
    return collapse(f"replace({cut(base(x), ARTIST_MARKERS)}, ' and ', ' ')")


def album(x: str) -> str:
    return collapse(rf"regexp_replace({without(base(x), EDITION_PHRASES)}, '\b\d{{4}}\b', '', 'g')")


def sim(a: str, b: str) -> str:
    n, m = f"CAST(length({a}) AS DOUBLE)", f"CAST(length({b}) AS DOUBLE)"
    return f"(CASE WHEN {a} = {b} THEN CAST(1 AS DOUBLE) WHEN {n} = 0 OR {m} = 0 THEN CAST(0 AS DOUBLE) WHEN contains({a}, {b}) OR contains({b}, {a}) THEN least({n}, {m}) / greatest({n}, {m}) ELSE CAST(1 AS DOUBLE) - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest({n}, {m}) END)"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def duration(a: str, b: str) -> str:
    d = f"abs({a} - {b})"
    return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN {dbl('0.5')} WHEN {d} = 0 THEN {dbl('1')} WHEN {d} <= 5 THEN {dbl('1')} - {dbl(d)} / {dbl('5')} ELSE {dbl('0')} END)"


def digest(ids: str) -> str:
    """FNV-1a of a list of ASCII ids."""
    codes = f"list_transform(string_split(array_to_string({ids}, chr(31)), ''), lambda c: CAST(ord(c) AS UHUGEINT))"
    fold = f"list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), {codes}), lambda h, b: (CAST(xor(CAST(h AS UBIGINT), CAST(b AS UBIGINT)) AS UHUGEINT) * 1099511628211) % 18446744073709551616)"
    return f"CASE WHEN len({ids}) = 0 THEN 'cbf29ce484222325' ELSE lower(to_hex(CAST({fold} AS UBIGINT))) END"


PARTS = f"""parts AS (
    SELECT p_partkey AS ord, 'p' || p_partkey AS id, {title('p_brand')} AS tk, {artist('p_name')} AS ak, {album('p_type')} AS bk,
           CAST(p_size AS BIGINT) AS secs, p_brand, p_name,
           CASE WHEN p_partkey % 3 = 0 THEN 'US' || lpad(CAST((p_partkey // 2) % 700 AS VARCHAR), 10, '0') END AS code
    FROM part
), src AS (SELECT * FROM parts WHERE ord % 2 = 1), tgt AS (SELECT * FROM parts WHERE ord % 2 = 0)"""


def pairs(common: int = 500, sources: str = "src") -> str:
    """CTEs down to ``ranked``: the ranked candidate pairs of the sources."""
    return f"""tw AS (SELECT DISTINCT ord, unnest(string_split(ak, ' ')) AS word FROM tgt),
    df AS (SELECT word, CAST(count(*) AS BIGINT) AS df FROM tw WHERE word <> '' GROUP BY word),
    sw AS (SELECT DISTINCT ord, unnest(string_split(ak, ' ')) AS word FROM {sources}),
    rare AS (SELECT * FROM (SELECT sw.ord, word, df, row_number() OVER (PARTITION BY sw.ord ORDER BY df, word) AS rn FROM sw JOIN df USING (word)) WHERE rn = 1 OR df <= {common}),
    pairs AS (SELECT DISTINCT rare.ord AS s, tw.ord AS t FROM rare JOIN tw USING (word)),
    pre AS (SELECT s, t, {sim('a.tk', 'b.tk')} * {dbl('0.6')} + {sim('a.ak', 'b.ak')} * {dbl('0.4')} AS pre,
            {sim('a.tk', 'b.tk')} AS ts, {sim('a.ak', 'b.ak')} AS ars, {sim('a.bk', 'b.bk')} AS als, {duration('a.secs', 'b.secs')} AS ds
            FROM pairs JOIN parts a ON a.ord = s JOIN parts b ON b.ord = t),
    ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY pre DESC, t) AS pr FROM pre) WHERE pr <= 50),
    fuzzy AS (SELECT s, t, pr, pre, ts, ars, als, ds, ts * {dbl('0.4')} + ars * {dbl('0.35')} + als * {dbl('0.15')} + ds * {dbl('0.1')} AS score, 'fuzzy' AS method FROM ranked)"""


CODE_PAIRS = f"""firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ord) AS n FROM tgt WHERE code IS NOT NULL) WHERE n = 1),
    hits AS (SELECT src.ord AS s, firsts.ord AS t, 1 AS pr, CAST(NULL AS DOUBLE) AS pre, {dbl('1')} AS ts, {dbl('1')} AS ars, {dbl('1')} AS als, {duration('src.secs', 'firsts.secs')} AS ds, {dbl('0.95')} AS score, 'isrc' AS method FROM src JOIN firsts ON src.code = firsts.code),
    rest AS (SELECT * FROM src WHERE ord NOT IN (SELECT s FROM hits))"""


def decisions(scores: str, sources: str, low: str = "0.65") -> str:
    """CTE ``decided`` from scored pairs."""
    return f"""best AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, pr) AS rk FROM {scores}),
    shown AS (SELECT s, CAST(least(5, count(*)) AS BIGINT) AS n, min(rk) AS first FROM best WHERE score >= {dbl(low)} AND score < {dbl('0.85')} GROUP BY s),
    decided AS (
        SELECT x.ord, x.id AS source_id,
               CASE WHEN b.score >= {dbl('0.85')} THEN 'auto' WHEN shown.n > 0 THEN 'ambiguous' ELSE 'no_match' END AS decision,
               CASE WHEN b.score >= {dbl('0.85')} OR shown.n > 0 THEN b.method END AS method,
               CASE WHEN b.score >= {dbl('0.85')} OR shown.n > 0 THEN 'p' || b.t END AS candidate_id,
               CASE WHEN b.score >= {dbl('0.85')} OR shown.n > 0 THEN b.score END AS score,
               CAST(CASE WHEN b.score >= {dbl('0.85')} THEN 1 ELSE coalesce(shown.n, 0) END AS BIGINT) AS n_candidates
        FROM {sources} x LEFT JOIN best b ON b.s = x.ord AND b.rk = 1 LEFT JOIN shown ON shown.s = x.ord)"""
