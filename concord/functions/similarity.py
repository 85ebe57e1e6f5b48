"""Similarities and scores as column expressions, evaluated inside Spark's generated code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Policy:
    """Weights and limits of matching. Two limits are options that default to off."""

    title: float = 0.40
    artist: float = 0.35
    album: float = 0.15
    duration: float = 0.10
    tolerance: int = 5
    auto: float = 0.85
    ambiguous: float = 0.65
    code_score: float = 0.95
    common_word: int = 500
    candidates: int = 50
    shown: int = 5
    margin: float = 0.0  # lead over the second candidate that an automatic match needs


def similarity(a: Column, b: Column) -> Column:
    """1 for equal strings, 0 if one is empty, length ratio if one holds the other, else 1 - edits / longer length."""
    a, b = F.lower(a), F.lower(b)
    la, lb = F.length(a).cast("double"), F.length(b).cast("double")
    inside = F.contains(a, b) | F.contains(b, a)
    return (
        F.when(a == b, F.lit(1.0)).when((la == 0) | (lb == 0), F.lit(0.0))
        .when(inside, F.least(la, lb) / F.greatest(la, lb))
        .otherwise(F.lit(1.0) - F.levenshtein(a, b).cast("double") / F.greatest(la, lb))
    )


def similarity_sql(a: str, b: str) -> str:
    """``similarity`` of two names in SQL text, for use inside larger expressions; the names are of lower-case keys."""
    inside = f"contains({a}, {b}) OR contains({b}, {a})"
    longer = f"greatest(length({a}), length({b}))"
    return (
        f"CASE WHEN {a} = {b} THEN 1D WHEN length({a}) = 0 OR length({b}) = 0 THEN 0D "
        f"WHEN {inside} THEN CAST(least(length({a}), length({b})) AS DOUBLE) / {longer} "
        f"ELSE 1D - CAST(levenshtein({a}, {b}) AS DOUBLE) / {longer} END"
    )


def parts_sql(title: str, artist: str, s: str, t: str, p: Policy) -> dict[str, str]:
    """SQL of a pair's component scores, from its similarities and the prefixes of both sides' columns; all but the last are 1 for equal codes."""
    code = f"coalesce({s}code_key = {t}code_key, false)"
    album = f"CASE WHEN {s}album_key IS NULL OR {t}album_key IS NULL THEN 0.5D ELSE {similarity_sql(f'{s}album_key', f'{t}album_key')} END"
    apart = f"abs({s}seconds - {t}seconds)"
    near = f"1D - CAST({apart} AS DOUBLE) / {float(p.tolerance or 1)}D"
    return {
        "by_code": code,
        **{f"{name}_score": f"if({code}, 1D, {x})" for name, x in (("title", title), ("artist", artist), ("album", album))},
        "duration_score": f"CASE WHEN {apart} IS NULL THEN 0.5D WHEN {apart} = 0 THEN 1D WHEN {apart} <= {p.tolerance} THEN {near} ELSE 0D END",
    }


def score_sql(x: str, p: Policy) -> str:
    """SQL of a pair's score from its component scores; the order of the additions is fixed."""
    parts = " + ".join(f"{x}{name}_score * {getattr(p, name)}D" for name in ("title", "artist", "album", "duration"))
    return f"if({x}by_code, {p.code_score}D, {parts})"


def duration_score(a: Column, b: Column, tolerance: int = 5) -> Column:
    d = F.abs(a - b)
    near = F.lit(1.0) - d.cast("double") / F.lit(float(tolerance or 1))
    return F.when(a.isNull() | b.isNull(), F.lit(0.5)).when(d == 0, F.lit(1.0)).when(d <= tolerance, near).otherwise(F.lit(0.0))


def duration_difference(a: Column, b: Column) -> Column:
    """Seconds between two durations; null if one is not known."""
    return F.abs(a - b)


def within_tolerance(a: Column, b: Column, tolerance: int = 5, strict: bool = False) -> Column:
    return a.isNull() | b.isNull() | (F.abs(a - b) <= (tolerance // 2 if strict else tolerance))


def same_code(a: Column, b: Column) -> Column:
    return F.coalesce((F.length(a) > 0) & (F.length(b) > 0) & (F.lower(a) == F.lower(b)), F.lit(False))


def valid_code(c: Column) -> Column:
    """Twelve upper-case letters or digits once hyphens are off."""
    return F.coalesce(F.replace(c, F.lit("-"), F.lit("")).rlike(r"^[\p{Lu}\p{N}]{12}$"), F.lit(False))


def pre_score(title: Column, artist: Column) -> Column:
    """The score that ranks candidates, from the similarities of titles and of artists."""
    return title * 0.6 + artist * 0.4


def album_score(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit(0.5)).otherwise(similarity(a, b))


def fuzzy_score(title: Column, artist: Column, album: Column, duration: Column, p: Policy = Policy()) -> Column:
    """Weighted sum; the order of the additions is fixed."""
    return title * p.title + artist * p.artist + album * p.album + duration * p.duration


def multi_field_similarity(pairs: list[tuple[Column, Column, float]]) -> Column:
    """Sum of weight times similarity; a pair with a null adds nothing."""
    total = F.lit(0.0)
    for a, b, w in pairs:
        total = total + F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(similarity(a, b) * w)
    return total


def band(score: Column, p: Policy = Policy()) -> Column:
    return F.when(score >= p.auto, "auto").when(score >= p.ambiguous, "ambiguous").otherwise("no_match")
