"""Identifiers, digests and operation keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from concord.functions.text import BLANK

# Offset basis and prime of 64-bit FNV-1a.
FNV_BASIS, FNV_PRIME = 14695981039346656037, 1099511628211


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def _part(c: Column) -> Column:
    return F.coalesce(F.lower(stripped(c)), F.lit(""))


def whole_seconds(ms: Column) -> Column:
    """Milliseconds to seconds, half up; null stays null."""
    return F.floor((ms + 500) / 1000).cast("long")


def record_id(title: Column, artist: Column, album: Column, seconds: Column, code: Column) -> Column:
    """``isrc:`` and the code where there is one, else 32 hex digits of SHA-256 over the description."""
    own = F.upper(stripped(code))
    text = F.concat_ws("|", _part(artist), _part(title), _part(album), F.coalesce(seconds, F.lit(0)).cast("string"))
    return F.when(F.length(own) > 0, F.concat(F.lit("isrc:"), own)).otherwise(F.substring(F.sha2(text, 256), 1, 32))


def list_id(owner: Column, name: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", _part(owner), _part(name)), 256), 1, 32)


def members_digest(ids: Column) -> Column:
    """FNV-1a (64 bits, lower-case hex) over the ids joined by U+001F; order matters."""
    # one character for each byte; steps are in longs that hold 32 bits and a factor, as a product of 64 bits overflows
    bytes_ = F.transform(F.filter(F.split(F.decode(F.concat_ws("\x1f", ids).cast("binary"), "ISO-8859-1"), ""), lambda c: c != ""), F.ascii)
    low, small = F.lit(0xFFFFFFFF), F.lit(FNV_PRIME - (1 << 40))

    def step(h: Column, b: Column) -> Column:
        x = h.bitwiseAND(low).bitwiseXOR(b.cast("long"))
        high = F.shiftrightunsigned(h, 32) * small + F.shiftrightunsigned(x * small, 32) + F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.shiftleft(high, 32).bitwiseOR((x * small).bitwiseAND(low))

    return F.lower(F.hex(F.aggregate(bytes_, F.lit(FNV_BASIS - (1 << 64)).cast("long"), step)))


def op_key(kind: Column, entity: Column, digest: Column | None = None) -> Column:
    """``kind:entity`` or ``kind:entity:digest``."""
    return F.concat_ws(":", kind, entity) if digest is None else F.concat_ws(":", kind, entity, digest)


def parse_op_key(key: Column) -> Column:
    """``kind, entity, digest`` of a key with a digest; the entity may hold colons. Null for other keys."""
    pattern = "^([^:]+):(.*):([^:]*)$"
    part = lambda i: F.regexp_extract(key, pattern, i)
    return F.when(key.rlike(pattern), F.struct(part(1).alias("kind"), part(2).alias("entity"), part(3).alias("digest")))
