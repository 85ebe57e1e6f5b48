"""Keys of names: lower-case ASCII words without marks, punctuation and version words."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# Phrases that are cut out of titles and albums wherever they occur, in this order.
VERSION_PHRASES = ("radio edit", "explicit version", "explicit", "clean version", "clean", "album version", "single version", "acoustic version", "acoustic", "live version", "live", "remix", "remaster", "remastered", "instrumental")
EDITION_PHRASES = ("deluxe edition", "deluxe", "expanded edition", "remastered", "remaster", "anniversary edition", "special edition", "limited edition", "bonus track edition", "explicit version", "clean version")
# Words after which a title or an artist is cut, unless they come first.
TITLE_MARKERS = ("feat", "ft", "featuring", "with")
ARTIST_MARKERS = ("feat", "ft", "featuring", "with", "vs", "x")

BLANK = r"[\t\n\x0B\f\r\p{Z}]"


def _marks() -> tuple[str, str]:
    """Letters that decompose into an ASCII letter and marks, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for a, b in ((0xC0, 0x250), (0x1E00, 0x1F00)) for c in range(a, b)]
    pairs = [(x, y) for x, y in pairs if x != y and y.isascii()]
    return "".join(x for x, _ in pairs), "".join(y for _, y in pairs)


MARKED, PLAIN = _marks()


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def base_key(c: Column) -> Column:
    """Lower case, marks off, everything but ASCII letters, digits and blanks deleted, blanks collapsed."""
    plain = F.regexp_replace(F.translate(F.lower(c), MARKED, PLAIN), r"\p{M}+", "")
    return collapse(F.regexp_replace(plain, r"[^a-z0-9\t\n\x0B\f\r\p{Z}]", ""))


def cut_at(c: Column, markers: tuple[str, ...]) -> Column:
    """The words before the first marker that is not the first word."""
    return F.regexp_replace(c, f"^( *[^ ]+.*?) +(?:{'|'.join(markers)})(?: .*)?$", "$1")


def without(c: Column, phrases: tuple[str, ...]) -> Column:
    for p in phrases:
        c = F.replace(c, F.lit(p), F.lit(""))
    return c


def title_key(c: Column) -> Column:
    return collapse(cut_at(without(base_key(c), VERSION_PHRASES), TITLE_MARKERS))


def artist_key(c: Column, primary: bool = True) -> Column:
    key = base_key(c)
    return collapse(F.replace(cut_at(key, ARTIST_MARKERS) if primary else key, F.lit(" and "), F.lit(" ")))


def album_key(c: Column) -> Column:
    return collapse(F.regexp_replace(without(base_key(c), EDITION_PHRASES), r"\b\d{4}\b", ""))


def search_text(title: Column, artist: Column) -> Column:
    """What to look a record up by: the title without bracketed parts, and the artist."""
    return F.trim(F.concat_ws(" ", F.trim(F.regexp_replace(title, r"\s*(\([^)]*\)|\[[^\]]*\])", "")), artist))
