"""String semantics of the tools' text rules (ECMAScript) as Spark expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the rules, as the inside of a Java character class.
WS = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: ASCII word boundary; Java's own is Unicode-aware.
B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: The same as characters.
WS_CHARS = "".join(map(chr, (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
DOT = r"[^\n\r\u2028\u2029]"
#: Common pictographs, as the inside of a class (Java 17 has no Extended_Pictographic).
PICTOGRAPHS = r"\u00a9\u00ae\u203c\u2049\u2122\u2139\u2194-\u21aa\u231a-\u23ff\u24c2\u25aa-\u25fe\u2600-\u27bf\u2934\u2935\u2b05-\u2b55\u3030\u303d\u3297\u3299\x{1F000}-\x{1FAFF}"


def sub(col: Column, pattern: str, to: str = "") -> Column:
    """Replace all; ``to`` may name groups ($1)."""
    return F.regexp_replace(col, F.lit(pattern), F.lit(to))


def literal(to: str) -> str:
    """A replacement without special characters."""
    return to.replace("\\", "\\\\").replace("$", "\\$")


def trim(col: Column) -> Column:
    return F.btrim(col, F.lit(WS_CHARS))


def units(col: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.length(F.encode(col, "UTF-16LE")) / 2).cast("int")


def remap(col: Column, pattern: str, fn: Callable[[Column], Column]) -> Column:
    """Replace each match by fn(match); texts without one pay a search only. ``col`` is worked out once, as it may be a chain of these."""

    def put(c: Column) -> Column:
        parts, found = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
        new = F.array_join(F.zip_with(parts, F.concat(F.transform(found, fn), F.array(F.lit(""))), lambda p, m: F.concat(p, m)), "")
        return F.when(F.regexp_like(c, F.lit(pattern)), new).otherwise(c)

    return let(col, put)


def let(c: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(c) with c worked out once, however often fn uses it."""
    return F.element_at(F.transform(F.array(c), fn), 1)


def where_held(col: Column, parts: tuple[str, ...], fn: Callable[[Column], Column]) -> Column:
    """fn(col) for texts that hold one of the parts, others as they are: for steps that change nothing without. A search for plain text costs a fraction of a pattern's."""

    def put(c: Column) -> Column:
        held = F.contains(c, F.lit(parts[0]))
        for p in parts[1:]:
            held = held | F.contains(c, F.lit(p))
        return F.when(held, fn(c)).otherwise(c)

    return let(col, put)


@cache
def _folds() -> tuple[str, str]:
    """Letters with marks and their bases, for one-to-one decompositions."""
    src, dst = [], []
    for cp in range(0xC0, 0x3000):
        d = [c for c in unicodedata.normalize("NFD", chr(cp)) if not 0x300 <= ord(c) <= 0x36F]
        if len(d) == 1 and d[0] != chr(cp):
            src.append(chr(cp))
            dst.append(d[0])
    return "".join(src), "".join(dst)


def search_text(col: Column) -> Column:
    """Without marks, with plain apostrophes, in lower case; null is empty."""
    src, dst = _folds()
    c = sub(F.coalesce(col, F.lit("")), r"[\u0300-\u036f]")
    return F.lower(F.translate(c, src + "’`", dst + "''"))


def contains_any(col: Column, terms: tuple[str, ...]) -> Column:
    """Whether a text holds any of the terms: one expression, however many they are."""
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(col, t))

