"""Text clean-up: control characters, entities, HTML, white space, inline images, mojibake."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.jstext import DOT, WS, B, let, literal, remap, sub, trim, where_held

IMAGE = r"""(?i)<img\b[^>]*\bsrc\s*=\s*(["'])data:image/[^"']+;base64,[^"']+\1[^>]*>""".replace(r"\b", B).replace(r"\s", f"[{WS}]")
IMAGE_PLACEHOLDER = "[Image — contenu non extrait]"
#: Named entities in the order they are decoded.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
#: Characters that Windows-1252 has at 0x80-0x9F, and their bytes.
CP1252 = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
#: What mis-decoded text looks like.
_BROKEN_EMOJI = r"\u00f0[\u0080-\u00ff]{1,3}"
_AFTER_A = r"[\u0080-\u00ff\u20ac\u201a-\u201e\u2020-\u2022\u2013-\u201d\u2122\u0160\u0152\u017d\u0161\u0153\u017e\u0178]"
LEADS = ("\u00c2", "\u00c3", "\u00e2", "\u00f0", "\ufffd")  # what all of it starts with
_LEADS = f"[{''.join(LEADS)}]"
MOJIBAKE = rf"(?={_LEADS})(?:\u00c3{DOT}|\u00c2{DOT}|\u00e2{_AFTER_A}|{_BROKEN_EMOJI}|\ufffd)"


def _listed(*codes: int) -> str:
    """A class of characters below 256, each named: Java looks them up in a table, where ranges are tested in turn."""
    return f"[{''.join(f'\\x{x:02x}' for x in codes)}]"


CONTROL, C1 = _listed(*range(0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F), _listed(*range(0x80, 0xA0))


def strip_control(c: Column) -> Column:
    return sub(c, CONTROL)


def _char(code: Column, text: Column) -> Column:
    """The character of a code point; the text itself for what is none."""
    ok = (code >= 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(text)


def decode_entities(c: Column) -> Column:
    return where_held(c, ("&",), decoded)


def decoded(c: Column) -> Column:
    """As :func:`decode_entities`, without the search for what it changes: a smaller plan, for short texts."""
    for name, to in ENTITIES:
        c = sub(c, "(?i)" + name, literal(to))
    c = remap(c, r"&#[0-9]+;", lambda m: _char(F.regexp_extract(m, "[0-9]+", 0).try_cast("bigint"), m))
    return remap(c, r"(?i)&#x[0-9a-f]+;", lambda m: _char(F.conv(F.regexp_extract(m, "(?i)x([0-9a-f]+)", 1), 16, 10).try_cast("bigint"), m))


def strip_html(c: Column) -> Column:
    def stripped(c: Column) -> Column:
        c = sub(c, rf"(?i)<script{B}[^>]*>[\s\S]*?</script>", " ")
        c = sub(c, rf"(?i)<style{B}[^>]*>[\s\S]*?</style>", " ")
        c = sub(c, rf"(?i)<br[{WS}]*/?>", "\n")
        c = sub(c, r"(?i)</(p|div|section|article|li|tr|h[1-6])>", "\n")
        return sub(c, r"<[^>]+>", " ")

    return decode_entities(where_held(c, ("<",), stripped))


def normalize_whitespace(c: Column) -> Column:
    """Line ends to \\n, no-break spaces to blanks, runs of blanks and tabs to one blank, none around line ends, two line ends at most, trimmed.

    Each pattern is looked for only in texts that hold what it changes.
    """
    c = F.replace(where_held(c, ("\r",), lambda x: sub(x, r"\r\n?", "\n")), F.lit("\u00a0"), F.lit(" "))
    c = where_held(c, ("\t", "  "), lambda x: sub(x, r"(?:\t| [ \t])[ \t]*", " "))
    c = where_held(c, (" \n", "\n "), lambda x: sub(x, r"[ \t]+\n[ \t]*|\n[ \t]+", "\n"))
    return trim(where_held(c, ("\n\n\n",), lambda x: sub(x, r"\n{3,}", "\n\n")))


def clean(c: Column, html: bool = False, control: bool = False, whitespace: bool = True) -> Column:
    c = strip_html(c) if html else c
    c = strip_control(c) if control else c
    return normalize_whitespace(c) if whitespace else c


def remove_inline_images(c: Column) -> tuple[Column, Column]:
    """Text with placeholders, and how many."""
    return sub(c, IMAGE, literal(IMAGE_PLACEHOLDER)), F.regexp_count(c, F.lit(IMAGE))


def mojibake_score(c: Column) -> Column:
    return F.regexp_count(c, F.lit(MOJIBAKE)) + 5 * F.regexp_count(c, F.lit(r"\ufffd")) + 2 * F.regexp_count(c, F.lit(_BROKEN_EMOJI))


def _redecode(c: Column) -> Column:
    """The text's Windows-1252 bytes read as UTF-8; other characters count by the low byte of their first UTF-16 unit."""
    src = "".join(CP1252.values())
    low = lambda c: F.when(F.regexp_like(c, F.lit(f"[{src}]")), F.translate(c, src, "".join(chr(b) for b in CP1252))).otherwise(c)
    # of each UTF-16 unit its low byte; low surrogates go
    units = lambda c: F.unhex(sub(F.hex(F.encode(c, "UTF-16BE")), r"D[89AB](..)....|..(..)", "$1$2"))
    data = let(low(c), lambda x: F.when(F.regexp_like(x, F.lit(r"[^\u0000-\u00ff]")), units(x)).otherwise(F.encode(x, "ISO-8859-1")))
    return sub(F.make_valid_utf8(data.cast("string")), r"\A\ufeff")


def _round(state: Column) -> Column:
    """One round over (text, fixes, going)."""
    now = state["text"]
    held = reduce(or_, (F.contains(now, F.lit(x)) for x in LEADS))  # costs less than the pattern, which few texts come to
    other = F.when(state["going"] & held & F.regexp_like(now, F.lit(MOJIBAKE)), sub(_redecode(now), r"\u00c2"))

    def judged(p: Column) -> Column:
        taken = p["other"].isNotNull() & (p["other"] != now) & (p["after"] <= p["before"])
        fixes = state["fixes"] + F.when(taken, F.greatest(F.lit(1), p["before"] - p["after"])).otherwise(0)
        return F.struct(F.when(taken, p["other"]).otherwise(now).alias("text"), fixes.alias("fixes"), F.coalesce(taken, F.lit(False)).alias("going"))

    scored = let(other, lambda o: F.struct(o.alias("other"), F.when(o.isNotNull(), mojibake_score(now)).alias("before"), mojibake_score(o).alias("after")))
    return let(scored, judged)


def repaired(c: Column) -> Column:
    """Struct of repaired text and n, the number of corrections; up to three rounds, each taken whole or not at all."""
    state = F.struct(c.alias("text"), F.lit(0).alias("fixes"), F.lit(True).alias("going"))
    for _ in range(3):
        state = let(state, _round)

    def last(s: Column) -> Column:
        rest = sub(s["text"], C1)
        return let(rest, lambda r: F.struct(r.alias("text"), F.when(r == c, F.lit(0)).otherwise(s["fixes"] + F.length(s["text"]) - F.length(r)).alias("n")))

    return let(state, last)


def fix_encoding(c: Column) -> tuple[Column, Column]:
    """Repaired text and the number of corrections."""
    out = repaired(c)
    return out["text"], out["n"]
