"""HTML to Markdown, Markdown to plain text, and what tells menu pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.jstext import PICTOGRAPHS, WS, B, let, remap, sub, trim, units, where_held
from docmill.functions.text import decode_entities, decoded, normalize_whitespace

_S = f"[{WS}]"
#: What a link, and a link to another article, looks like.
_LINK = r"\[[^\]]+\]\([^)]+\)"
_MENU_LINK = r"\[[^\]]+\]\(/knowledge/article/[^)]+\)"
_ANY = r"[\s\S]*?"


def strip_tags(c: Column) -> Column:
    return sub(c, r"<[^>]+>", " ")


def inline(c: Column) -> Column:
    return trim(sub(sub(decoded(strip_tags(c)), r"\u00a0", " "), r"[ \t]+", " "))


def _inner(m: Column, tag: str) -> Column:
    return F.regexp_extract(m, rf"(?i)\A<{tag}{B}[^>]*>({_ANY})</{tag}>\z", 1)


def _each(c: Column, tag: str, fn) -> Column:
    """fn over the inside of each element ``tag``."""
    return remap(c, rf"(?i)<{tag}{B}[^>]*>{_ANY}</{tag}>", lambda m: fn(_inner(m, tag)))


def _link(m: Column) -> Column:
    label = trim(sub(sub(inline(F.regexp_extract(m, rf"(?i)\A<a{B}[^>]*>({_ANY})</a>\z", 1)), f"[{PICTOGRAPHS}]"), rf"\A[{WS}\-\u2013\u2014\u2022\u00b7|>]+"))
    href = F.regexp_extract(F.regexp_extract(m, rf"(?i)\A<a{B}([^>]*)>", 1), rf"""(?i)href{_S}*={_S}*["']([^"']+)["']""", 1)
    return F.when(label == "", F.lit("")).when(href != "", F.concat(F.lit("["), label, F.lit("]("), href, F.lit(")"))).otherwise(label)


def html_steps() -> list:
    """The steps in their order; each takes and gives a column. Those on tags are for texts with one."""
    fence = lambda x: F.when(x == "", F.lit("\n\n")).otherwise(F.concat(F.lit("\n\n```\n"), x, F.lit("\n```\n\n")))
    quoted = lambda mark: lambda x: F.concat(F.lit(mark), inline(x), F.lit(mark))
    steps = [
        lambda c: sub(sub(sub(c, rf"<!--{_ANY}-->", " "), rf"(?i)<script{B}[^>]*>{_ANY}</script>", " "), rf"(?i)<style{B}[^>]*>{_ANY}</style>", " "),
        lambda c: _each(c, "pre", lambda x: fence(trim(decoded(strip_tags(x))))),
        lambda c: _each(c, "code", lambda x: let(inline(x), lambda t: F.when(t == "", F.lit("")).otherwise(F.concat(F.lit("`"), t, F.lit("`"))))),
    ]
    for n in (1, 2, 3):
        steps.append(lambda c, n=n: _each(c, f"h{n}", lambda x: F.concat(F.lit("\n\n" + "#" * n + " "), inline(x), F.lit("\n\n"))))
    steps.append(lambda c: remap(c, rf"(?i)<a{B}[^>]*>{_ANY}</a>", _link))
    # of two tags of one meaning, the one that opens first pairs with its own end
    for one, two, mark in (("strong", "b", "**"), ("em", "i", "_")):
        steps.append(lambda c, a=one, b=two, mark=mark: remap(c, rf"(?i)<(?:{a}{B}[^>]*>{_ANY}</{a}>|{b}{B}[^>]*>{_ANY}</{b}>)", lambda m: quoted(mark)(F.regexp_extract(m, rf"(?i)\A<[a-z]+{B}[^>]*>({_ANY})</[a-z]+>\z", 1))))
    steps += [
        lambda c: _each(c, "li", lambda x: F.concat(F.lit("\n- "), inline(x))),
        lambda c: sub(sub(c, rf"(?i)</?(ul|ol){B}[^>]*>", "\n"), rf"(?i)<br{_S}*/?>", "\n"),
        lambda c: sub(sub(c, r"(?i)</(p|div|section|article|tr)>", "\n\n"), rf"(?i)<(p|div|section|article|span|table|tbody|thead|tr|td|th){B}[^>]*>"),
    ]

    def with_tags(step):
        # names its column more than once, so the optimizer leaves each step a projection of its own
        return lambda c: F.when(F.contains(c, F.lit("<")), step(c)).otherwise(c)

    return [*map(with_tags, steps), lambda c: decode_entities(strip_tags(c)), _lines_joined]


def _lines_joined(c: Column) -> Column:
    c = where_held(c, (" \n", "\t\n"), lambda x: sub(x, r"[ \t]+\n", "\n"))
    c = where_held(c, ("\n ", "\n\t"), lambda x: sub(x, r"\n[ \t]+", "\n"))
    c = where_held(c, ("\n-",), lambda x: sub(x, rf"\n-{_S}+", "\n- "))
    return normalize_whitespace(where_held(c, ("\n\n\n",), lambda x: sub(x, r"\n{3,}", "\n\n")))


def html_to_markdown(df, col: str, out: str = "markdown"):
    """``df`` with ``out``: one projection a step, so that no step is written out twice in the plan."""
    df = df.withColumn(out, F.col(col))
    for step in html_steps():
        df = df.withColumn(out, step(F.col(out)))
    return df


def plain_text(c: Column) -> Column:
    c = where_held(c, ("`",), lambda x: sub(sub(x, rf"```{_ANY}```", " "), r"`([^`]+)`", "$1"))
    c = where_held(c, ("](",), lambda x: sub(x, r"\[([^\]]+)\]\([^)]+\)", "$1"))
    return normalize_whitespace(sub(c, r"[*_#>`-]+", " "))


def link_line(line: Column) -> Column:
    """A line that is links in the main."""
    held = F.contains(line, F.lit("]("))  # a search that costs little; most lines end here
    c = sub(trim(line), rf"\A[-*+]{_S}+")
    rest = sub(sub(c, _LINK), rf"[,{WS}|:;.\-]")
    size = units(F.array_join(F.regexp_extract_all(c, F.lit(_LINK), F.lit(0)), ""))
    return held & (c != "") & (size > 0) & ((rest == "") | (size / F.greatest(F.lit(1), units(c)) >= 0.7))


def without_links(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("](")), sub(c, _LINK, " ")).otherwise(c)


def narrative_paragraphs(md: Column) -> Column:
    def keeps(p):
        lines = F.filter(F.split(p, "\n", -1), lambda x: trim(x) != "")
        image = F.contains(p, F.lit("[Image")) & F.contains(p, F.lit("contenu non extrait]"))
        links = F.contains(p, F.lit("](")) & (F.size(lines) > 0) & F.forall(lines, link_line)
        # so many visible characters are enough, whatever the blanks between them
        long = F.regexp_like(without_links(p), F.lit(rf"(?:[^{WS}][{WS}]*){{40}}")) | (units(normalize_whitespace(without_links(p))) >= 40)
        return (p != "") & ~F.regexp_like(p, F.lit(rf"\A#{{1,3}}{_S}+")) & ~image & ~links & long

    return F.size(F.filter(F.transform(F.split(md, r"\n{2,}", -1), trim), keeps))


def menu_metrics(md: Column) -> Column:
    """Struct of links, lines, link lines and their share, narrative paragraphs, text outside links, and the verdict."""
    return let(md, _menu_metrics)


def _menu_metrics(md: Column) -> Column:
    linked = F.contains(md, F.lit("]("))
    lines = F.filter(F.transform(F.split(md, "\n", -1), trim), lambda x: x != "")
    # a text without links has no line of them
    counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.when(linked, F.size(F.filter(x, link_line))).otherwise(0).alias("only")))
    links = F.when(linked, F.regexp_count(md, F.lit(r"\]\(/knowledge/article/[^)]+\)"))).otherwise(F.when(md.isNotNull(), F.lit(0)))
    out = F.when(linked, without_links(sub(md, _MENU_LINK, " "))).otherwise(md)
    out = where_held(out, ("#",), lambda x: sub(x, rf"(?md)^#{{1,3}}{_S}+.*$", " "))
    out = where_held(out, ("[Image",), lambda x: sub(x, r"\[Image[^\]]*contenu non extrait\]", " "))
    ratio = lambda c: F.when(c["n"] > 0, c["only"] / c["n"]).otherwise(F.lit(0.0))
    found = F.struct(links.alias("links"), counts.alias("c"), units(normalize_whitespace(out)).alias("outside"), narrative_paragraphs(md).alias("told"))

    def judged(x: Column) -> Column:
        return let(F.struct(x["links"].alias("links"), x["c"]["n"].alias("n"), x["c"]["only"].alias("only"), ratio(x["c"]).alias("ratio"), x["outside"].alias("outside"), x["told"].alias("told")), named)

    def named(x: Column) -> Column:
        menu = ((x["links"] >= 5) & (x["outside"] < 300)) | ((x["ratio"] >= 0.7) & (x["told"] < 3))
        return F.struct(x["links"].alias("n_links"), x["n"].alias("n_lines"), x["only"].alias("n_link_lines"), x["ratio"].alias("link_ratio"), x["told"].alias("n_narrative"), x["outside"].alias("n_outside"), menu.alias("is_menu"))

    return let(found, judged)
