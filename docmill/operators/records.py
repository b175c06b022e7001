"""Records: exclusion, renaming, cleaning, redaction by name, empty fields, and documents of metadata and content."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.jstext import trim, units
from docmill.functions.redact import redact, redact_by_key
from docmill.functions.text import clean, fix_encoding, remove_inline_images

SHORT = 80


def is_empty(c: Column) -> Column:
    return c.isNull() | (trim(c.cast("string")) == "")


def clean_value(c: Column, html: bool = False) -> Column:
    """The chain for a text: encoding, inline images, clean-up, redaction."""
    return redact(clean(remove_inline_images(fix_encoding(c)[0])[0], html=html, control=True))[0]


def transform_record(df: DataFrame, exclude: Iterable[str] = (), renames: Mapping[str, str] | None = None, html: bool = False) -> DataFrame:
    """Fields in order: excluded ones go by source name, text ones are cleaned and redacted by name, then renamed.

    A later field takes the place of an earlier one of the same new name. Blank texts become null.
    """
    out: dict[str, Column] = {}
    for f in df.schema.fields:
        if f.name in set(exclude):
            continue
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() == "string":
            c = redact_by_key(clean_value(c, html), f.name)[0]
            c = F.when(is_empty(c), F.lit(None)).otherwise(c)
        out[(renames or {}).get(f.name) or f.name] = c
    return df.select(*[c.alias(n) for n, c in out.items()])


def js_text(c: Column, kind: str) -> Column:
    """A scalar as text: whole doubles without decimals."""
    if kind in ("double", "float"):
        return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
    return c.cast("string") if kind in ("string", "boolean") or "int" in kind or "decimal" in kind else F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)


HEAD = ("source_file", "source_type", "tool", "row")


def json_value(c: Column) -> Column:
    """A column as JSON text; null is ``null``."""
    whole = F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"})
    return whole.substr(F.lit(6), F.length(whole) - 6)


def json_object(pairs: list[tuple[str, Column]]) -> Column:
    """A JSON object of keys and JSON texts, in order; a key whose text is null is left out."""
    held = [F.when(v.isNotNull(), F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), v)) for k, v in pairs]
    return F.concat(F.lit("{"), F.concat_ws(",", *held), F.lit("}"))


def to_document(df: DataFrame, position: str, source_file: str, source_type: str, tool: str) -> DataFrame:
    """metadata (struct), content ("key: value" lines) and value (the document as JSON) of each record.

    Numbers, booleans, nulls and texts of at most 80 units are metadata. Longer texts and nested values are not: they
    are absent from ``value`` and null in the struct, which has one shape for all rows. A field named like one of HEAD takes
    its place.
    """
    fields = [f for f in df.schema.fields if f.name != position]
    kinds = {f.name: f.dataType.simpleString() for f in fields}
    lines = [F.when(~is_empty(F.col(n)), F.concat(F.lit(f"{n}: "), js_text(F.col(n), k))) for n, k in kinds.items()]
    scalar = [n for n, k in kinds.items() if not k.startswith(("array", "struct", "map", "variant"))]
    short = {n: F.coalesce(units(F.col(n)) <= SHORT, F.lit(True)) if kinds[n] == "string" else F.lit(True) for n in scalar}
    told = dict(zip(HEAD, (F.lit(source_file), F.lit(source_type), F.lit(tool), F.col(position)), strict=True))
    meta = {n: F.when(short[n], F.col(n)) for n in scalar}
    every = told | meta  # a later value of one name takes the earlier one's place
    number = lambda n: F.when(F.col(n).isNull(), F.lit("null")).otherwise(js_text(F.col(n), kinds[n]))
    text = {n: json_value(c) for n, c in told.items()} | {n: F.when(short[n], json_value(F.col(n)) if kinds[n] in ("string", "date", "timestamp") else number(n)) for n in scalar}
    content = F.concat_ws("\n", *lines)
    value = json_object([("metadata", json_object([(n, text[n]) for n in every])), ("content", json_value(content))])
    return df.select(position, F.struct(*[c.alias(n) for n, c in every.items()]).alias("metadata"), content.alias("content"), value.alias("value"))


def to_jsonl(docs: DataFrame) -> DataFrame:
    """A document a line."""
    return docs.select("value")
