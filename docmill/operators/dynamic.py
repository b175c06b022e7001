"""Records of any shape: every text in nested JSON is cleaned and redacted, with counts, findings and paths.

The text rules are Catalyst expressions over the texts of a record; Python only takes a record apart and puts it together again.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.batches import slices
from docmill.functions import jsvalue
from docmill.functions.jstext import let
from docmill.functions.redact import KINDS, PLACEHOLDER, key_kind, matches, redacted
from docmill.functions.text import clean, remove_inline_images, repaired
from docmill.operators.diagnostics import tokens
from docmill.operators.records import SHORT

COUNTERS = {"secret": "n_secret", "certificate": "n_certificate", "ip": "n_ip", "internalPath": "n_path"}
FINDING = "struct<type:string,fieldPath:string,placeholder:string,preview:string>"
RESULT = "record string, n_fixes long, n_images long, n_secret long, n_certificate long, n_ip long, n_path long, n_empty long, n_blank_runs long, findings array<struct<type:string,fieldPath:string,placeholder:string,preview:string>>"
_BLANK = {c for r in (range(9, 14), (32, 0xA0, 0x1680), range(0x2000, 0x200B), (0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)) for c in map(chr, r)}


def texts(value, path: str, out: list[tuple[str, str]]) -> None:
    """The texts of a value with their paths (a.b[0]), in order."""
    out += [(p, holder[k]) for holder, k, p in jsvalue.places(value, path) if isinstance(holder[k], str)]


def rebuilt(value, new) -> object:
    """The value with its texts taken from the iterator ``new``, in order; lists and objects are changed where they are."""
    if isinstance(value, str):
        return next(new)
    for holder, k, _ in jsvalue.places(value, ""):
        if isinstance(holder[k], str):
            holder[k] = next(new)
    return value


def is_blank(value) -> bool:
    return value is None or (isinstance(value, str) and all(c in _BLANK for c in value))


def count_empty(value) -> int:
    """Nulls and blank texts in a value; an empty array or object counts nothing."""
    return sum(is_blank(holder[k]) for holder, k, _ in jsvalue.places(value, ""))


def blank_runs(text: str) -> int:
    """Runs of white space in a text: one less than its words, if it neither starts nor ends with one."""
    return len(_RUN.findall(text))


def clean_text(c: Column, fix_encoding: bool, images: bool, html: bool, control: bool, whitespace: bool, kinds: tuple[str, ...], reveal: bool) -> Column:
    """Struct of a text's clean form, counters and findings."""
    first = repaired(c) if fix_encoding else F.struct(c.alias("text"), F.lit(0).alias("n"))

    def run(r: Column) -> Column:
        image, n = remove_inline_images(r["text"])
        text = clean(image if images else r["text"], html=html, control=control, whitespace=whitespace)
        return let(F.struct(text.alias("text"), r["n"].alias("n"), (n if images else F.lit(0)).alias("images")), told)

    def told(t: Column) -> Column:
        def with_found(d: Column) -> Column:
            # what matches is looked for only where something does
            found = F.when(sum((d[k] for k in KINDS), F.lit(0)) > 0, matches(t["text"], kinds, reveal)).otherwise(F.array().cast("array<struct<type:string,preview:string>>"))
            return F.struct(d["text"].alias("text"), t["n"].alias("fixes"), t["images"].alias("images"), *[d[k].alias(k) for k in KINDS], found.alias("found"))

        return let(redacted(t["text"], kinds), with_found)

    return let(first, run)


_WORD, _RUN = (re.compile(f"[{no}{''.join(sorted(_BLANK))}]+") for no in ("^", ""))


def findings(done: DataFrame, order: str = "pos") -> DataFrame:
    """What was redacted, a row each: pos, k, type, fieldPath, placeholder, preview."""
    return done.select(F.col(order).alias("pos"), F.posexplode("findings").alias("k", "f")).select("pos", "k", "f.*")


def transform(
    df: DataFrame,
    text: str = "text",
    exclude: Iterable[str] = (),
    renames: Mapping[str, str] | None = None,
    remove_empty: bool = True,
    fix_encoding: bool = True,
    images: bool = True,
    html: bool = True,
    control: bool = True,
    whitespace: bool = True,
    kinds: tuple[str, ...] = KINDS,
    reveal: bool = False,
) -> DataFrame:
    """The rows with ``record`` (JSON, keys in their order), counters and findings of the JSON objects in column ``text``.

    Keys in order: excluded ones go; every text in a value, however deep, is cleaned and redacted; a text at the top
    goes by its key's name too; blank ones go if asked; names change, a later value taking the place of an earlier one of
    the same new name. Findings tell their paths; previews are masked unless ``reveal``. n_empty counts nulls and blank texts
    that are left, n_blank_runs runs of white space in the record's JSON (for token estimates). A null text is a null record.
    """
    left, new_names = set(exclude), dict(renames or {})
    schema = df.schema

    def apart(batches):
        kind = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))
        for b in slices(batches):
            out = []
            for value in b.column(b.schema.get_field_index(text)).to_pylist():
                found: list[tuple[str, str]] = []
                if value is not None:
                    for k, x in jsvalue.parse(value).items():
                        if k not in left:
                            texts(x, k, found)
                out.append([{"path": jsvalue.carried(p), "text": jsvalue.carried(t)} for p, t in found])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], names=[*b.schema.names, "_texts"])

    d = df.mapInArrow(apart, T.StructType([*schema.fields, T.StructField("_texts", T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType())])))]))
    d = d.withColumn("_clean", F.transform("_texts", lambda t: clean_text(t["text"], fix_encoding, images, html, control, whitespace, kinds, reveal)))

    def together(batches):
        names = [x.split()[0] for x in RESULT.split(", ")]
        kinds_ = [pa.string()] + [pa.int64()] * 8 + [pa.list_(pa.struct([(n, pa.string()) for n in ("type", "fieldPath", "placeholder", "preview")]))]
        for b in slices(batches):
            at = {n: i for i, n in enumerate(b.schema.names)}
            rows = [record(*x) for x in zip(b.column(at[text]).to_pylist(), b.column(at["_texts"]).to_pylist(), b.column(at["_clean"]).to_pylist(), strict=True)]
            own = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds_)]
            yield pa.RecordBatch.from_arrays([*(b.column(at[n]) for n in schema.names), *own], names=[*schema.names, *names])

    def record(source, paths, done):
        if source is None:
            return (None, *[0] * 8, [])
        counts = {"fixes": 0, "images": 0} | dict.fromkeys(KINDS, 0)
        findings, new = [], iter([jsvalue.uncarried(x["text"]) for x in done])
        told = iter(zip(paths, done, strict=True))
        out: dict[str, object] = {}
        for key, value in jsvalue.parse(source).items():
            if key in left:
                continue
            inner: list[tuple[str, str]] = []
            texts(value, key, inner)
            for _ in inner:
                p, x = next(told)
                for c in counts:
                    counts[c] += x[c]
                findings += [(f["type"], p["path"], PLACEHOLDER[f["type"]], f["preview"]) for f in x["found"]]
            value = rebuilt(value, new)
            kind = key_kind(key)
            if kind in kinds and isinstance(value, str) and value != PLACEHOLDER[kind]:
                counts[kind] += 1
                findings.append((kind, jsvalue.carried(key), PLACEHOLDER[kind], jsvalue.carried(value if reveal else value[:2] + "***")))
                value = PLACEHOLDER[kind]
            if not (remove_empty and is_blank(value)):
                out[new_names.get(key) or key] = value
        text_ = jsvalue.write(out)
        cells = [dict(zip(("type", "fieldPath", "placeholder", "preview"), f, strict=True)) for f in findings]
        return (text_, counts["fixes"], counts["images"], *[counts[k] for k in KINDS], count_empty(out), blank_runs(text_), cells)

    return d.mapInArrow(together, T.StructType([*schema.fields, *T.StructType.fromDDL(RESULT).fields]))


def documents(df: DataFrame, source_file: str, source_type: str, tool: str, position: str = "pos", record: str = "record") -> DataFrame:
    """content, value (a document as JSON), n_words (of the content) and n_empty (nulls and blank texts) of records in JSON: as for typed records, numbers in ECMAScript's form."""

    def run(batches):
        for b in slices(batches):
            at = {n: i for i, n in enumerate(b.schema.names)}
            out = [document(*x) for x in zip(b.column(at[position]).to_pylist(), b.column(at[record]).to_pylist(), strict=True)]
            cols = [pa.array([o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(at[position]), *cols], names=[position, "content", "value", "n_words", "n_empty"])

    def document(row, text):
        meta: dict[str, object] = {"source_file": source_file, "source_type": source_type, "tool": tool, "row": float(row)}
        lines = []
        for k, v in jsvalue.parse(text).items():
            shown = v if isinstance(v, str) else "" if v is None else jsvalue.write(v)
            if shown:
                lines.append(f"{k}: {shown}")
            if v is None or isinstance(v, (bool, float)) or (isinstance(v, str) and len(v.encode("utf-16-le", "surrogatepass")) // 2 <= SHORT):
                meta[k] = v
        content = jsvalue.carried("\n".join(lines))
        whole = {"metadata": meta, "content": content}
        return content, jsvalue.write(whole), len(_WORD.findall(content)), count_empty(whole)

    d = df.select(position, record)
    return d.mapInArrow(run, T.StructType([d.schema[position], T.StructField("content", T.StringType()), T.StructField("value", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_empty", T.LongType())]))


def diagnostics(done: DataFrame, files: list[str], most_findings: int | None = None, order: str = "pos") -> DataFrame:
    """One row of counters over the rows of :func:`transform`; the text of the token estimate is the array of records as JSON.

    ``most_findings``: as many findings as the report lists, in input order.
    """
    totals = done.agg(
        F.count("*").alias("rowCount"),
        F.coalesce(F.sum("n_empty"), F.lit(0)).alias("emptyFieldCount"),
        F.coalesce(F.sum("n_fixes"), F.lit(0)).alias("encodingFixCount"),
        F.struct(*[F.coalesce(F.sum(n), F.lit(0)).alias(k) for k, n in COUNTERS.items()]).alias("redactionCounts"),
        F.coalesce(F.sum("n_images"), F.lit(0)).alias("removedBase64Images"),
        tokens(1 + F.coalesce(F.sum("n_blank_runs"), F.lit(0))).alias("estimatedTokens"),
    )
    listed = F.lit(None).cast(f"array<{FINDING}>")
    if most_findings is not None:
        # the bound is small, so the list is one value
        top = done.select(order, F.posexplode("findings").alias("k", "f")).orderBy(order, "k").limit(most_findings).collect()
        listed = F.array(*[F.struct(*[F.lit(r["f"][n]).alias(n) for n in ("type", "fieldPath", "placeholder", "preview")]) for r in top]).cast(f"array<{FINDING}>")
    return totals.withColumns({"inputFiles": F.array(*[F.lit(f) for f in files]), "redactionFindings": listed})

