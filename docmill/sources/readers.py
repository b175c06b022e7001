"""Sources: delimited tables with header folding, JSON values as records, pages of files."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.batches import slices
from docmill.functions.jsvalue import parse, write
from docmill.functions.jstext import WS
from docmill.functions.keys import normalize_keys
from docmill.operators.ordering import ranked
from docmill.sources import jsonsplit


def table_records(cells: DataFrame) -> DataFrame:
    """Records of rows of cells (file, pos, c0, c1, ...): names folded from a file's first row that is not blank, row from 1 in each file.

    Blank rows are left out. All files have the names of the first; columns past its header that hold nothing are dropped; a later column of
    one name replaces an earlier one. Empty input is an error.
    """
    names = [c for c in cells.columns if c not in ("file", "pos")]
    body = cells.where(F.regexp_like(F.concat_ws("", *names), F.lit(f"[^{WS}]")))
    body = ranked(body, "file", [F.col("pos").asc()], "row").withColumn("row", F.col("row") - 1)
    told = body.agg(F.min_by(F.struct(*names), F.struct("file", "pos")).alias("head"), *[F.max(F.when(F.col("row") > 0, F.length(c))).alias(c) for c in names]).first()
    if told is None or told["head"] is None:
        raise ValueError("the file is empty")
    head = [told["head"][c] or "" for c in names]
    last = max((i for i, c in enumerate(names) if head[i] or (told[c] or 0)), default=0)
    keep = {n: c for n, c in zip(normalize_keys(head[: last + 1]), names, strict=False)}
    return body.where("row > 0").select("file", "row", *[F.coalesce(F.col(c), F.lit("")).alias(n) for n, c in keep.items()])


def read_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Records of delimited files (see table_records), all values strings.

    A file's first line may be narrower than others, so the width is bounded first, by the delimiters of the widest line.
    """
    width = (spark.read.text(path).agg(F.max(F.regexp_count("value", F.lit("\\" + sep)))).first()[0] or 0) + 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    df = spark.read.csv(path, sep=sep, schema=schema, multiLine=True, escape='"')
    return table_records(df.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"), "*"))


def read_sheets(spark: SparkSession, path: str, parser: Callable[[bytes], list[list]]) -> DataFrame:
    """Records of spreadsheets (see table_records) through an injected parser that gives the rows of cells of the first sheet; dates as ISO texts."""

    def text(v) -> str | None:
        return None if v is None else v.isoformat() if hasattr(v, "isoformat") else str(v)

    def run(pdfs):
        import pandas as pd

        for pdf in pdfs:
            rows = [(p, i, [text(v) for v in cells]) for p, c in zip(pdf["path"], pdf["content"], strict=True) for i, cells in enumerate(parser(bytes(c)))]
            yield pd.DataFrame(rows, columns=["file", "pos", "cells"])

    return sheet_records(spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, pos long, cells array<string>"))


def sheet_records(cells: DataFrame) -> DataFrame:
    """Records (see table_records) of rows of sheets: file, pos and cells."""
    width = cells.agg(F.max(F.size("cells"))).first()[0] or 1
    return table_records(cells.select("file", "pos", *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(width)]))


def one_input(paths: list[str]) -> str:
    """The path, if there is exactly one."""
    if len(paths) != 1:
        raise ValueError(f"one input file is needed, not {len(paths)}")
    return paths[0]


def read_json(spark: SparkSession, path: str, array: bool = False, objects: bool = False) -> DataFrame:
    """file, pos (from 1), record (variant) and text (the same as JSON, keys in their order) of JSON files, one value each.

    Items of an array are records, another value is one; what is no object is {"value": x}. ``array``: another value
    is an error; ``objects``: an item that is no object is an error that names it. Bad JSON and blank texts fail; an item that is nested
    more than a thousand deep has its text and a null record; a file
    without a byte is none to Spark, and gives no rows. A file of any size is read in splits by many tasks (see :mod:`docmill.sources.jsonsplit`).
    """
    items = jsonsplit.item_texts(spark, path)

    def run(batches):
        for b in slices(batches):
            out = []
            for file, pos, lone, last, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if not lone:
                    text = text.lstrip(jsonsplit.SPACE)[1:] if pos == 1 else text
                    if last:
                        text = text.rstrip(jsonsplit.SPACE)
                        if text[-1:] != "]":
                            raise ValueError(f"bad JSON at the end of {file}")
                        text = text[:-1]
                        if pos == 1 and not text.strip(jsonsplit.SPACE):
                            continue
                elif array or objects:
                    raise ValueError("a JSON array is expected")
                value = parse(text)
                if objects and not isinstance(value, dict):
                    raise ValueError(f"item {pos} is not a JSON object")
                out.append((file, pos, write(value if isinstance(value, dict) or array else {"value": value})))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string()))], names=["file", "pos", "text"])

    found = items.select("file", "pos", "lone", "last", "text").mapInArrow(run, "file string, pos long, text string")
    name = F.url_decode(F.replace(F.element_at(F.split("file", "/"), -1), F.lit("+"), F.lit("%2B")))
    return found.select(name.alias("file"), F.col("pos").cast("int").alias("pos"), F.try_parse_json("text").alias("record"), "text")


def json_records(df: DataFrame, text: str = "value", array: bool = False, objects: bool = False) -> DataFrame:
    """The rows with pos, record and text of the records in JSON texts; see read_json."""

    def run(batches):
        for b in slices(batches):
            rows, out = [], []
            for i, value in enumerate(b.column(b.schema.get_field_index(text)).to_pylist()):
                items = split_items(value, array, objects)
                rows += [i] * len(items)
                out += [(k, item) for k, item in enumerate(items, 1)]
            taken = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.string())], names=[*b.schema.names, "pos", "_item"])

    # the order of keys is that of the source, which a variant doesn't keep
    out = df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("pos", T.IntegerType()), T.StructField("_item", T.StringType())]))
    return out.select(*df.columns, "pos", F.try_parse_json("_item").alias("record"), *([F.col("_item").alias("text")] if text != "text" else []))


def split_items(text: str, array: bool = False, objects: bool = False) -> list[str]:
    """The records of one JSON text, each as JSON."""
    if not text or not text.strip():
        raise ValueError("JSON text is empty")
    value = parse(text)
    if not isinstance(value, list):
        if array or objects:
            raise ValueError("a JSON array is expected")
        value = [value]
    for i, item in enumerate(value, 1):
        if objects and not isinstance(item, dict):
            raise ValueError(f"item {i} is not a JSON object")
    return [write(x if isinstance(x, dict) or array else {"value": x}) for x in value]


def file_pages(spark: SparkSession, path: str, parser: Callable[[bytes], list[list[str]]]) -> DataFrame:
    """(path, page, text) of binary files through an injected parser that gives the text items of each page."""

    def run(pdfs):
        import pandas as pd

        for pdf in pdfs:
            rows = [(p, i, " ".join(items)) for p, c in zip(pdf["path"], pdf["content"], strict=True) for i, items in enumerate(parser(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page int, text string")


def extension(name):
    return F.lower(F.regexp_extract(name, r"\.([^.]*)\z", 1))


def first_present(m, keys: tuple[str, ...]):
    """Value of the first key that a map has, even if the value is null."""
    out = None
    for k in keys:
        out = F.when(F.map_contains_key(m, F.lit(k)), m[k]) if out is None else out.when(F.map_contains_key(m, F.lit(k)), m[k])
    return out
