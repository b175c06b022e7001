"""Sinks: JSON, JSON lines, Markdown."""

from __future__ import annotations

import functools
import operator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.batches import slices
from docmill.functions.jstext import sub, trim
from docmill.functions.jsvalue import parse, write


def write_jsonl(lines: DataFrame, path: str, order: tuple[str, ...] = ("pos",)) -> None:
    """A line a row, by the columns of ``order`` that there are: parts in the order of their names are the text."""
    by = [c for c in order if c in lines.columns]
    rows = lines.repartitionByRange(*by).sortWithinPartitions(*by) if by else lines
    rows.select("value").write.mode("overwrite").text(path)


def write_lines(lines: DataFrame, path: str, key: str = "key", at: str = "at") -> None:
    """One JSON array of objects that are several rows each (key, at, value), such as those of ticket_lines, in that order.

    Rows are written by Spark, range by range: an object may lie in many parts. Parts in the order of their names are the array.
    """
    edges = lines.agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max(at).alias("end")).first()
    if edges["first"] is None:
        lines.sparkSession.createDataFrame([("[]",)], "value string").write.mode("overwrite").text(path)
        return
    opens = F.when((F.col(key) == edges["first"]) & (F.col(at) == 0), F.lit("[\n")).otherwise(F.lit(""))
    ends = F.when(F.col(at) != edges["end"], F.lit("")).when(F.col(key) == edges["last"], F.lit("\n]")).otherwise(F.lit(","))
    rows = lines.repartitionByRange(key, at).sortWithinPartitions(key, at)
    rows.select(F.concat(opens, "value", ends).alias("value")).write.mode("overwrite").text(path)


def markdown_title(name: Column) -> Column:
    t = trim(sub(sub(name, r"\.[^.]+\z"), r"[_-]+", " "))
    return F.when(t == "", F.lit("Document PDF")).otherwise(t)


def pages_to_markdown(pages: DataFrame, file: str = "file", page: str = "page", text: str = "text") -> DataFrame:
    """Sections of a Markdown document of each file: (file, page, markdown), the title as page 0.

    A document is its sections in order, one line end between them and one at its end, which is what the text
    sink writes; so no file is held as a whole. Pages are numbered from 1.
    """
    titles = pages.select(file).distinct().select(file, F.lit(0).cast("long").alias(page), F.concat(F.lit("# "), markdown_title(F.col(file))).alias("markdown"))
    body = F.concat(F.lit("\n## Page "), F.col(page).cast("string"), F.lit("\n\n"), F.coalesce(F.col(text), F.lit("")))
    return titles.unionByName(pages.select(file, F.col(page).cast("long").alias(page), body.alias("markdown")))


def write_markdown(sections: DataFrame, path: str, file: str = "file", page: str = "page") -> None:
    """Sections as text under ``path``, in a folder for each file: parts in the order of their names are the document."""
    rows = sections.repartitionByRange(file, page).sortWithinPartitions(file, page)
    rows.select(file, F.col("markdown").alias("value")).write.mode("overwrite").partitionBy(file).text(path)


def page_documents(pages: DataFrame, source_file: Column, tool: str = "pdf-to-markdown") -> DataFrame:
    """A document (metadata, content) of each page."""
    head = F.struct(source_file.alias("source_file"), F.lit("pdf").alias("source_type"), F.lit(tool).alias("tool"), F.col("page"))
    return pages.select(head.alias("metadata"), F.coalesce("text", F.lit("")).alias("content"))


def write_json_array(lines: DataFrame, path: str, order: list[str], pretty: bool = True) -> None:
    """One JSON array of the objects in column ``value``, in the order of columns that no two rows share, indented by two unless told otherwise.

    Rows are laid out and written by Spark, range by range; parts in the order of their names are the array.
    """
    edges = lines.agg(F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last")).first()
    if edges["first"] is None:
        lines.sparkSession.createDataFrame([("[]",)], "value string").write.mode("overwrite").text(path)
        return
    # the first and the last row carry the brackets: known by their order, not by a numbering of all rows
    at = lambda edge: functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.lit(edge[c])) for c in order))
    opens, ends = F.when(at(edges["first"]), F.lit("[\n")).otherwise(F.lit("")), F.when(at(edges["last"]), F.lit("\n]")).otherwise(F.lit(","))
    rows = (indented(lines) if pretty else lines).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select(F.concat(opens, "value", ends).alias("value")).write.mode("overwrite").text(path)


def indented(lines: DataFrame, step: int = 2) -> DataFrame:
    """The rows with the JSON texts in ``value`` laid out with an indent, one level in."""
    at = lines.columns.index("value")

    def run(batches):
        for b in slices(batches):
            out = [" " * step + write(parse(t), step, 1) for t in b.column(at).to_pylist()]
            yield b.set_column(at, "value", pa.array(out, pa.string()))

    return lines.mapInArrow(run, lines.schema)


def preview(df: DataFrame, order: list[str], rows: int = 10, columns: int = 12, chars: int = 12_000) -> DataFrame:
    """The first rows and columns as text, each cell cut to ``chars`` characters."""
    return df.orderBy(*order).limit(rows).select(*[F.substring(F.col(c).cast("string"), 1, chars).alias(c) for c in df.columns[:columns]])


def format_bytes(n: Column) -> Column:
    """A size in bytes, KiB or MiB, with one decimal from a KiB on."""
    told = lambda x, unit: F.format_string("%.1f" + unit, x)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" o"))).when(n < 1024 * 1024, told(n / 1024, " Ko")).otherwise(told(n / (1024 * 1024), " Mo"))
