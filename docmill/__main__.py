"""Command line: python -m docmill TOOL INPUT OUTPUT [options]."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators import tools
from docmill.sources import readers, sinks


def name_list(text: str) -> tuple[str, ...]:
    return tuple(x for x in (p.strip() for p in text.split(",")) if x)


def rename_pairs(text: str) -> dict[str, str]:
    """old:new pairs; a pair without both names is an error."""
    out = {}
    for part in name_list(text):
        old, colon, new = (x.strip() for x in part.partition(":"))
        if not (colon and old and new):
            raise argparse.ArgumentTypeError(f"{part!r} is not old:new")
        out[old] = new
    return out


def yes_no(text: str) -> bool:
    said = text.strip().lower()
    if said in ("true", "1", "yes", "oui"):
        return True
    if said in ("false", "0", "no", "non"):
        return False
    raise argparse.ArgumentTypeError(f"{text!r} is neither yes nor no")


def whole(text: str) -> int:
    if not text.isdigit():
        raise argparse.ArgumentTypeError(f"{text!r} is not a whole number from 0")
    return int(text)


def number(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        raise argparse.ArgumentTypeError(f"{text!r} is not a number") from None


def imported(text: str):
    """A function named as module:function: a parser of files, or a caller that labels items."""
    module, colon, name = text.partition(":")
    if not (module and colon and name):
        raise argparse.ArgumentTypeError(f"{text!r} is not module:function")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError) as e:
        raise argparse.ArgumentTypeError(str(e)) from None


LABELS = "json-qualifier"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("docmill", description="Prepares documents: one of the tools over an input path.")
    p.add_argument("tool", choices=sorted([*tools.TOOLS, LABELS]))
    p.add_argument("input", nargs="+")
    p.add_argument("output")
    p.add_argument("--mode", dest="output_mode", choices=("canonical", "rag", "jsonl", "document"))
    p.add_argument("--report")
    p.add_argument("--exclude", dest="excluded_fields", type=name_list)
    p.add_argument("--rename", dest="field_renames", type=rename_pairs)
    p.add_argument("--min-score", type=number)
    p.add_argument("--parser", type=imported, help="module:function that reads a spreadsheet's rows or a PDF's pages from its bytes")
    p.add_argument("--caller", type=imported, help="module:function that labels an item")
    p.add_argument("--answers", help="folder of the log of answers, read and added to")
    p.add_argument("--prompt", help="what items are asked with: answers to another prompt don't count")
    p.add_argument("--concurrency", type=whole)
    p.add_argument("--retries", dest="max_retries", type=whole)
    for field in ("content", "title", "category"):
        p.add_argument(f"--{field}-field")
    p.add_argument("--enable-openai-qualification", dest="enable_qualification", type=yes_no)
    p.add_argument("--min-body-length", type=whole)
    for flag in ("only-rag-candidates", "keep-author", "keep-client", "redact-client", "include-inactive", "include-menu-pages", "redact-sensitive", "remove-empty-fields", "pretty"):
        p.add_argument(f"--{flag}", type=yes_no)
    return p


def read(spark: SparkSession, tool: str, path: str, parse=None) -> DataFrame:
    """The records that a tool takes, from the files at a path."""
    kind = path.rsplit(".", 1)[-1].lower()
    if (kind in ("xlsx", "xls") or tool == "pdf-to-markdown") and parse is None:
        raise ValueError(f"--parser is needed to read {kind} files")
    if tool == "pdf-to-markdown":
        pages = readers.file_pages(spark, path, parse)
        return pages.select(F.element_at(F.split("path", "/"), -1).alias("file"), "page", "text")
    if tool == "csv-xlsx-to-json":
        return tools.as_json(readers.read_sheets(spark, path, parse) if kind in ("xlsx", "xls") else readers.read_table(spark, path))
    return readers.read_json(spark, path, array=tool in ("odoo-knowledge-cleaner", "support-ticket-cleaner"), objects=tool == LABELS)


def put(result: tools.Result, output: str, pretty: bool) -> None:
    """Writes what counts of a result: lines of objects, text, Markdown, or one JSON array."""
    if result.lines is not None:
        sinks.write_lines(result.lines, output)
    elif result.text is not None and "markdown" in result.text.columns:
        sinks.write_markdown(result.text, output)
    elif result.text is not None:
        sinks.write_jsonl(result.text, output)
    else:
        found = result.output
        order = [c for c in ("pos", "file", "page") if c in found.columns]
        if "metadata" in found.columns and not order:
            found = found.withColumns({"file": F.col("metadata.source_file"), "page": F.col("metadata.page")})
            order = ["file", "page"]
        made = next((F.col(c) for c in ("value", "record", "text") if c in found.columns and "metadata" not in found.columns), None)
        value = made if made is not None else F.to_json(F.struct(*[c for c in found.columns if c not in order]))
        sinks.write_json_array(found.select(*order, value.alias("value")), output, order, pretty)


def main(argv: list[str] | None = None) -> int:
    a = vars(parser().parse_args(argv))
    name, paths, output, report, parse, caller = (a.pop(x) for x in ("tool", "input", "output", "report", "parser", "caller"))
    try:
        path = readers.one_input(paths)
        if name == LABELS and caller is None and a["enable_qualification"] is not False:
            raise ValueError("--caller is needed to label items")
        tool = tools.qualifier(caller) if name == LABELS else tools.get_tool(name)
        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        config = tools.with_options(tool, **a)
        result = tool.run(read(spark, name, path, parse), config, path.rsplit("/", 1)[-1])
        put(result, output, config.pretty)
        if report:
            result.report_output.coalesce(1).write.mode("overwrite").json(report)  # one row
        print(json.dumps(result.diagnostics.first().asDict(recursive=True), ensure_ascii=False))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
