"""Preview tables of files of JSON values, and the preview of a result with its total."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.jsvalue import carried, number_text, parse, write

#: Items and columns that a table shows; files whose items a task holds at a time.
ITEMS, COLUMNS, OPEN = 10, 12, 4096
SCALARS, PAIRS = ("element",), ("cle", "valeur")


def shown(value) -> str:
    """A cell: texts as they are, others as JSON, null and absent ones as the JSON of an empty text."""
    return carried(value) if isinstance(value, str) else '""' if value is None else write(value)


def plain_text(value) -> str:
    """A value as ECMAScript makes text of it; null is empty. Items of a list are joined by commas."""
    if isinstance(value, list):
        return ",".join(map(plain_text, value))
    if value is None or isinstance(value, str):
        return carried(value or "")
    if isinstance(value, bool):
        return "true" if value else "false"
    return number_text(value) if isinstance(value, float) else "[object Object]"


def table_of(items: list, lone: bool, scalars: bool, rows: int = ITEMS, columns: int = COLUMNS) -> tuple[list[str], list[list[str]]] | None:
    """Headers and rows of a file's first items. ``lone``: the file is one value, no array; ``scalars``: none of its items is an object.

    An object is shown by its keys and values, an array without objects as one column; else by the keys of the objects
    among the first items, in the order in which they come up. None where there is nothing to show.
    """
    if lone and isinstance(items[0], dict):
        return list(PAIRS), [[carried(k), shown(v)] for k, v in list(items[0].items())[:rows]]
    if lone:
        return None
    if scalars:
        return list(SCALARS), [[plain_text(x)] for x in items[:rows]]
    objects = [x for x in items[:rows] if isinstance(x, dict)]
    if not objects:
        return None
    heads = list(dict.fromkeys(k for x in objects for k in x))[:columns]
    return [carried(h) for h in heads], [[shown(x.get(h)) for h in heads] for x in objects]


def first_items(df: DataFrame, rows: int = ITEMS) -> DataFrame:
    """Of rows (file, pos, text, lone): the first ``rows`` of each file with n (rows it stands for) and scalars (no object among these).

    A task keeps no more of a file than that, and merges what it is given: so it combines before a shuffle and after one. Files beyond those that a task may hold
    go out and are merged later.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        open_: dict = {}

        def out() -> pa.RecordBatch:
            flat = [(f, p, t, lone, n if i == 0 else 0, scalars) for f, (first, n, scalars) in open_.items() for i, (p, t, lone) in enumerate(first)]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.bool_())
            open_.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], k) for i, k in enumerate(kinds)], names=["file", "pos", "text", "lone", "n", "scalars"])

        for b in batches:
            for f, p, t, lone, n, scalars in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held = open_.setdefault(f, [[], 0, True])
                held[1] += n
                held[2] &= scalars
                if len(held[0]) < rows or p < held[0][-1][0]:
                    bisect.insort(held[0], (p, t, lone), key=lambda x: x[0])
                    del held[0][rows:]
            if len(open_) > OPEN:
                yield out()
        if open_:
            yield out()

    return df.select("file", "pos", "text", "lone", "n", "scalars").mapInArrow(run, "file string, pos long, text string, lone boolean, n long, scalars boolean")


def preview_tables(df: DataFrame, rows: int = ITEMS, columns: int = COLUMNS) -> DataFrame:
    """A table for each file of rows (file, pos, text and, if there, lone): file, n_items, headers, rows.

    ``text`` is an item as JSON (see readers.json_records), ``lone`` says that the file is that one value. Files of any number of items
    are summed to their first ones in every task, dealt over 32 parts and summed again, so the last step has at most 32 times ``rows`` of
    one. A file with nothing to show has null headers. Empty input gives no rows.
    """
    lone = F.col("lone") if "lone" in df.columns else F.lit(False)
    items = df.select(F.col("file").cast("string"), F.col("pos").cast("long"), "text", lone.alias("lone"), F.lit(1).cast("long").alias("n"), (~F.startswith(F.ltrim("text"), F.lit("{"))).alias("scalars"))
    some = first_items(items, rows).withColumn("part", F.pmod(F.xxhash64("pos"), F.lit(32)))
    few = first_items(some.repartition("file", "part"), rows).groupBy("file").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "text", "lone"))), 1, rows).alias("items"), F.sum("n").alias("n_items"), F.bool_and("scalars").alias("scalars"))

    def run(batches):
        for b in batches:
            made = [table_of([parse(x["text"]) for x in items], items[0]["lone"], scalars, rows, columns) or (None, None) for items, scalars in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]
            texts = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([m[0] for m in made], texts), pa.array([m[1] for m in made], pa.list_(texts))], names=["file", "n_items", "headers", "rows"])

    return few.mapInArrow(run, "file string, n_items long, headers array<string>, rows array<array<string>>")


def result_preview(df: DataFrame, order: tuple[str, ...], value: str = "value", items: int = 10, chars: int = 20_000, total: int | None = None) -> tuple[str, bool, str]:
    """The first ``items`` objects (JSON texts) of a result as indented JSON, whether it is cut at ``chars`` characters, and a note that gives the total."""
    total = df.count() if total is None else total
    first = [parse(r[0]) for r in df.orderBy(*order).limit(items).select(value).collect()]
    text = write(first, 2)
    notes = [f"JSON limite aux {items} premiers elements sur {total}."] if total > items else []
    if len(text.encode("utf-16-le", "surrogatepass")) // 2 > chars:
        notes.append(f"Sortie formatee limitee a {chars:,} caracteres.".replace(",", " "))
        return text.encode("utf-16-le", "surrogatepass")[: 2 * chars].decode("utf-16-le", "ignore"), True, " ".join(notes)
    return text, False, " ".join(notes)
