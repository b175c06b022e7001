"""Items of JSON arrays of any size, found in byte ranges of their files by many tasks.

Spark's text reader cuts files at commas, in splits of a bounded size. What a split does to the state of a JSON reader (in a string or not,
and how deep) is a small function: where it ends and how much deeper, for a start outside and one inside a string. The functions of the
splits of a file are composed in order, which gives the state that each begins in; then each finds its separators by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.sources.scratch import kept

SPACE = " \t\r\n"


def structure(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of bytes of JSON that begin outside a string: whether each is followed by text in a string, and the change of depth it would make outside of one."""
    quote = data == 0x22
    at = np.flatnonzero(quote)
    before = at[(at > 0) & (data[np.maximum(at, 1) - 1] == 0x5C)]
    for i in before.tolist():  # escaped if an odd number of backslashes stands before it
        k = i
        while k and data[k - 1] == 0x5C:
            k -= 1
        quote[i] = (i - k) % 2 == 0
    inside = np.cumsum(quote) % 2 == 1
    low = data | 0x20  # [ and {, ] and } differ by this bit
    depth = np.zeros(len(data), np.int8)
    depth[(low == 0x7B) & (data >= 0x5B)] = 1
    depth[(low == 0x7D) & (data >= 0x5D)] = -1
    return inside, depth


def pieces(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after another, and where each value ends."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets[1:] - offsets[0]


def ends(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At the end of each value, counted from the column's start: in a string or not, the depth, and the depth if the start was in a string."""
    raw, end = pieces(column)
    inside, depth = structure(raw)
    at = lambda sums, none: np.concatenate([[none], sums])[end]
    outer, inner = np.cumsum(np.where(inside, 0, depth), dtype=np.int64), np.cumsum(np.where(inside, depth, 0), dtype=np.int64)
    return at(inside, False).astype(bool), at(outer, 0), at(inner, 0)


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """What stands between commas: file, block (the start of the split), value, in order within a split."""
    return spark.read.text(path, lineSep=",").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _by_split(b: pa.RecordBatch):
    """Runs of rows of one split: (file, block, first row, end row)."""
    files, blocks = b.column(0).dictionary_encode(), np.asarray(b.column(1))
    codes = files.indices.to_numpy(zero_copy_only=False)
    edge = np.r_[0, np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1, b.num_rows]
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield files.dictionary[codes[lo]].as_py(), int(blocks[lo]), lo, hi


def split_states(rows: DataFrame) -> DataFrame:
    """A row for each split: file, block, odd (quotes), outer and inner (its change of depth for a start outside and in a string), first (its first character)."""

    def run(batches):
        told: dict[tuple, list] = {}
        for b in batches:
            for file, block, lo, hi in _by_split(b):
                column = b.column(2).slice(lo, hi - lo)
                odd, outer, inner = (x[-1] for x in ends(column))
                held = told.setdefault((file, block), [False, 0, 0, ""])
                if held[0]:
                    outer, inner = inner, outer
                held[:3] = bool(held[0] ^ odd), held[1] + int(outer), held[2] + int(inner)
                if not held[3]:
                    text = next((t for t in (x.as_py().strip(SPACE) for x in column) if t), "")
                    held[3] = text[:1]
        if told:
            out = [(*k, *v) for k, v in told.items()]
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["file", "block", "odd", "outer", "inner", "first"])

    # a split is read by one task, so its batches meet there
    return rows.mapInArrow(run, "file string, block long, odd boolean, outer long, inner long, first string")


def composed(states: list) -> dict[tuple[str, int], tuple[bool, int, bool]]:
    """The state in which each split begins (in a string, depth), and whether its file is an array; from a few numbers a split."""
    out: dict[tuple[str, int], tuple[bool, int, bool]] = {}
    file, inside, depth, array = None, False, 0, None
    for r in [*sorted(states, key=lambda r: (r["file"], r["block"])), None]:
        if r is None or r["file"] != file:
            if file is not None and array is None:
                raise ValueError("JSON text is empty")
            if file is not None and (inside or depth):
                raise ValueError(f"JSON text is cut off: {file}")
            if r is None:
                break
            file, inside, depth, array = r["file"], False, 0, None
        if array is None and r["first"]:
            array = r["first"] == "["
        out[file, r["block"]] = (inside, depth, bool(array))
        depth += r["inner"] if inside else r["outer"]
        inside ^= r["odd"]
    return out


def item_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, pos (from 1), lone, last and text of the items of JSON files as they stand there; a file that is no array is one item, and lone.

    The text of an array's first item has its opening bracket, that of its last one the closing bracket: an empty array has one item, which is both.
    Items that lie in several splits are put together from theirs, all others come whole from the task that read them. A blank or unbalanced
    file is a ValueError. Three numbers a split go through the driver.
    """
    rows = fragments(spark, path)
    starts = composed(split_states(rows).collect())
    known = spark.sparkContext.broadcast(starts)  # a few numbers a split

    def run(batches):
        open_: dict[tuple, list] = {}  # of the split that is read: in a string, depth, number of its items so far, parts of the item that is open
        for b in batches:
            out: list[tuple] = []
            for file, block, lo, hi in _by_split(b):
                key = (file, block)
                if key not in open_:
                    out += left(open_)
                    open_ = {key: [*known.value[key][:2], 0, []]}
                state = open_[key]
                column = b.column(2).slice(lo, hi - lo)
                odd, outer, inner = ends(column)
                inside, depth = odd ^ state[0], state[1] + (inner if state[0] else outer)
                values, array = column.to_pylist(), known.value[key][2]
                begin = 0
                for i in (np.flatnonzero(~inside & (depth == 1)) if array else ()):
                    i = int(i)
                    out.append((*key, state[2], True, ",".join([*state[3], *values[begin : i + 1]]), False))
                    state[2], state[3], begin = state[2] + 1, [], i + 1
                state[3] += values[begin:]
                state[0], state[1] = bool(inside[-1]), int(depth[-1])
            yield batch(out)
        yield batch(left(open_))

    def left(open_: dict) -> list[tuple]:
        """What is open where a split ends: nothing, if it ends with a separator."""
        return [(*k, v[2], False, ",".join(v[3]), not known.value[k][2]) for k, v in open_.items() if v[3]]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["file", "block", "k", "ended", "text", "lone"])

    found = kept(rows.mapInArrow(run, "file string, block long, k long, ended boolean, text string, lone boolean"), "items")
    counts = {(r["file"], r["block"]): r["n"] for r in found.groupBy("file", "block").agg(F.count_if("ended").alias("n")).collect()}
    before, file, seen = [], None, 0
    for f, block in sorted(starts):
        file, seen = f, (seen if f == file else 0)
        before.append((f, block, seen))
        seen += counts.get((f, block), 0)
    # an item's number: what ended in earlier splits of its file, and in its own
    numbered = found.join(F.broadcast(spark.createDataFrame(before, "file string, block long, before long")), ["file", "block"]).withColumn("pos", F.col("before") + F.col("k") + 1)
    edge = (F.col("k") == 0) | ~F.col("ended")  # at most two a split, which may go on in others
    whole = numbered.where(~edge).select("file", "pos", "lone", F.lit(False).alias("last"), "text")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"])
    joined = numbered.where(edge).groupBy("file", "pos").agg(F.bool_or("lone").alias("lone"), (~F.bool_or("ended")).alias("last"), F.array_join(parts, ",").alias("text"))
    return whole.unionByName(joined)
