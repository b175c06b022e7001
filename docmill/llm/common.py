"""What the training-data operators share: tables, shared scratch, word hashing."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separators of words in every contract of this package: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Names that start so are this package's own: helper columns that no caller's column clashes with.
OWN = "__docmill_"
PACKED = OWN + "packed"


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a new local folder serves a master that runs in this process (tests); a cluster has no
    folder of that kind, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            return known
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="docmill-", dir=os.environ.get("TMPDIR"))
        spark.sparkContext.setCheckpointDir(root)
    return root


def stash(df: DataFrame, what: str = "stash") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Delete a stash that nothing lazy reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def salted(big: DataFrame, small: DataFrame, hot: DataFrame, key: str, row: tuple[str, ...]) -> DataFrame:
    """``big`` join ``small`` on ``key``; keys in ``hot`` (key, OWN + parts) are dealt by the hash of columns ``row`` to that many parts, small's rows of them repeated for each. ``hot`` is broadcast, so its size must be bounded."""
    salt, parts, hot_key = (OWN + n for n in ("salt", "parts", "hot"))
    hot = F.broadcast(hot.withColumnRenamed(key, hot_key))
    n = F.coalesce(F.col(parts), F.lit(1).cast("long"))
    dealt = big.join(hot, F.col(key) == F.col(hot_key), "left").withColumn(salt, F.pmod(F.xxhash64(*row), n)).drop(hot_key, parts)
    each = small.join(hot, F.col(key) == F.col(hot_key), "left").withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop(hot_key, parts)
    # one kind of join whatever the size: the plan that is tested is the plan that runs at scale
    return dealt.join(each.hint("merge"), [key, salt]).drop(salt)


def hot_share(rows: int, least: int = 512, heavy: int = 4096) -> int:
    """Rows of one key from which it is dealt to several tasks: at most ``heavy`` keys have more, whatever the number of rows."""
    return max(least, -(-rows // heavy))


def salted_join(big: DataFrame, small: DataFrame, key: str, *row: str) -> DataFrame:
    """``big`` join ``small`` on ``key`` (not null), with the hot keys of big dealt to many tasks. ``big`` is read three times, so it should be a stash or cheap."""
    share = hot_share(big.count())
    hot = big.groupBy(key).count().where(F.col("count") > share).select(key, F.ceil(F.col("count") / share).alias(OWN + "parts"))
    return salted(big, small, stash(hot, "hot"), key, row)


def shielded(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns of ``names`` under reserved ones, and where each column is now: {column: its name now}."""
    now = {c: (OWN + "kept_" + c if c in names else c) for c in df.columns}
    return df.withColumnsRenamed({c: n for c, n in now.items() if c != n}), now


def give_back() -> None:
    """The worker, which Spark keeps for later tasks, gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(run):
    """``run`` over Arrow batches; freed memory is given back at its end."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser over a uint64 array (bijective)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_SALT = np.uint64(0x2545F4914F6CDD1D)


def _multipliers(place: np.ndarray) -> np.ndarray:
    """An odd multiplier of its own for each place in a word."""
    return mix64(place.astype(np.uint64) + _SALT) | np.uint64(1)


_PLACE = _multipliers(np.arange(1 << 16))


def word_hashes(data: bytes, separators: np.ndarray = _SPACE, slice_: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of UTF-8 bytes, A-Z lower-cased; in slices, so that long texts need little besides.

    A hash is multilinear: the sum of byte values times multipliers drawn for each place, so words that differ
    are equal by chance only (about 2**-62 a pair), whatever their pattern.
    """
    raw = np.frombuffer(data, np.uint8)
    out, lo = [], 0
    while lo < len(raw):
        hi = min(len(raw), lo + slice_)
        if hi < len(raw):  # cut behind the last separator, or else go on to the next one
            gap = np.flatnonzero(separators[_LOWER[raw[lo:hi]]])
            hi = lo + int(gap[-1]) + 1 if len(gap) else lo + slice_
            while hi < len(raw) and not separators[_LOWER[raw[hi - 1]]]:
                hi += 1
        b = _LOWER[raw[lo:hi]]
        inside = np.zeros(len(b) + 2, np.int8)
        inside[1:-1] = ~separators[b]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(start):
            place = np.arange(len(b))
            place -= np.repeat(start, np.diff(np.concatenate([start[:1] * 0, start[1:], [len(b)]])))
            v = _BYTE[b] * _PLACE[place & 0xFFFF]
            far = np.flatnonzero(place > 0xFFFF)
            if len(far):
                v[far] = _BYTE[b[far]] * _multipliers(place[far])
            v[inside[1:-1] == 0] = 0
            out.append((mix64(np.add.reduceat(v, start)), start + lo, end + lo))
        lo = hi
    if not out:
        e = np.empty(0, np.int64)
        return e.astype(np.uint64), e, e
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def shingles(data: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of UTF-8 bytes; fewer words: one of the whole sequence; none: empty."""
    h = word_hashes(data)[0]
    return np.unique(windows(h, k)) if len(h) else h


def unpacked(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of :func:`packed` with their text back, in the columns of ``schema``; what was null is empty."""
    names = schema.fieldNames()

    @tidy
    def run(batches):
        import zstandard

        z = zstandard.ZstdDecompressor()
        for b in slices(batches, 2048):
            at = {n: i for i, n in enumerate(b.schema.names)}
            texts = pa.array([z.decompress(x.as_py()) for x in b.column(at[PACKED])], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([texts if n == "text" else b.column(at[n]) for n in names], names=names)

    return rows.mapInArrow(run, schema)


def packed(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``text`` replaced by PACKED, compressed for a shuffle; null is empty."""
    rest = [c for c in docs.columns if c != text]

    @tidy
    def run(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            *cols, texts = b.columns
            rows = [z.compress(x.as_buffer()) if x.is_valid else z.compress(b"") for x in texts]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(rows, pa.binary())], names=[*rest, PACKED])

    return docs.select(*rest, text).mapInArrow(run, T.StructType([*docs.select(*rest).schema.fields, T.StructField(PACKED, T.BinaryType())]))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order; a shorter sequence is one run."""
    k = min(k, len(h))
    n = len(h) - k + 1
    acc = np.full(n, np.uint64(k))
    for i in range(k):
        acc = (acc ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return mix64(acc)


def slices(batches, rows: int):
    """Batches of at most ``rows`` rows, so that what a step holds besides is bounded."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def i64(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)
