"""Periodic run detection: a Lyndon stack under both orders, with comparisons by rolling hash and direct words.

No suffix array is built. Lyndon roots (longest Lyndon words, by a stack scanned from right to left, once
under each order of the words) are the only candidates for periods of runs; each is extended both ways by the
length of common extensions.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import slices, table, tidy

#: A run has at least LEAST words and at least TIMES times its period.
LEAST, TIMES = 6, 4
DIRECT = 8  # words compared one by one before hashes are asked
_M = (1 << 61) - 1
_ODD = np.random.default_rng(11).integers(0, 2**64, 3, dtype=np.uint64) | np.uint64(1)


class Collision(Exception):
    """Equal hashes of words that differ."""


def stretches(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Ranges of words that hold all runs, most of a usual text left out.

    Every three words in a row inside a run recur in it: at least min(max(least, times) - 2, times - 1) times in
    all, at max(least, times) - 2 places in a row or more. Places of three words without that are in no run.
    """
    rows = max(least, times) - 2
    if len(ids) < max(least, times) or rows < 1:
        return [(0, len(ids))] if len(ids) and rows < 1 else []
    u = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        three = u[:-2] * _ODD[0] + u[1:-1] * _ODD[1] + u[2:] * _ODD[2]
    _, at, count = np.unique(three, return_inverse=True, return_counts=True)
    marked = np.zeros(len(three) + 2, np.int8)
    marked[1:-1] = count[at] >= min(rows, times - 1)
    edge = np.diff(marked)
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long_ = hi - lo >= rows
    return [(int(a), int(b) + 2) for a, b in zip(lo[long_], hi[long_], strict=True)]


def runs_of(x: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All runs of x: start, length, smallest period; by start, then period. ``times`` is 2 or more."""
    while True:
        try:
            return _runs(x, least, times, random.Random(len(x)).randrange(1 << 32, _M))
        except Collision:  # about 2**-61 a comparison; the next base is another one
            return _runs(x, least, times, random.randrange(1 << 32, _M))


def _runs(x: list[int], least: int, times: int, base: int) -> list[tuple[int, int, int]]:
    n = len(x)
    if n < max(least, times):
        return []
    sums, powers = [0] * (n + 1), [1] * (n + 1)
    for i, v in enumerate(x):
        sums[i + 1] = (sums[i] * base + v + 1) % _M
        powers[i + 1] = powers[i] * base % _M

    def same(i: int, j: int, k: int) -> bool:
        p = powers[k]
        return (sums[i + k] - sums[i] * p - sums[j + k] + sums[j] * p) % _M == 0

    def common(i: int, j: int) -> int:
        """Words that the suffixes at i < j share: some directly, then by doubling and halving on hashes."""
        most, k = n - j, 0
        near = min(most, DIRECT)
        while k < near and x[i + k] == x[j + k]:
            k += 1
        if k < near or k == most:
            return k
        step = DIRECT
        while k + step <= most and same(i + k, j + k, step):
            k += step
            step *= 2
        step //= 2
        while step:
            if k + step <= most and same(i + k, j + k, step):
                k += step
            step //= 2
        if k < most and x[i + k] == x[j + k]:
            raise Collision
        return k

    def before(i: int, j: int) -> int:
        """Words that the prefixes that end at i < j share at their ends."""
        k, near = 0, min(i, DIRECT)
        while k < near and x[i - 1 - k] == x[j - 1 - k]:
            k += 1
        if k < near or k == i:
            return k
        step = DIRECT
        while k + step <= i and same(i - k - step, j - k - step, step):
            k += step
            step *= 2
        step //= 2
        while step:
            if k + step <= i and same(i - k - step, j - k - step, step):
                k += step
            step //= 2
        if k < i and x[i - 1 - k] == x[j - 1 - k]:
            raise Collision
        return k

    found: set[tuple[int, int, int]] = set()
    for up in (True, False):
        ends = [n] * (n + 1)  # where the longest Lyndon word of each start ends: the stack, link by link
        last: dict[int, tuple[int, int]] = {}
        for i in range(n - 2, -1, -1):
            j, v = i + 1, x[i]
            while j < n:
                w = x[j]
                if v == w:
                    k = common(i, j)
                    if j + k == n:  # the suffix that ends is the smaller one
                        break
                    v_, w_ = x[i + k], x[j + k]
                    if (v_ > w_) if up else (v_ < w_):
                        break
                elif (v > w) if up else (v < w):
                    break
                j = ends[j]
            ends[i] = j
            p = j - i
            if i + 2 * p > n or v != x[j]:
                continue
            if p in last and last[p][0] <= i and j <= last[p][1]:
                continue  # another root of a run that is known
            right = j + common(i, j)
            if right - i < 2 * p:
                continue  # not the first root of a run of three periods or more
            left = i - before(i, j)
            last[p] = (left, right)
            if right - left >= max(least, times * p):
                found.add((left, right - left, p))
    for s, size, p in found:
        e = s + size
        if x[s : e - p] != x[s + p : e]:
            raise Collision
    return sorted((s, size, p) for s, size, p in found)


def runs_in(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """Runs of a sequence of words: start, length, period."""
    if len(words) < max(least, times):
        return []
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(words) - len(number) < times - 1:  # no word is there ``times`` times
        return []
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    out = []
    for lo, hi in stretches(ids, least, times):
        out += [(lo + s, size, p) for s, size, p in runs_of(ids[lo:hi].tolist(), least, times)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: Iterable[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run has after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for s, size, p in runs:
        drop[s + p] += 1
        drop[s + size] -= 1
    gone = np.cumsum(drop[:-1]) > 0
    return [w for w, d in zip(words, gone.tolist(), strict=True) if not d]


RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def find_runs(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The runs of the words of each whole text, and the text without their repeats: one row per row of ``docs``.

    A run is a stretch of words with smallest period q (words q apart are equal) of at least ``least`` words and
    ``times`` * q (``times`` 3 or more) that no neighbour extends. ``collapsed`` has the words, a blank between, that no run has after
    its first q words. Words are parted by ASCII white space and compared by their bytes. ``rewrite`` may change the words first.

    Null and empty texts have no words, no runs and an empty ``collapsed``; a null doc_id is kept as it is, repeated
    rows come out each, ties don't arise (a run is known by start and period). Empty input gives no rows. Other
    columns are neither read nor returned. No rows meet, so nothing is shuffled; one text is the largest unit of work,
    and takes about n log n steps and a hundred bytes a word.
    """
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    @tidy
    def run(batches):
        for b in slices(batches, 1024):
            ids, counts, runs, left = b.column(0).to_pylist(), [], [], []
            for doc_id, text in zip(ids, b.column(1), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []  # bytes.split parts at \x20 and \x09 to \x0d
                if rewrite is not None:
                    words = rewrite(doc_id, words)
                found = runs_in(words, least, times)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                left.append(b" ".join(kept_words(words, found) if found else words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(runs, pairs), pa.array(left, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RUNS)


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of all documents, by crc32 of the id, end periodically: word i >= a becomes word a + (i - a) % p. Without id nothing changes."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * -(-(n - a) // len(root)))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(table(spark, sf_dir, "documents"), periodic_tail)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("best", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
