"""Removal of repeated byte windows by a depth-limited, most-significant-digit radix order of suffixes.

Only suffixes whose first ``DEPTH`` bytes can repeat are ordered. The first digit of a window is its anchor:
the least k-gram of the window by hash (so equal windows have equal anchors at equal places). Runs of
windows with one anchor move together until they must be told apart:

1. a shuffle by anchor; anchors that occur once drop out;
2. the second digit is the run's whole text: of equal runs all but the first repeat it;
3. what is left of repeated anchors, the first of each different run, is ordered window by window in digits
   of eight bytes, groups of one dropping out at each pass; the groups left after DEPTH bytes are
   exactly the repeated windows. Anchors with too many such runs come apart first: see ``halved``.

Runs are equal when the 64-bit hash of the anchor and that of the run's text are, each over other multipliers: 128 bits.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.common import OWN, PACKED, mix64, packed, slices, stash, table, tidy

DEPTH, GRAM, BLOCK = 100, 36, 1 << 18
WIDE_AT, SPREAD = 8, 64  # an anchor that a batch finds in more different runs goes to so many sub-keys
GROUP = 1000  # runs of one key that are ordered together; beyond, they are cut in halves with keys of their own. Both ways find the same
T_, PLACES = OWN + "t", OWN + "places"
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _M = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up = np.full(n, np.uint64(_BASE))
    up[0] = 1
    down = np.full(n, np.uint64(pow(_BASE, -1, 1 << 64)))
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Hasher:
    """Hashes of substrings of a block of bytes."""

    def __init__(self):
        self.up, self.down = _powers(BLOCK + DEPTH + 1)

    def sums(self, b: np.ndarray) -> np.ndarray:
        s = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * self.up[: len(b)], out=s[1:])
        return s

    def of(self, s: np.ndarray, lo, hi) -> np.ndarray:
        return (s[hi] - s[lo]) * self.down[lo]

    def grams(self, s: np.ndarray) -> np.ndarray:
        n = len(s) - GRAM
        return (s[GRAM:] - s[:-GRAM]) * self.down[:n]


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each window of ``width``, by doubling."""
    k = 1
    while 2 * k <= width:
        x = pick(x[:-k], x[k:])
        k *= 2
    return pick(x[: len(x) - (width - k)], x[width - k :]) if width > k else x


def first_least(h: np.ndarray, width: int) -> np.ndarray:
    """Of each window of ``width`` the place of its least value, the first of equals."""
    least = sliding(h, width, np.minimum)
    edge = np.zeros(width - 1, h.dtype)
    # a place is least in some window where the largest of its windows' least values is its own
    places = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), width, np.maximum) == h)
    j = np.searchsorted(places, np.arange(len(least)))
    at = places[j]
    wrong = np.flatnonzero(h[at] != least)
    while len(wrong):
        j[wrong] += 1
        at[wrong] = places[j[wrong]]
        wrong = wrong[h[at[wrong]] != least[wrong]]
    return at


def runs(b: np.ndarray, hasher: Hasher):
    """For each block of a text: anchors, run texts' hashes, first starts, numbers of starts, places of the anchor in the first window."""
    span = DEPTH - GRAM + 1
    for lo in range(0, max(0, len(b) - DEPTH + 1), BLOCK):
        part = b[lo : lo + BLOCK + DEPTH - 1]
        s = hasher.sums(part)
        h = hasher.grams(s)
        at = first_least(h, span)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        n = np.diff(np.concatenate([first, [len(at)]]))
        p = at[first]
        text = hasher.of(s, first, first + n - 1 + DEPTH) ^ mix64((n * 128 + (p - first)).astype(np.uint64))
        yield h[p], text, first + lo, n, p - first


ANCHORS = "k long, run long, doc_id long, t long, place long"  # place: first start << 24 | flags << 20 | starts << 8 | anchor's place
WIDE, DONE = np.int64(1 << 20), np.int64(1 << 21)  # flags: the anchor has several runs; an equal run is known to come earlier


def anchors(docs: DataFrame) -> DataFrame:
    """Anchors of all windows of (doc_id, t, text). Of equal runs in a batch only the first goes to its anchor; the others are DONE and go anywhere."""

    @tidy
    def run(batches):
        hasher = Hasher()
        for batch in slices(batches, 4096):
            rows: list[list[np.ndarray]] = [[], [], [], [], []]
            ids, ts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for i, x in enumerate(batch.column(2)):
                b = np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else np.empty(0, np.uint8)
                for k, text, first, n, p in runs(b, hasher):
                    for col, v in zip(rows, (k, text, np.full(len(k), ids[i]), np.full(len(k), ts[i]), (first.astype(np.int64) << 24) | (n << 8) | p), strict=True):
                        col.append(v)
            if not rows[0]:
                continue
            k, text, doc, t, place = (np.concatenate(c) for c in rows)
            order = np.lexsort((place, t, doc, text, k))
            k, text, doc, t, place = (c[order] for c in (k, text, doc, t, place))
            new_k = np.concatenate([[True], k[1:] != k[:-1]])
            new = new_k | np.concatenate([[True], text[1:] != text[:-1]])
            group = np.cumsum(new_k) - 1
            wide = np.bincount(group, weights=new)[group] > WIDE_AT
            # an anchor with many runs goes to sub-keys by run; one mark of it goes where other batches send it
            mark = wide & new_k
            key = np.where(wide, mix64(k ^ mix64(text % np.uint64(SPREAD) + np.uint64(1))), k)
            key = np.where(new, key, mix64(text ^ mix64(place.astype(np.uint64) ^ mix64(doc.astype(np.uint64)))))
            place = place | np.where(wide, WIDE, 0) | np.where(new, 0, DONE)
            cols = [np.concatenate([c, m[mark]]) for c, m in ((key, k), (text, text), (doc, doc), (t, t), (place, place))]
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in cols], names=["k", "run", "doc_id", "t", "place"])

    return docs.mapInArrow(run, ANCHORS)


RUNS = "doc_id long, t long, first long, n int, anchor int, open boolean"


def settle(rows: DataFrame) -> DataFrame:
    """Runs that repeat an earlier equal one (not open), and runs to be ordered (open): the first of each kind where an anchor has several."""

    @tidy
    def run(batches):
        last_k = last_run = None
        many, pending = False, None

        def give(doc, t, place, open_):
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(t), pa.array(place >> 24), pa.array(((place >> 8) & 0xFFF).astype(np.int32)), pa.array((place & 0xFF).astype(np.int32)), pa.array(open_)], names=["doc_id", "t", "first", "n", "anchor", "open"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            k, text, doc, t, place = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            done = (place & DONE) != 0
            if done.any():
                yield give(doc[done], t[done], place[done], np.zeros(done.sum(), bool))
                k, text, doc, t, place = (c[~done] for c in (k, text, doc, t, place))
                if not len(k):
                    continue
            new_k = np.concatenate([[last_k is None or k[0] != last_k], k[1:] != k[:-1]])
            new = new_k | np.concatenate([[last_run is None or text[0] != last_run], text[1:] != text[:-1]])
            spread = (place & WIDE) != 0
            group = np.cumsum(new_k)  # 0: goes on from the batch before
            kinds = np.bincount(group, weights=new, minlength=group[-1] + 1)
            wide = np.bincount(group, weights=spread, minlength=group[-1] + 1) > 0
            several = wide | (kinds > 1)
            if not new_k[0]:
                several[0] = many or wide[0] or kinds[0] > 0
                if pending is not None and several[0]:
                    yield give(*pending, np.array([True]))
                    pending = None
            elif pending is not None:
                pending = None
            out = ~new | several[group]
            if out.any():
                yield give(doc[out], t[out], place[out], new[out])
            last_k, last_run, many = k[-1], text[-1], bool(several[-1])
            if new_k.any() and not many:
                at = np.flatnonzero(new_k)[-1]
                pending = (doc[at : at + 1], t[at : at + 1], place[at : at + 1])

    return rows.repartition("k").sortWithinPartitions("k", "run", "doc_id", "t", "place").mapInArrow(run, RUNS)


OPEN = "k long, doc_id long, t long, first long, n int, bytes binary"


def open_texts(docs: DataFrame, open_runs: DataFrame) -> DataFrame:
    """Open runs with their bytes, keyed by anchor."""

    @tidy
    def run(batches):
        import zstandard

        z, hasher = zstandard.ZstdDecompressor(), Hasher()
        for b in batches:
            for i in range(b.num_rows):
                text = z.decompress(b.column(2)[i].as_py())
                places = np.array(b.column(3)[i].as_py(), np.int64)
                first, n, p = places >> 24, (places >> 8) & 0xFFF, places & 0xFF
                raw = np.frombuffer(text, np.uint8)
                ks = [int(hasher.grams(hasher.sums(raw[a : a + GRAM]))[0]) for a in (first + p).tolist()]
                parts = [text[a : a + m - 1 + DEPTH] for a, m in zip(first.tolist(), n.tolist(), strict=True)]
                size = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(ks, np.uint64).view(np.int64)), pa.array(np.full(size, b.column(0)[i].as_py())), pa.array(np.full(size, b.column(1)[i].as_py())), pa.array(first), pa.array(n.astype(np.int32)), pa.array(parts, pa.binary())],
                    names=["k", "doc_id", "t", "first", "n", "bytes"],
                )

    place = F.shiftleft("first", 24).bitwiseOR(F.shiftleft(F.col("n").cast("long"), 8)).bitwiseOR(F.col("anchor").cast("long"))
    lists = open_runs.groupBy("doc_id", "t").agg(F.collect_set(place).alias("places"))
    return packed(docs.select("doc_id", "t", "text")).join(lists, ["doc_id", "t"]).select("doc_id", "t", PACKED, "places").mapInArrow(run, OPEN)


PIECES = OPEN + ", lo int, hi int"  # of the windows' places of the anchor, the least and the most that a piece may have


def halved(rows: DataFrame) -> DataFrame:
    """PIECES cut in two by the place that the anchor has in a window, so each gives two rows at most.

    All windows of a half share the text around the anchor that the outermost of its places leave. It is the half's key: equal
    windows have equal places, so they stay together.
    """

    @tidy
    def run(batches):
        hasher = Hasher()
        for b in slices(batches, 1024):
            out: list[list] = [[] for _ in range(8)]
            for doc, t, first, n, x, lo, hi in zip(*(b.column(c).to_pylist() for c in range(1, 8)), strict=True):
                s = hasher.sums(np.frombuffer(x, np.uint8))
                at = int(np.argmin(hasher.grams(s)[: DEPTH - GRAM + 1]))
                mid = (lo + hi) // 2
                cut = min(n, max(0, at - mid))  # window j has the anchor at at - j
                for j, end, low, high in ((0, cut, mid + 1, hi), (cut, n, lo, mid)):
                    if j < end:
                        shared = hasher.of(s, np.array([at - low]), np.array([at - high + DEPTH])) ^ mix64(np.array([low * 128 + high]))
                        for col, v in zip(out, (shared.view(np.int64)[0], doc, t, first + j, end - j, x[j : end - 1 + DEPTH], low, high), strict=True):
                            col.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types, strict=True)], names=["k", "doc_id", "t", "first", "n", "bytes", "lo", "hi"])

    return rows.mapInArrow(run, PIECES)


def crowded_windows(rows: DataFrame) -> DataFrame:
    """Windows of runs that occur earlier, each as (doc_id, t, first, n = 1): all but the first place of each text.

    A window's places are summed to their least before they are shuffled, and all other places are found by
    their own position, so that no task holds the places of a window.
    """
    places = "doc_id long, t long, first long, w binary"

    @tidy
    def run(batches):
        for b in slices(batches, 256):
            out: list[list] = [[], [], [], []]
            for doc, t, first, n, x in zip(*(b.column(c).to_pylist() for c in range(1, 6)), strict=True):
                out[0] += [doc] * n
                out[1] += [t] * n
                out[2] += range(first, first + n)
                out[3] += [x[j : j + DEPTH] for j in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "t", "first", "w"])

    apart = rows.mapInArrow(run, places)
    at = ["doc_id", "t", "first"]
    firsts = apart.groupBy("w").agg(F.min(F.struct(*at)).alias("x")).select("x.*")
    return apart.select(*at).distinct().join(firsts.hint("merge"), at, "left_anti").withColumn("n", F.lit(1))


def radix(buf: np.ndarray, starts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit radix passes to DEPTH bytes: indexes of suffixes in groups of equal windows, and their groups."""
    digits = np.ndarray(len(buf) - 7, ">u8", buf.tobytes(), strides=(1,))
    alive = np.arange(len(starts))
    for at in [*range(0, DEPTH - 8, 8), DEPTH - 8]:
        d = digits[starts[alive] + at].astype(np.uint64)
        order = np.lexsort((d, group))
        d, g = d[order], group[order]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (g[1:] != g[:-1])]) if len(d) else np.empty(0, bool)
        ids = np.cumsum(new) - 1
        keep = (np.bincount(ids) > 1)[ids] if len(d) else new
        alive, group = alive[order][keep], ids[keep]
        if not len(alive):
            break
    return alive, group


def order_windows(rows: DataFrame, bundle: int = 4096) -> DataFrame:
    """Windows of open runs that occur earlier, as runs (doc_id, t, first, n)."""

    def judge(k, doc, t, first, n, parts):
        buf = np.frombuffer(b"".join(parts), np.uint8)
        size = np.array([len(x) for x in parts])
        base = np.cumsum(size) - size
        row = np.repeat(np.arange(len(k)), n)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        alive, group = radix(buf, base[row] + offset, np.unique(k, return_inverse=True)[1][row])
        r, start = row[alive], first[row[alive]] + offset[alive]
        order = np.lexsort((start, t[r], doc[r], group))
        r, start, g = r[order], start[order], group[order]
        lead = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.empty(0, bool)
        head = np.flatnonzero(lead)[np.cumsum(lead) - 1] if len(g) else np.empty(0, np.int64)
        later = (doc[r] != doc[r][head]) | (t[r] != t[r][head]) | (start != start[head])
        r, start = r[later], start[later]
        order = np.lexsort((start, t[r], doc[r]))
        d, tt, s = doc[r][order], t[r][order], start[order]
        cut = np.concatenate([[True], (d[1:] != d[:-1]) | (tt[1:] != tt[:-1]) | (s[1:] > s[:-1] + 1)]) if len(s) else np.empty(0, bool)
        a = np.flatnonzero(cut)
        z = np.concatenate([a[1:], [len(s)]]) - 1 if len(s) else a
        return pa.RecordBatch.from_arrays([pa.array(d[a]), pa.array(tt[a]), pa.array(s[a]), pa.array((s[z] - s[a] + 1).astype(np.int32))], names=["doc_id", "t", "first", "n"])

    @tidy
    def run(batches):
        held: list[pa.RecordBatch] = []
        count = 0

        def flush(tbl: pa.Table):
            cols = [tbl.column(i).to_numpy() for i in range(5)]
            return judge(*cols, tbl.column(5).to_pylist())

        for b in batches:
            held.append(b)
            count += b.num_rows
            if count < bundle:
                continue
            tbl = pa.Table.from_batches(held)
            k = tbl.column(0).to_numpy()
            ends = np.flatnonzero(k[1:] != k[:-1]) + 1
            if len(ends):  # whole groups only; the last may go on
                yield flush(tbl.slice(0, int(ends[-1])))
                tbl = tbl.slice(int(ends[-1]))
            held, count = tbl.to_batches(), tbl.num_rows
        if count:
            yield flush(pa.Table.from_batches(held))

    return rows.repartition("k").sortWithinPartitions("k").mapInArrow(run, "doc_id long, t long, first long, n int")


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with column T_, which tells texts of one doc_id apart; 0 where ids are unique, as they should be."""
    other = OWN + "twice"
    twice = stash(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(other)), "twice")
    if twice.isEmpty():
        return docs.withColumn(T_, F.lit(0).cast("long"))
    return docs.join(twice, F.col("doc_id") == F.col(other), "left").withColumn(T_, F.when(F.col(other).isNotNull(), F.xxhash64("text")).otherwise(F.lit(0)).cast("long")).drop(other)


def once(docs: DataFrame) -> DataFrame:
    """Each (doc_id, t, text) once; rows whose doc_id is unique (t is 0) aren't shuffled."""
    twins = stash(docs.where("t <> 0").dropDuplicates(["doc_id", "t"]), "twins")
    return docs if twins.isEmpty() else docs.where("t = 0").unionByName(twins)


def repeats(docs: DataFrame) -> DataFrame:
    """Runs of windows of (doc_id, t, text) that also start earlier: doc_id, t, first, n."""
    settled = stash(settle(anchors(docs)), "settled")
    found = settled.where("NOT open").select("doc_id", "t", "first", "n")
    at, width = ["doc_id", "t", "first"], DEPTH - GRAM + 1
    pieces = stash(open_texts(docs, settled.where("open")).withColumns({"lo": F.lit(0), "hi": F.lit(width - 1)}), "open")
    ordered = []
    while not (crowded := stash(pieces.groupBy("k").count().where(F.col("count") > GROUP).select("k"), "crowded")).isEmpty():
        hot = F.broadcast(crowded)  # at most pieces / GROUP keys
        ordered.append(pieces.join(hot, "k", "left_anti"))
        pieces = pieces.join(hot, "k", "left_semi")
        if width <= 2:
            found, pieces = found.unionByName(crowded_windows(stash(pieces, "crowded-runs"))), None
            break
        width = -(-width // 2)
        halves = stash(halved(pieces), "halves")
        # of equal halves all but the first repeat it; they meet as sums, and the others are found by their own position
        firsts = halves.groupBy("bytes").agg(F.min(F.struct(*at, "k", "n", "lo", "hi")).alias("x"))
        pieces = stash(firsts.select("x.*", "bytes").select(halves.columns), "pieces")
        found = found.unionByName(halves.select(*at, "n").join(pieces.select(*at).hint("merge"), at, "left_anti"))
    if pieces is not None:
        ordered.append(pieces)
    return found.unionByName(order_windows(functools.reduce(DataFrame.unionByName, ordered).drop("lo", "hi")))


def spans_of(runs_: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal removed spans [a, b) of runs (first start, starts)."""
    out: list[list[int]] = []
    for first, n in sorted(runs_):
        a, b = first, first + n - 1 + DEPTH
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with text cut, and with n_bytes, n_removed, n_spans and kept (the bytes left).

    Whole texts are taken as UTF-8 bytes, null as empty. A byte goes if a string of DEPTH bytes covers it that
    also starts earlier: in a smaller doc_id, or in the same text before. Overlaps count, and all is judged on
    the input. ``text`` is what is left, with characters cut in half dropped. Texts shorter than DEPTH stay.
    Of rows with one doc_id, equal texts are one document (each row is cut alike) and different texts
    are ordered by a hash. Rows with null doc_id stay whole. Empty input gives no rows. Columns of these
    names in the input are replaced, others kept.
    """
    own = ["n_bytes", "n_removed", "n_spans", "kept"]
    docs = keyed(docs.drop(*own))
    found = repeats(once(docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col(T_).alias("t"), "text")))
    lists = found.select("doc_id", F.col("t").alias(T_), "first", "n").groupBy("doc_id", T_).agg(F.collect_list(F.shiftleft("first", 24).bitwiseOR(F.shiftleft(F.col("n").cast("long"), 8))).alias(PLACES))
    rows = packed(docs).join(lists, ["doc_id", T_], "left")
    names = [c for c in docs.columns if c != T_]
    fields = {f.name: f for f in docs.schema.fields}

    @tidy
    def run(batches):
        import zstandard

        z = zstandard.ZstdDecompressor()
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            out: list[list] = [[], [], [], [], []]
            for x, places in zip(b.column(at[PACKED]), b.column(at[PLACES]).to_pylist(), strict=True):
                text = z.decompress(x.as_py())
                spans = spans_of([(p >> 24, (p >> 8) & 0xFFF) for p in places or ()])
                kept, end = [], 0
                for lo, hi in spans:
                    kept.append(text[end:lo])
                    end = hi
                kept = b"".join([*kept, text[end:]])
                for col, v in zip(out, (kept.decode("utf-8", "ignore"), len(text), len(text) - len(kept), len(spans), kept), strict=True):
                    col.append(v)
            mine = dict(zip(["text", *own], (pa.array(c, k) for c, k in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)), strict=True))
            yield pa.RecordBatch.from_arrays([mine[n] if n in mine else b.column(at[n]) for n in [*names, *own]], names=[*names, *own])

    schema = T.StructType([*(fields[n] for n in names), *(T.StructField(n, T.LongType()) for n in own[:3]), T.StructField("kept", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = """
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), d AS (
  SELECT DISTINCT doc_id, h, (len(h) // 2)::BIGINT AS n FROM t
), starts AS (
  SELECT doc_id, unnest(range(0, n - 99)) AS s, h FROM d WHERE n >= 100
), windows AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS r FROM (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS w FROM starts)
), later AS (
  SELECT doc_id, s, coalesce(s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) > 100, true) AS opens FROM windows WHERE r > 1
), numbered AS (
  SELECT doc_id, s, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM later
), spans AS (
  SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM numbered GROUP BY doc_id, g
), gaps AS (
  SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next_a, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS k FROM spans
), kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
    max(CASE WHEN k = 1 THEN substr(h, 1, 2 * a) END) || string_agg(substr(h, 2 * b + 1, 2 * (coalesce(next_a, n) - b)), '' ORDER BY a) AS left_hex
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(from_hex(coalesce(left_hex, h))) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""
