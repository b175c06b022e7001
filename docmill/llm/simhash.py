"""SimHash near-duplicates: bit planes compared with carry-save counters, blocks abandoned once all exceed the radius."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import OWN, hot_share, i64, salted_join, slices, stash, table, tidy
from docmill.llm.components import components

SEED = 42
CELLS = 1 << 17  # pairs of a fingerprint and 64 others that are counted at a time
ROWS = 1 << 16  # fingerprints that one pass over bit planes holds, besides those of the group that is open
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(data: bytes, k: int = 4, piece: int = 1 << 16) -> int:
    """64-bit SimHash of UTF-8 bytes: a bit is 1 if set in over half the hashes of the k-word shingles, repeats included.

    A-Z are lower-cased, words go by ASCII white space and are joined by blanks. Fewer than k words: one shingle of
    them all; none: 0.
    """
    import xxhash

    words = data.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    k = min(k, len(words))
    a, b = (end - size)[: len(words) - k + 1], end[k - 1 :]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, len(a), piece):
        h = np.array([digest(whole[i:j], SEED) for i, j in zip(a[lo : lo + piece].tolist(), b[lo : lo + piece].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(a)).tolist()))


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id and fp (64 bits as a signed long) of each whole text; null text counts as empty, whose fp is 0. OWN + row deals equal rows out."""

    @tidy
    def run(batches):
        n = 0
        for b in slices(batches, 1024):
            fps = np.array([fingerprint(x.as_buffer().to_pybytes(), k) if x.is_valid else 0 for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(i64(fps)), pa.array(np.arange(n, n + len(fps)))], names=["doc_id", "fp", OWN + "row"])
            n += len(fps)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, fp long, {OWN}row long")


def layout(n: int, radius: int) -> list[int]:
    """Masks of the tables: fingerprints within the radius agree in all masked bits of one table at least.

    The 64 bits are cut into b blocks; ``radius`` differing bits leave b - radius of them alone, and each choice of
    so many is a table. b grows with the number of fingerprints, so that a table's key keeps the rows that share it few.
    """

    def work(b: int) -> float:
        return math.comb(b, radius) * (1 + n / 64 / 2.0 ** ((b - radius) * (64 // b)))

    b = min(range(radius + 1, min(64, radius + 12) + 1), key=work)
    edges = np.linspace(0, 64, b + 1).astype(int)
    blocks = [((1 << int(hi - lo)) - 1) << int(lo) for lo, hi in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(blocks, b - radius)]


def _above(c: tuple[np.ndarray, ...], radius: int) -> np.ndarray:
    """Lanes whose counter of three bits is over the radius."""
    more, equal = np.zeros_like(c[0]), np.full_like(c[0], _ALL)
    for bit, x in ((4, c[2]), (2, c[1]), (1, c[0])):
        if radius & bit:
            equal &= x
        else:
            more |= equal & x
            equal &= ~x
    return more


def _full(a, b, c):
    """Carry-save adder: sum and carry of three bits a lane."""
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def near_in(fp: np.ndarray, start: np.ndarray, size: np.ndarray, cross: np.ndarray, radius: int) -> np.ndarray:
    """Of each fingerprint, the first of those that near ones tie it to within its group, as its place in ``fp``.

    Group g is the size[g] rows from start[g]. Where cross[g] is 0, its rows are compared with each other, else the
    first cross[g] with the rest. Each group's fingerprints are turned into 64 bit planes, 64 fingerprints a
    word. A row is compared with 64 others at a time: differing bits of seven planes are summed by carry-save adders into
    three-bit counters, and words without a lane within the radius are left out of the next planes.
    """
    if not 0 < radius < 7:
        raise ValueError("radius must be 1 to 6")
    group = np.repeat(np.arange(len(start)), size)
    word0 = np.concatenate([[0], np.cumsum((size + 63) // 64)])
    rank = np.arange(len(fp)) - start[group]
    place = word0[group] * 64 + rank
    words = int(word0[-1])
    lanes = np.zeros(words * 64, np.uint64)
    lanes[place] = fp
    row_at = np.full(words * 64, -1)
    row_at[place] = np.arange(len(fp))
    grid = lanes.reshape(words, 64)
    planes = [np.packbits(((grid >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64) for b in range(64)]
    used = np.packbits(row_at.reshape(words, 64) >= 0, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)

    crossed = cross[group] > 0
    first = np.where(crossed, cross[group], rank + 1)  # lane in its group from which a row is compared
    asks = (first < size[group]) & ~(crossed & (rank >= cross[group]))
    w_lo, w_hi = word0[group] + first // 64, word0[group + 1]
    cells = np.where(asks, w_hi - w_lo, 0)
    upto = np.cumsum(cells)
    label = np.arange(len(fp))
    lo = 0
    while lo < len(fp):
        hi = int(max(lo + 1, np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CELLS)))
        n = cells[lo:hi]
        if n.sum():
            row = np.repeat(np.arange(lo, hi), n)
            word = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + w_lo[row]
            live = used[word].copy()
            cut = word == w_lo[row]
            live[cut] &= _ALL << (first[row[cut]] % 64).astype(np.uint64)
            a, b = _close(fp, planes, row, word, live, row_at, radius)
            _unite(label, a, b)
        lo = hi
    return label


def _close(fp, planes, row, word, live, row_at, radius) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within the radius: of each cell (row, word), the lanes of ``live`` that no counter takes over it."""
    counter = tuple(np.zeros(len(row), np.uint64) for _ in range(3))
    nothing = np.uint64(0)
    for b in range(0, 64, 7):
        own = fp[row]
        x = [planes[i][word] ^ (nothing - ((own >> np.uint64(i)) & np.uint64(1))) if i < 64 else np.zeros(len(row), np.uint64) for i in range(b, b + 7)]
        s, k1 = _full(x[0], x[1], x[2])
        s, k2 = _full(s, x[3], x[4])
        s, k3 = _full(s, x[5], x[6])
        t, u = _full(k1, k2, k3)
        c0, carry = counter[0] ^ s, counter[0] & s
        c1, carry = _full(counter[1], t, carry)
        c2, over = _full(counter[2], u, carry)
        live &= ~(over | _above((c0, c1, c2), radius))
        stay = np.flatnonzero(live)
        row, word, live = row[stay], word[stay], live[stay]
        counter = (c0[stay], c1[stay], c2[stay])
        if not len(row):
            break
    at, lane = np.nonzero(np.unpackbits(live.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64))
    return row[at], row_at[word[at] * 64 + lane]


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Let rows that pairs (a, b) tie together share the least label: hook, then shorten, until nothing is left."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            shorter = label[label]
            if (shorter == label).all():
                break
            label[:] = shorter


def near_edges(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) that tie together just what links of distinct fingerprints (column fp) at ``radius`` or fewer differing bits do.

    Rows meet by the masked bits of each table (see :func:`layout`). Keys that many rows share are dealt to pairs of parts,
    each pair one group, so that no task holds more than a bounded number of rows. A group gives an edge a row at
    most, however many links it finds.
    """
    n = fps.count()
    masks = layout(n, radius)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")).alias("key")) for t, m in enumerate(masks)])).alias("e")).select("fp", "e.t", "e.key")
    share = hot_share(n * len(masks), 4096)
    parts, hot_key = OWN + "parts", OWN + "key"
    hot = keyed.groupBy("t", "key").count().where(F.col("count") > share)
    hot = F.broadcast(stash(hot.select(F.struct("t", "key").alias(hot_key), F.ceil(F.col("count") / share).cast("int").alias(parts)), "hot"))  # at most 4096 keys
    p = F.coalesce(F.col(parts), F.lit(1))
    dealt = keyed.join(hot, F.struct("t", "key") == F.col(hot_key), "left").select("fp", "t", "key", p.alias("p"), F.pmod(F.xxhash64("fp"), p).cast("int").alias("mine"))
    both = dealt.select("fp", "t", "key", "mine", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("other"))
    grouped = both.select("t", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "fp")
    order = ["t", "key", "i", "j", "side"]

    @tidy
    def run(batches):
        held: list[np.ndarray] = []

        def edges(rows: np.ndarray, last: bool):
            """Edges of the whole groups of rows, and the rows of the group that may go on."""
            g = np.flatnonzero(np.r_[True, (rows[1:, :4] != rows[:-1, :4]).any(1)]) if len(rows) else np.empty(0, np.int64)
            end = len(rows) if last or not len(g) else int(g[-1])
            rest, rows, g = rows[end:], rows[:end], g[g < end]
            if not len(rows):
                return None, rest
            size = np.diff(np.r_[g, len(rows)])
            cross = np.where(rows[g, 2] == rows[g, 3], 0, np.add.reduceat((rows[:, 4] == 0).astype(np.int64), g))
            none = (rows[g, 2] != rows[g, 3]) & ((cross == 0) | (cross == size))
            if none.any():  # parts that met nobody
                keep = np.repeat(~none, size)
                rows, size, cross = rows[keep], size[~none], cross[~none]
                g = np.cumsum(size) - size
            label = near_in(rows[:, 5].view(np.uint64).copy(), g, size, cross, radius) if len(rows) else np.empty(0, np.int64)
            tied = np.flatnonzero(label != np.arange(len(rows)))
            return pa.RecordBatch.from_arrays([pa.array(rows[tied, 5]), pa.array(rows[label[tied], 5])], names=["a", "b"]), rest

        for b in batches:
            held.append(np.column_stack([np.asarray(b.column(i)).astype(np.int64) for i in range(6)]))
            if sum(map(len, held)) >= ROWS:
                out, rest = edges(np.concatenate(held), False)
                held = [rest]
                if out is not None and out.num_rows:
                    yield out
        if held:
            out, _ = edges(np.concatenate(held), True)
            if out is not None and out.num_rows:
                yield out

    return grouped.repartition(*order[:4]).sortWithinPartitions(*order).mapInArrow(run, "a long, b long").distinct()


def near_components(prints: DataFrame, radius: int = 4) -> DataFrame:
    """doc_id, fp and component_id of rows with doc_id and fp, which must be a stash: the smallest doc_id that links reach, the row's own included.

    Equal fingerprints are one node. Rows without doc_id link as others do but name no component: where no row with
    one is reached, component_id is null. Repeated rows come out each. Empty input gives no rows.
    """
    nodes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    linked = components(near_edges(nodes.select("fp"), radius))
    of = nodes.join(linked.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    of = stash(of, "of")
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    each = stash(salted_join(of, least, "component", "fp").select("fp", "component_id"), "each")
    return salted_join(prints, each, "fp", OWN + "row").select("doc_id", "fp", "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have fingerprint zero and link with each other; null doc_id, repeated rows: see :func:`near_components`."""
    prints = stash(fingerprints(table(spark, sf_dir, "documents")), "prints")
    found = near_components(prints)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
