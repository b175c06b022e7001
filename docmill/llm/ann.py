"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.llm.common import salted_join, slices, stash, table


def usable(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """vec_id and embedding of the vectors that take part: none null or empty, no null or non-finite component; not zero if so asked."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    keep = e.isNotNull() & (F.size(e) > 0) & ~bad
    if nonzero:
        keep = keep & F.exists(e, lambda x: x != 0)
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.coalesce(keep, F.lit(False)))


def matrix(column: pa.Array, dtype) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def hadamard(a: np.ndarray) -> np.ndarray:
    """Rows times the normalised Hadamard matrix, by the fast transform."""
    n, h = a.shape[1], 1
    while h < n:
        b = a.reshape(len(a), -1, 2, h)
        a = np.stack([b[:, :, 0] + b[:, :, 1], b[:, :, 0] - b[:, :, 1]], 2).reshape(len(a), n)
        h *= 2
    return a / np.sqrt(n)


class Hash:
    """Codes of vectors in ``tables`` tables of ``hashes`` concatenated cross-polytope hashes.

    A hash is the signed axis nearest to a vector after a pseudo-rotation of its own (three rounds of random
    signs and a Hadamard transform). A cell of a table is a combination of ``hashes`` axes.
    """

    def __init__(self, dim: int, tables: int, hashes: int, seed: int):
        self.width = 1 << max(1, (dim - 1).bit_length())
        self.axes, self.tables, self.hashes = 2 * self.width, tables, hashes
        self.signs = np.random.default_rng([seed, self.width]).choice([-1.0, 1.0], (tables, hashes, 3, self.width))

    def values(self, x: np.ndarray, t: int) -> np.ndarray:
        """Of each row its coordinates along the signed axes of each hash of table t."""
        y = np.zeros((len(x), self.width))
        y[:, : x.shape[1]] = x
        out = np.empty((len(x), self.hashes, self.axes))
        for h in range(self.hashes):
            z = y
            for signs in self.signs[t, h]:
                z = hadamard(z * signs)
            out[:, h, : self.width], out[:, h, self.width :] = z, -z
        return out

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Cells of the rows in each table."""
        weights = self.axes ** np.arange(self.hashes - 1, -1, -1)
        return np.stack([self.values(x, t).argmax(2) @ weights for t in range(self.tables)], 1)

    def probes(self, values: np.ndarray, n: int) -> tuple[np.ndarray, float]:
        """The ``n`` cells with the largest sums of coordinates for one query, and the least of these sums."""
        cells, sums = np.zeros(1, np.int64), np.zeros(1)
        for v in values:  # the best n of a combination start with the best n of its beginning
            near = np.argsort(-v, kind="stable")[:n]
            cells = (cells[:, None] * self.axes + near).ravel()
            sums = (sums[:, None] + v[near]).ravel()
            if len(sums) > n:
                best = np.argpartition(-sums, n - 1)[:n]
                cells, sums = cells[best], sums[best]
        return cells, float(sums.min())

    def sums(self, values: np.ndarray, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The sum of coordinates of each (row, cell)."""
        total, left = np.zeros(len(rows)), cells
        for h in range(self.hashes - 1, -1, -1):
            total += values[rows, h, left % self.axes]
            left = left // self.axes
        return total


def probe_count(n: int, cells: int, most: float = 1600.0, at: int = 500, power: float = 0.35) -> int:
    """Cells that a query looks in, of a table's 2 ** 14 (in proportion for others), over n vectors.

    The more vectors, the nearer a query's neighbours, so the share falls with n ** -power: the work of a query grows by
    n ** (1 - power). The constants come from brute-force recall on isotropic vectors; see README.
    """
    return int(min(cells, max(1, round(most * cells / 2**14 * (at / max(at, n)) ** power))))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = 8, hashes: int = 2, probes: int | None = None, block: int = 8192, query_block: int = 16384, seed: int = 11) -> DataFrame:
    """The ``k`` largest inner products found for each query: query_id, rank, vec_id, score.

    ``vectors`` and ``queries`` have vec_id and embedding; a query's own vec_id is no candidate of it. A
    table's cells are combinations of ``hashes`` signed axes nearest after pseudo-rotations; a query looks in
    the ``probes`` cells with the largest sums of coordinates in each of ``tables`` tables (default:
    ``probe_count``). A pair that several tables offer is scored in the first of them only; candidates are
    reranked by exact inner products of the original vectors in double precision. Recall and share of
    candidates on isotropic vectors of 64 dimensions, the hardest kind, are in README.

    Equal vectors are one class in the search, so copies never meet each other; classes are spread out again
    into their smallest k + 1 ids. Neighbouring cells share tasks; crowded ones are searched in blocks, every
    block in full, so no cell is capped. Vectors that are null, empty, zero or hold null or non-finite components take no part; nor
    do null ids. Of rows with one vec_id and one vector, one counts. Only vectors of one dimension are
    compared. Ties go to the smaller vec_id. Empty input gives no rows; other columns are ignored.
    """
    pairs = candidates(vectors, queries, k, tables, hashes, probes, block, query_block, seed)
    found, members, asked = pairs["found"], pairs["members"], pairs["asked"]
    # a pair may come twice (by rounding at the edge of a probe), with one score: rank different ones
    near = Window.partitionBy("q").orderBy(F.desc("score"), "cls")
    found = found.withColumn("r", F.dense_rank().over(near)).where(F.col("r") <= k + 1).select("q", "cls", "score").distinct()
    spread = salted_join(stash(found, "ann-found"), members.groupBy("cls").agg(F.collect_list("vec_id").alias("ids")), "cls", "q")  # at most k + 1 ids a class
    near = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    spread = spread.select("q", "score", F.explode("ids").alias("vec_id")).withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1)
    spread = spread.groupBy("q").agg(F.collect_list(F.struct("vec_id", "score")).alias("near"))  # at most k + 1
    each = salted_join(asked, spread, "q", "query_id").select("query_id", F.explode("near").alias("x")).select("query_id", "x.vec_id", "x.score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.where(F.col("vec_id") != F.col("query_id")).select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def candidates(vectors: DataFrame, queries: DataFrame, k: int, tables: int, hashes: int, probes: int | None, block: int, query_block: int, seed: int) -> dict[str, DataFrame]:
    """found: (q, cls, score, scored), the k + 1 best of each query class in each group of cells, scored is the group's number of scored pairs; members: (cls, vec_id); asked: (query_id, q)."""
    double = dict(vectors.dtypes)["embedding"] == "array<double>"
    dtype = "<f8" if double else "<f4"

    def packed(df):
        def run(batches):
            for b in batches:
                rows = [np.array(x.as_py(), dtype).tobytes() for x in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["vec_id", "vec"])

        return usable(df, True).mapInArrow(run, "vec_id long, vec binary")

    order = Window.partitionBy("vec").orderBy("vec_id")
    # a class of copies keeps its k + 1 smallest ids: no query can be answered with more of one class
    members = packed(vectors).distinct().select("*", F.row_number().over(order).alias("n")).where(F.col("n") <= k + 1)
    least = packed(vectors).groupBy("vec").agg(F.min("vec_id").alias("cls"))
    classes = stash(least.select("cls", "vec"), "ann-classes")
    members = stash(members.select("vec_id", "vec").join(classes, "vec").select("cls", "vec_id"), "ann-members")
    asked = stash(packed(queries).distinct().withColumnRenamed("vec_id", "query_id"), "ann-queries")
    # queries that are no candidates themselves are a class under a negative mark
    firsts = asked.groupBy("vec").agg(F.min("query_id").alias("lead")).join(classes.withColumnRenamed("cls", "q"), "vec", "left")
    firsts = stash(firsts.select("vec", F.coalesce("q", -F.lit(2) - F.abs("lead")).alias("q")), "ann-firsts")
    asked = stash(salted_join(asked, firsts, "vec", "query_id").select("query_id", "q"), "ann-asked")

    def norms(batches):
        for b in batches:
            n = [float(np.linalg.norm(np.frombuffer(x.as_py(), dtype).astype(float))) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([max(n, default=0.0)]), pa.array([min(n, default=np.inf)]), pa.array([len(n)])], names=["most", "least", "n"])

    most, shortest, n = classes.select("vec").mapInArrow(norms, "most double, least double, n long").agg(F.max("most"), F.min("least"), F.sum("n")).first()
    most, shortest, n = most or 1.0, shortest or 1.0, n or 0
    lift = shortest < most * (1 - 1e-5)

    def unit(raw: list[bytes], asks: bool) -> np.ndarray:
        """Vectors over the largest length. Where lengths differ, one more coordinate brings each to length 1, so that the nearest direction is the largest inner product; queries have 0 there."""
        x = np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(float)
        lengths = np.linalg.norm(x, axis=1)[:, None]
        y = x / (lengths if asks else most)
        if not lift:
            return y
        return np.concatenate([y, np.zeros_like(lengths) if asks else np.sqrt(np.maximum(0, 1 - (lengths / most) ** 2))], 1)

    def by_size(raw: list[bytes]):
        sizes: dict[int, list[int]] = {}
        for i, v in enumerate(raw):
            sizes.setdefault(len(v), []).append(i)
        for size, at in sizes.items():
            yield Hash(size // np.dtype(dtype).itemsize + lift, tables, hashes, seed), np.array(at), [raw[i] for i in at]

    def shares(h: Hash) -> int:
        """Groups of neighbouring cells in a table, 16 at least, each of about ``block`` vectors at most."""
        return int(min(h.axes**h.hashes, max(16, -(-n // block))))

    def group(h: Hash, size: int, t, cells):
        return (np.int64(size) << 40) + (np.int64(t) << 32) + cells * shares(h) // h.axes**h.hashes

    def place(batches):
        for b in batches:
            for part in slices([b], 4096):
                for h, at, raw in by_size(part.column(1).to_pylist()):
                    codes = h.codes(unit(raw, False))
                    rows = part.take(pa.array(at))
                    told = pa.array([c.astype("<i8").tobytes() for c in codes], pa.binary())
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays([pa.array(group(h, len(raw[0]), t, codes[:, t])), *rows.columns, told], names=["cell", "id", "vec", "codes"])

    def ask(batches):
        for b in batches:
            for part in slices([b], 512):
                for h, at, raw in by_size(part.column(1).to_pylist()):
                    x, ids = unit(raw, True), part.column(0).take(pa.array(at)).to_pylist()
                    wanted = probes or probe_count(n, h.axes**h.hashes)
                    found = [[h.probes(v, wanted) for v in h.values(x, t)] for t in range(tables)]
                    for i, v in enumerate(raw):
                        edges = np.array([found[t][i][1] for t in range(tables)], "<f8").tobytes()
                        out: list[list] = [[], []]
                        for t in range(tables):
                            cells = np.sort(found[t][i][0])
                            g = group(h, len(v), t, cells)
                            cut = np.flatnonzero(np.diff(g)) + 1
                            out[0] += g[np.concatenate([[0], cut])].tolist()
                            out[1] += [c.astype("<i8").tobytes() for c in np.split(cells, cut)]
                        size = len(out[0])
                        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array([ids[i]] * size, pa.int64()), pa.array([v] * size, pa.binary()), pa.array(out[1], pa.binary()), pa.array([edges] * size, pa.binary())], names=["cell", "id", "vec", "cells", "edges"])

    entries = classes.select(F.col("cls").alias("id"), "vec").mapInArrow(place, "cell long, id long, vec binary, codes binary")
    probed = firsts.select(F.col("q").alias("id"), "vec").mapInArrow(ask, "cell long, id long, vec binary, cells binary, edges binary")
    # a group's numbers of blocks
    n_blocks = entries.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("cb"))
    q_blocks = probed.groupBy("cell").agg(F.ceil(F.count("*") / query_block).alias("qb"))
    plan = stash(n_blocks.join(q_blocks, "cell"), "ann-plan")

    def dealt(df, own, other):
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("long")
        d = df.join(plan, "cell").withColumns({own + "_": mine, other + "_": F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))}).drop("cb", "qb")
        return d.groupBy("cell", "cb_", "qb_")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"q": pd.Series(dtype="int64"), "cls": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "scored": pd.Series(dtype="int64")})
        if left.empty or right.empty:
            return none
        key = int(left["cell"].iloc[0])
        t = key >> 32 & 0xFF
        h = Hash((key >> 40) // np.dtype(dtype).itemsize + lift, tables, hashes, seed)
        v = np.frombuffer(b"".join(left["vec"]), dtype).reshape(len(left), -1).astype(float)
        u = np.frombuffer(b"".join(right["vec"]), dtype).reshape(len(right), -1).astype(float)
        codes = np.frombuffer(b"".join(left["codes"]), "<i8").reshape(len(left), tables)
        edges = np.frombuffer(b"".join(right["edges"]), "<f8").reshape(len(right), tables)
        ids, qs = left["id"].to_numpy(), right["id"].to_numpy()
        by_cell = np.argsort(codes[:, t], kind="stable")
        cells = codes[by_cell, t]
        sizes = [len(c) // 8 for c in right["cells"]]
        looked = np.frombuffer(b"".join(right["cells"]), "<i8")
        lo, n_ = np.searchsorted(cells, looked), np.searchsorted(cells, looked, "right")
        n_ -= lo
        asks = np.repeat(np.arange(len(right)), sizes)
        keep = n_ > 0
        lo, n_, asks = lo[keep], n_[keep], asks[keep]
        # earlier tables' coordinates, for the pairs that they offer already
        x = unit(list(right["vec"]), True)
        before = [h.values(x, s) for s in range(t)]
        ends = np.searchsorted(asks, np.arange(len(right) + 1))
        total = np.concatenate([[0], np.cumsum(n_)])
        out, first = [], 0
        while first < len(right):  # whole queries, about 2 ** 16 pairs at a time
            last = first + 1
            while last < len(right) and total[ends[last + 1]] - total[ends[first]] <= 1 << 16:
                last += 1
            a, b = ends[first], ends[last]
            first = last
            i = np.repeat(asks[a:b], n_[a:b])
            j = by_cell[np.repeat(lo[a:b] - (total[a:b] - total[a]), n_[a:b]) + np.arange(len(i))]
            for s in range(t):
                new = h.sums(before[s], i, codes[j, s]) < edges[i, s] - 1e-9
                i, j = i[new], j[new]
            if not len(i):
                continue
            score = (u[i] * v[j]).sum(1)
            at = np.lexsort((ids[j], -score, i))
            si = i[at]
            top = np.arange(len(at)) - np.searchsorted(si, si) <= k
            at = at[top]
            out.append(pd.DataFrame({"q": qs[i[at]], "cls": ids[j[at]], "score": score[at], "scored": np.where(np.arange(len(at)) == 0, len(i), 0)}))
        return pd.concat(out) if out else none

    found = dealt(entries, "cb", "qb").cogroup(dealt(probed, "qb", "cb")).applyInPandas(best, "q long, cls long, score double, scored long")
    return {"found": found, "members": members, "asked": asked}


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(v, v.where(F.col("vec_id") % 20 == 0))
