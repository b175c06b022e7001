"""N-gram Jaccard join: exact set similarity of word shingles by T-occurrence search (DivideSkip)."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import PACKED, drop_stash, i64, packed, salted_join, shingles, slices, stash, table, text_or_empty, tidy
from docmill.llm.components import components

#: Frequent shingles that move to the end of the global order: at most so many. They only shape the order.
FREQUENT = 1 << 20
BITS = 8  # words of 64 bits in a parity signature


def overlap_needed(n, m, num: int, den: int):
    """Least intersection of sets of n and m with Jaccard similarity num/den or more: ceil(num (n + m) / (num + den))."""
    return -((-num * (n + m)) // (num + den))


def frequent_shingles(docs: DataFrame, k: int, keep: int = FREQUENT) -> np.ndarray:
    """Hashes of shingles in many documents, most frequent last.

    Slices of 4096 documents count their shingles; what is in three documents of a slice or more is summed over all.
    The list is a bounded hint for the order of shingles: any order gives the same links, this one gives few
    candidates.
    """

    @tidy
    def run(batches):
        for b in slices(batches, 4096):
            sets = [shingles(x.as_buffer(), k) for x in b.column(0)]
            u, c = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_counts=True)
            often = c >= 3
            yield pa.RecordBatch.from_arrays([pa.array(i64(u[often])), pa.array(c[often].astype(np.int64))], names=["s", "n"])

    top = docs.select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where("n >= 8").orderBy(F.desc("n"), "s").limit(keep)
    found = top.toPandas()
    return found["s"].to_numpy(np.int64)[::-1].copy().view(np.uint64)


DIGEST = "doc_id long, n long, sig binary, mins array<long>, prefix array<long>, bits array<long>"


def digests(docs: DataFrame, frequent: np.ndarray, k: int, num: int, den: int, hashes: int = 4) -> DataFrame:
    """Of each document: set size, a digest of the whole set, min-hashes, the prefix in the global order, parity bits.

    Order: shingles that are not frequent by hash, then frequent ones, rarest first. The prefix is as long as a
    similar set of any size needs to share one shingle of it. Two sets' parity bits differ in no more places
    than the sets differ in shingles.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT
    import hashlib

    @tidy
    def run(batches):
        ranked = shared.value
        at = np.argsort(ranked)
        ordered = ranked[at]
        odd = np.random.default_rng(hashes).integers(0, 2**64, hashes + 1, dtype=np.uint64) | np.uint64(1)

        def place(s: np.ndarray) -> np.ndarray:
            """Rank among the frequent shingles, -1 for others."""
            if not len(ordered):
                return np.full(len(s), -1)
            pos = np.minimum(np.searchsorted(ordered, s), len(ordered) - 1)
            return np.where(ordered[pos] == s, at[pos], -1)

        def prefix(s: np.ndarray, length: int) -> np.ndarray:
            upto = 2 * length + 16
            while True:  # as far into the hash order as enough rare ones need
                ranks = place(s[:upto])
                rare = s[:upto][ranks < 0]
                if len(rare) >= length:
                    return rare[:length]
                if upto >= len(s):
                    return np.concatenate([rare, s[ranks >= 0][np.argsort(ranks[ranks >= 0])][: length - len(rare)]])
                upto *= 4

        for b in slices(batches, 1024):
            out: list[list] = [[] for _ in range(5)]
            for x in b.column(1):
                s = shingles(x.as_buffer(), k)
                n = len(s)
                out[0].append(n)
                out[1].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                out[2].append(i64(np.array([(s * o).min() for o in odd[1:]])) if n else [])
                out[3].append(i64(prefix(s, n - (num * n + den - 1) // den + 1)) if n else [])
                parity = np.bincount(((s * odd[0]) >> np.uint64(55)).astype(np.int64), minlength=64 * BITS) & 1
                out[4].append(np.packbits(parity.astype(np.uint8)).view(">i8").astype(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], longs), pa.array(out[3], longs), pa.array(out[4], longs)], names=["doc_id", "n", "sig", "mins", "prefix", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST)


def divide_skip(query: np.ndarray, sets: list[np.ndarray], needed: np.ndarray, mu: float = 0.01) -> np.ndarray:
    """T-occurrence search: indexes of the sets that share at least ``needed`` elements with the query.

    The sets are an inverted index: for each element, the list of sets with it. Of the query's lists the
    longest, as many as the least threshold allows, are set aside; the short ones are heap-merged into
    counts, and sets that can still reach their threshold are looked up in the long lists by binary search.
    """
    if not len(sets) or not len(query):
        return np.empty(0, np.int64)
    elements = np.concatenate(sets)
    order = np.argsort(elements, kind="stable")  # stable: each list is in order of sets
    elements, owner = elements[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
    lo, hi = np.searchsorted(elements, query), np.searchsorted(elements, query, "right")
    sizes = hi - lo
    least = max(1, int(needed.min()))
    long_count = max(0, min(least - 1, len(query), int(least / (mu * math.log2(max(2, int(sizes.max(initial=0)))) + 1))))
    by_size = np.argsort(sizes, kind="stable")
    short, long_ = by_size[: len(query) - long_count], by_size[len(query) - long_count :]
    counts = np.zeros(len(sets), np.int64)
    for c in heapq.merge(*(owner[lo[e] : hi[e]].tolist() for e in short if sizes[e])):
        counts[c] += 1
    alive = np.nonzero(counts >= needed - len(long_))[0]
    for e in long_:
        if not len(alive) or not sizes[e]:
            continue
        part = owner[lo[e] : hi[e]]
        counts[alive] += part[np.minimum(np.searchsorted(part, alive), len(part) - 1)] == alive
    return alive[counts[alive] >= needed[alive]]


def verify(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int, chunk: int = 256) -> DataFrame:
    """The pairs (a, b) of documents whose sets are similar, by T-occurrence search of each a among its b's.

    The b's of one a are searched in chunks of about ``chunk``, so that no a gathers all of them. Of rows with one
    doc_id each text counts, as a and as b. ``pairs`` is a stash.
    """
    involved = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()

    # the same kind of join whatever the size: texts go compressed to their pairs, and sets are made there
    known = packed(docs.select("doc_id", "text")).join(involved.hint("merge"), "doc_id", "left_semi")
    degrees = pairs.groupBy("a").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    dealt = salted_join(pairs, degrees, "a", "b").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"))
    asked = degrees.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")).select("a", F.col("a").alias("b"), "chunk")
    dealt = stash(dealt.unionByName(asked), "dealt")
    rows = salted_join(dealt, known.withColumnRenamed("doc_id", "b"), "b", "a", "chunk").select("a", "b", "chunk", PACKED)

    @tidy
    def search(batches):
        import zstandard

        z = zstandard.ZstdDecompressor()
        now, queries, ids, found = None, [], [], []

        def done():
            if not queries or not ids:
                return [], []
            n = np.array([len(s) for s in found], np.int64)
            hits = {ids[h] for q in queries for h in divide_skip(q, found, overlap_needed(len(q), n, num, den)).tolist()}
            return [now[0]] * len(hits), sorted(hits)

        for batch in batches:
            a_out, b_out = [], []
            for a, b, c, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if (a, c) != now:
                    x, y = done()
                    a_out += x
                    b_out += y
                    now, queries, ids, found = (a, c), [], [], []
                s = shingles(z.decompress(e.as_py()), k)
                if a == b:
                    queries.append(s)
                else:
                    ids.append(b)
                    found.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])
        x, y = done()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("a") != F.col("b"), "b").mapInArrow(search, "a long, b long")


def near_classes(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every document whose doc_id is not null.

    A document's set: distinct ``k``-word shingles of its whole text (words: runs without space, tab or line
    ends, A-Z lower-cased); one of fewer words has its whole sequence as one; without words or text it
    is empty and linked with nothing. Documents link at Jaccard similarity num/den or more; component_id
    is the smallest doc_id reachable. No link between different sets is lost:

    1. equal sets become one class, by a digest of the set, with its smallest id;
    2. min-hash stars: in each group of equal min-hashes, members are checked against the smallest id;
       the links found join most of what is near, in as many checks as members;
    3. prefix filter: two similar sets share a shingle in their prefixes (shorter for the smaller set), at places that leave
       the overlap possible. Only pairs of different components so far are formed, where a prefix
       shingle is held by several components; sizes, places and parity signatures drop most unformed.

    Candidates of 2 and 3 are checked exactly by ``verify``. Shingles are 64-bit hashes. Rows with the same
    doc_id and different texts are one node with the links of either. Empty input gives no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", text_or_empty().alias("text")).where(F.col("doc_id").isNotNull())
    frequent = frequent_shingles(docs, k)
    used: list[DataFrame] = []

    def keep(df: DataFrame, what: str) -> DataFrame:
        used.append(stash(df, what))
        return used[-1]

    known = stash(digests(docs, frequent, k, num, den), "digests")
    classes = keep(known.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep")), "classes")
    equal = salted_join(known.where("n > 0").select("doc_id", "sig"), classes, "sig", "doc_id").select("doc_id", "rep")
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()

    # 2. one key tells a hash function and its minimum
    mins = known.where("n > 0").select("doc_id", "mins").join(reps, "doc_id", "left_semi").select("doc_id", F.posexplode("mins").alias("i", "h"))
    mins = keep(mins.select("doc_id", F.xxhash64("i", "h").alias("h")), "mins")
    hubs = mins.groupBy("h").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1").select("h", "a")
    stars = salted_join(mins, hubs, "h", "doc_id").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    links = keep(verify(keep(stars, "stars"), docs, k, num, den), "links")
    so_far = keep(components(links), "components")

    # 3. prefixes with the component so far
    reps = reps.join(so_far.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("c"))
    own = F.col("n") - F.ceil(F.lit(2 * num) * F.col("n") / F.lit(num + den)) + 1  # prefix of the smaller of two
    wide = keep(known.where("n > 0").select("doc_id", "n", "prefix", "bits").join(reps.hint("merge"), "doc_id").withColumn("own", own), "wide")
    p = wide.select("doc_id", "c", "own", F.posexplode("prefix").alias("pos", "s"))
    several = p.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(F.col("pos") < F.col("own")).alias("small")).where("lo <> hi AND small").select("s")
    p = p.select("doc_id", "pos", "s").join(several.hint("merge"), "s")
    p = keep(p.join(wide.select("doc_id", "n", "c", "own", *[F.col("bits")[i].alias(f"w{i}") for i in range(BITS)]), "doc_id"), "prefixes")
    # a size class is a factor den / num wide: a set meets those of its own class and of the next larger one
    size = F.log(F.col("n").cast("double")) / math.log(den / num)
    above, below = F.floor(size + 1e-9), F.floor(size - 1e-9) - 1
    x = p.where("pos < own").withColumn("g", F.floor(size)).alias("x")
    y = p.withColumn("g", F.explode(F.array_distinct(F.array(above, above - 1, below)))).alias("y")
    X, Y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    both = X("n") + Y("n")
    needed = F.ceil(F.lit(num) * both / F.lit(num + den))
    apart = sum((F.bit_count(X(f"w{i}").bitwiseXOR(Y(f"w{i}"))) for i in range(BITS)), F.lit(0))
    condition = (
        (X("s") == Y("s")) & (X("g") == Y("g")) & (X("c") != Y("c")) & ((X("n") < Y("n")) | ((X("n") == Y("n")) & (X("doc_id") < Y("doc_id"))))
        & (Y("n") * num <= X("n") * den) & (F.least(X("n") - X("pos"), Y("n") - Y("pos")) >= needed) & (apart <= both - 2 * needed)
    )
    pairs = x.join(y, condition).select(X("doc_id").alias("a"), Y("doc_id").alias("b")).distinct()
    more = verify(keep(pairs, "pairs"), docs, k, num, den)
    final = components(so_far.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more).unionByName(equal.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b")))
    for old in used:  # the result reads the digests and the last components only
        drop_stash(old)
    return known.select("doc_id", F.col("n").alias("n_shingles")).join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) END AS s FROM w
), e AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 90 * greatest(a.n, b.n) <= 100 * least(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), both_ways AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT DISTINCT a AS id, a AS other FROM both_ways UNION SELECT r.id, l.b FROM reach r JOIN both_ways l ON r.other = l.a
), least_id AS (
  SELECT id, min(other) AS component FROM reach GROUP BY id
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component, doc_id)::BIGINT AS component_id FROM sets LEFT JOIN least_id ON id = doc_id
"""
