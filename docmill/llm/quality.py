"""Quality classifier: hashed word and character n-gram vectors, averaged, under a softmax; trained by SGD in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import mix64, stash, table, word_hashes
from docmill.llm.language_id import held_out

#: Bounds of the fitted sample: rows of each label, characters of a row (longer ones are not in the sample), characters in all.
ROWS, LONGEST, SAMPLE_CHARS = 1500, 200_000, 32_000_000
BUCKETS, DIM, SHORT, LONG = 1 << 16, 16, 3, 5
SEED = np.uint64(0x51ED270B)


_STEP, _SCATTER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def buckets(h: np.ndarray) -> np.ndarray:
    return ((h * _SCATTER) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def features(data: bytes, piece: int = 1 << 19):
    """Arrays of bucket numbers of a text's UTF-8 bytes, piece by piece, so that long texts need little besides.

    Each word (A-Z lower-cased); each pair of neighbours, where a word and itself are one feature whatever the
    word; each SHORT- to LONG-gram of characters as they are, with white space at its ends only.
    """
    h = word_hashes(data)[0]
    yield buckets(h)
    if len(h) > 1:
        yield buckets(np.where(h[:-1] == h[1:], SEED, mix64(h[:-1] * np.uint64(3) ^ h[1:])))
    raw = np.frombuffer(data, np.uint8)

    def edge(at: int) -> int:
        """The first start of a character from byte ``at`` on."""
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        return min(at, len(raw))

    lo = 0
    while lo < len(raw):
        hi = edge(lo + piece)
        own = len(bytes(raw[lo:hi]).decode("utf-8", "replace"))
        # a piece looks LONG - 1 characters into the next one
        chars = np.frombuffer(bytes(raw[lo : edge(hi + 4 * LONG)]).decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4")[: own + LONG - 1]
        lo = hi
        space = (chars == 32) | ((chars >= 9) & (chars <= 13))
        v = np.where(space, 32, chars).astype(np.uint64)
        seen = np.cumsum(space)
        g = v
        for n in range(2, LONG + 1):
            if len(v) < n:
                break
            g = g[: len(v) - n + 1] * _STEP + v[n - 1 :]
            if n >= SHORT:
                inner = seen[n - 2 : len(seen) - 1] == seen[: len(v) - n + 1]
                yield buckets(g[:own][inner[:own]])


class Model:
    """Vectors of the buckets and a softmax over their mean; used folded to one number a bucket."""

    def __init__(self, vectors: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.vectors, self.out, self.bias = vectors, out, bias
        self.weight = (vectors @ (out[1] - out[0])).astype(np.float64)
        self.base = float(bias[1] - bias[0])

    def score(self, data: bytes) -> float:
        total, count = 0.0, 0
        for ids in features(data):
            total += float(self.weight[ids].sum())
            count += len(ids)
        return float(1 / (1 + np.exp(-np.clip(self.base + total / max(1, count), -40, 40))))


def train(texts: list[str], labels: list[int], epochs: int = 8, rate: float = 4.0, seed: int = 7) -> Model:
    """Stochastic gradient descent over single documents; classes weigh alike."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    bags = []
    for t in texts:
        ids = np.concatenate(list(features(t.encode("utf-8", "replace"))))
        u, c = np.unique(ids, return_counts=True)
        bags.append((u, (c / max(1, c.sum())).astype(np.float32)))
    y = np.array(labels, np.int64)
    share = np.bincount(y, minlength=2) / max(1, len(y))
    weigh = np.array([0.5 / s if s else 0 for s in share], np.float32)
    steps, k = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            lr = rate * (1 - k / steps)
            k += 1
            u, c = bags[i]
            hidden = c @ vectors[u] if len(u) else np.zeros(DIM, np.float32)
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            g = p.copy()
            g[y[i]] -= 1
            g *= weigh[y[i]] * lr
            back = g @ out
            out -= np.outer(g, hidden)
            bias -= 0.1 * g
            if len(u):
                vectors[u] -= np.outer(c, back)
    return Model(vectors, out, bias)


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> tuple[list[str], list[int]]:
    """A bounded hash-random sample of labelled texts.

    ``rows`` ids of each label (of an id with several, the larger counts) by hash, of which rows with more than LONGEST
    characters or without id stay out; and SAMPLE_CHARS characters in all, rows that no longer fit being passed
    over. So at most 2 * rows rows reach the driver. Ties go by id and text.
    """
    key = F.xxhash64("doc_id")
    y = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("y"))
    picked = None
    for v in (0, 1):
        part = y.where(F.col("y") == v).orderBy(key, "doc_id").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    ids = {r["doc_id"]: r["y"] for r in picked.collect()}  # at most 2 * rows small rows
    found = docs.where(F.col("doc_id").isin(list(ids)) & (F.length(F.coalesce("text", F.lit(""))) <= LONGEST)) if ids else docs.where(F.lit(False))
    found = stash(found.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "quality-sample")
    texts, ys, size = [], [], 0
    for r in found.orderBy(key, "doc_id", "text").limit(2 * rows).toLocalIterator():
        if size + len(r["text"]) <= SAMPLE_CHARS:
            size += len(r["text"])
            texts.append(r["text"])
            ys.append(int(ids[r["doc_id"]]))
    return texts, ys


def score(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (higher: label 1 likelier) and predicted (score >= cut) of every whole text.

    Null and empty texts get the score of a document without features. Repeated rows score alike; a null id is held out. Empty input
    gives no rows; other columns are ignored. Without labelled rows the model is the even one: 0.5 for all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        model = shared.value
        for b in batches:
            s = [model.score(x.as_buffer() if x.is_valid else b"") for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= cut) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(*sample(docs.where(~held_out()), labels.where(~held_out()).select("doc_id", "quality")))
    return score(docs, model)
