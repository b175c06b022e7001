"""Filter interaction audit: joint failures of all sets of filters, inverted to survivors, unique failures and Shapley values."""

from __future__ import annotations

import functools
import hashlib
import itertools
import operator
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import slices, stash, table, tidy

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
_UPPER = bytes(range(65, 91))
_MARKS = re.compile(rb"[#$%&*|]")


def text_flags(docs: DataFrame, min_words: int = 200, distinct: int = 50, upper: int = 2) -> DataFrame:
    """doc_id, part (the source; null: empty), a digest of the whole text, and what it fails of A to D as a bit mask, A lowest.

    A: under ``min_words`` words; B: distinct words under ``distinct`` percent of all; C: A to Z over ``upper``
    percent of the code points; D: a character of #$%&*|. Null text is empty.
    """

    @tidy
    def run(batches):
        for b in slices(batches, 2048):
            points = pc.fill_null(pc.utf8_length(b.column(2)), 0).to_numpy(zero_copy_only=False)
            digests, masks = [], np.zeros(b.num_rows, np.int32)
            for i, text in enumerate(b.column(2)):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                words = data.split()
                digests.append(hashlib.sha256(data).digest())
                big = len(data) - len(data.translate(None, _UPPER))
                masks[i] = (len(words) < min_words) | (100 * len(set(words)) < distinct * len(words)) << 1 | (100 * big > upper * int(points[i])) << 2 | bool(_MARKS.search(data)) << 3
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(masks)], names=["doc_id", "part", "digest", "mask"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text").mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask of failures of A to E, and how many documents: n, good, toxic.

    E: a smaller doc_id has the same text (by SHA-256), anywhere in the table; rows without doc_id never fail it, nor do others
    by them. A document is good (toxic) if a row of ``labels`` with its id says quality (toxic) 1. Equal rows are counted before
    anything is shuffled, so a text, an id or a part that a third of all rows share is a few rows. One text with all the
    parts and labels of its copies is then a few rows too, and its least id finds its way back to them.
    """
    rows = text_flags(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("toxic"))
    rows = stash(rows, "flags")
    named = rows.where("doc_id IS NOT NULL").join(said, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("good", "toxic")})
    # the documents at a group's least id are those that may be the first with their text
    groups = named.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"))
    groups = stash(groups, "groups")
    least = groups.groupBy("digest").agg(F.min("least").alias("first"))
    firsts = stash(named.join(least, (named["doc_id"] == least["first"]) & (named["digest"] == least["digest"])).groupBy(named["digest"], "part", "mask", "good", "toxic").agg(F.sum("n").alias("first_n")), "firsts")
    e = 1 << FILTERS.index("E")
    counted = groups.join(firsts, ["digest", "part", "mask", "good", "toxic"], "left").withColumn("first_n", F.coalesce("first_n", F.lit(0).cast("long")))
    split = counted.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("first_n").alias("n")), F.struct((F.col("mask") + e).alias("mask"), (F.col("n") - F.col("first_n")).alias("n")))).alias("s")).select("part", "good", "toxic", "s.mask", "s.n")
    nameless = rows.where("doc_id IS NULL").select("part", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"), "mask", "n")
    return split.unionByName(nameless).groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def joint_failures(counts: DataFrame) -> DataFrame:
    """Of each part, for n, good and toxic, an array by set of filters: rows that fail all of the set, summed as products of flags."""
    flag = [F.shiftright("mask", i).bitwiseAND(1) for i in range(len(FILTERS))]
    both = [functools.reduce(operator.mul, [flag[i] for i in range(len(FILTERS)) if s >> i & 1], F.lit(1)) for s in range(SETS)]
    sums = counts.groupBy("part").agg(*[F.sum(F.col(c) * both[s]).alias(f"{c}{s}") for c in ("n", "good", "toxic") for s in range(SETS)])
    return sums.select("part", *[F.array(*[F.col(f"{c}{s}") for s in range(SETS)]).alias(c) for c in ("n", "good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each part under each order of the five filters, step by step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    All come from the joint failures J of the 32 sets of filters by inclusion and exclusion. Survivors of a set T: the sum
    over its subsets S of (-1)^|S| J(S). Failures of just a set T: the sum over its supersets S of (-1)^|S - T| J(S).
    The game "removed by T" has the Harsanyi dividends (-1)^(|S| + 1) J(S), and a filter's Shapley value is its share
    1 / |S| of each; times 120 it is whole.

    Null texts and null sources are empty; a part is there if a row has it, so no rows give no rows. Repeated rows count each;
    rows of one doc_id with one text are not copies of each other. Other columns are not read. Null ids: see :func:`failure_counts`.
    """
    joint = joint_failures(failure_counts(docs, labels))
    filters, orders = len(FILTERS), ["".join(o) for o in itertools.permutations(FILTERS)]
    sets = f"sequence(0, {SETS - 1})"
    survivors = f"transform({sets}, t -> aggregate({sets}, 0L, (sum, s) -> sum + if(s & t = s, if(bit_count(s) % 2 = 0, 1, -1) * {{0}}[s], 0L)))"
    alone = f"transform(sequence(0, {filters - 1}), f -> aggregate({sets}, 0L, (sum, s) -> sum + if(getbit(s, f) = 1, if(bit_count(s) % 2 = 1, 1, -1) * n[s], 0L)))"
    shapley = f"transform(sequence(0, {filters - 1}), f -> aggregate({sets}, 0L, (sum, s) -> sum + if(getbit(s, f) = 1, if(bit_count(s) % 2 = 1, 1, -1) * ({len(orders)} div bit_count(s)) * n[s], 0L)))"
    parts = joint.select("part", *[F.expr(survivors.format(c)).alias(f"left_{c}") for c in ("n", "good", "toxic")], F.expr(alone).alias("alone"), F.expr(shapley).alias("shares"), F.expr(f"transform(sequence(0, {filters - 1}), f -> n[shiftleft(1, f)])").alias("fails"))
    ordered = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(filters))))
    steps = ordered.selectExpr("*", f"ascii(substr(filter_order, step, 1)) - {ord(FILTERS[0])} AS f", f"aggregate(sequence(1, step), 0, (m, k) -> m | shiftleft(1, ascii(substr(filter_order, k, 1)) - {ord(FILTERS[0])})) AS after").selectExpr("*", "after ^ shiftleft(1, f) AS before")
    lost = "left_{0}[before] - left_{0}[after]"
    return steps.selectExpr(
        "part",
        "filter_order",
        "step",
        "left_n[after] AS kept",
        f"{lost.format('n')} AS removed",
        f"fails[f] - ({lost.format('n')}) AS redundant",
        "alone[f] AS unique_fails",
        f"{lost.format('good')} AS good_lost",
        f"{lost.format('toxic')} AS toxic_lost",
        "shares[f] AS shapley",
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), first AS (
  SELECT text, min(doc_id) AS least FROM d GROUP BY text
), flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN d.doc_id > least THEN 'E' ELSE '' END) AS fails
  FROM d JOIN first USING (text) LEFT JOIN l ON d.doc_id = l.doc_id
), alike AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders
), met AS (  -- the step at which each kind of document goes, 9 if it stays
  SELECT alike.*, filter_order, list_min(list_transform(['A', 'B', 'C', 'D', 'E'], lambda x: CASE WHEN contains(fails, x) THEN instr(filter_order, x) ELSE 9 END)) AS gone FROM alike, orders
), counted AS (
  SELECT part, filter_order, step,
    sum(CASE WHEN gone > step THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN gone < step AND contains(fails, filter_order[step]) THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = filter_order[step] THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN gone = step THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN gone = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM met JOIN steps USING (filter_order) GROUP BY ALL
)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM counted
"""
