"""Mixing sources to target weights: water-filled targets, hash-random order, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.llm.common import WORD, table

WEIGHTS = (5, 2, 1)


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """Target tokens of each source from totals (source, source_size).

    Weights repeat over the sources by code point, null last. Targets are ``level * weight``, but at most
    ``cap`` times the source's size; the level is where they add up to the sum of all sizes. The input has
    a row for each source, so its windows in one task see that many rows, not documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    t = totals.withColumn("weight", w).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    t = t.withColumn("ratio", F.col("most") / F.col("weight"))
    every = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(
        "*",
        (F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("most").over(before), F.lit(0.0))).alias("left_size"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("left_weight"),
    )
    # sources from here on share what those with lower ratios leave; the first level under its own ratio is the one
    t = t.withColumn("level", F.col("left_size") / F.col("left_weight"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)
    return t.select("source", "source_size", F.least("most", F.coalesce(level["level"], F.lit(0.0)) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, prefix: int = 3, row: str | None = None) -> DataFrame:
    """Words that a mix takes of each document: doc_id, source, size, source_size, target, taken, and the long column ``row`` if named.

    Keys are md5 of the id, of the text where the id is null, so the order in a source is random and reruns agree. The first ``prefix`` hex
    digits of the key range-partition each source (16 ** prefix ranges); sums of ranges give each range its
    start, and a running sum inside a range places each document. A source whose target is q times its size
    and a rest takes every document q times, then cuts the order at the rest, inside one document if need be.

    Null text is of size 0, null source is a source (last), rows with equal keys are ordered by size; repeated
    rows count each. Sizes 0 take 0. Empty input gives no rows. Other columns are ignored.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    row_id = [F.col(row).alias("row_id")] if row else [F.lit(None).cast("long").alias("row_id")]
    d = docs.select(*row_id, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key")).withColumn("range", F.substring("key", 1, prefix))
    ranges = d.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, cap)
    starts = ranges.withColumn("start", F.sum("range_size").over(Window.partitionBy("source").orderBy("range")) - F.col("range_size"))
    starts = starts.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("range").alias("r"), "start", "source_size", "target")
    order = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    # the ranges' starts come in as rows of their own, so that one shuffle serves join and running sum
    head = starts.select(F.lit(None).cast("long").alias("row_id"), F.lit(None).cast("long").alias("doc_id"), F.col("s").alias("source"), F.lit(0).cast("long").alias("size"), F.lit("").alias("key"), F.col("r").alias("range"), "start", "source_size", "target", F.lit(True).alias("head"))
    rows = d.select("*", *[F.lit(None).cast(k).alias(c) for c, k in (("start", "long"), ("source_size", "long"), ("target", "double"))], F.lit(False).alias("head")).unionByName(head)
    rows = rows.select("row_id", "doc_id", "source", "size", "head", (F.sum("size").over(order) - F.col("size")).alias("inside"), *[F.first(c, ignorenulls=True).over(order).alias(c) for c in ("start", "source_size", "target")])
    rows = rows.where(~F.col("head"))
    budget = F.floor("target")
    rest = F.when(F.col("source_size") > 0, budget % F.col("source_size")).otherwise(0)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start") - F.col("inside")))
    return rows.select("doc_id", "source", "size", "source_size", "target", (whole * F.col("size") + last).cast("long").alias("taken"), *([F.col("row_id").alias(row)] if row else []))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, text, '')) AS key FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 3.0::DOUBLE * source_size AS most FROM totals
), r AS (
  SELECT *, most / weight AS ratio FROM w
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r
), t AS (
  SELECT source, source_size, least(most, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, level LIMIT 1), 0) * weight) AS target FROM l
), p AS (
  SELECT doc_id, d.source, size, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN (floor(target)::BIGINT // source_size) * size + greatest(0, least(size, floor(target)::BIGINT % source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM p
"""
