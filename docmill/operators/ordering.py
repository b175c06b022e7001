"""Places within groups, and joins on keys that many rows share, without a task that holds a whole group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.sources.scratch import kept


def ranked(df: DataFrame, group: str, order: list[Column], place: str = "place") -> DataFrame:
    """The rows with their place (from 1) in their group, by ``order``, which no two rows of a group share.

    Rows are laid out by sampled ranges of (group, order), so a group of any size lies over as many partitions as it needs.
    Each partition numbers what it holds of a group; the rows of the group that the partitions before it hold are added for the
    first group of each, the only one that can begin earlier. Per partition, two numbers go through the driver.
    """
    spark, part, local, first = df.sparkSession, "_part", "_local", "_first"
    by = [F.col(group).asc(), *order]
    schema = T.StructType([*df.schema.fields, T.StructField(part, T.IntegerType()), T.StructField(local, T.LongType()), T.StructField(first, T.BooleanType())])
    at = df.columns.index(group)

    def number(batches):
        from pyspark import TaskContext

        mine, open_, seen, began = TaskContext.get().partitionId(), None, 0, False
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column(at).dictionary_encode(null_encoding="encode")
            keys, codes = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.flatnonzero(np.diff(codes)) + 1]
            goes_on = began and keys[codes[0]] == open_
            place = np.arange(b.num_rows) - np.repeat(starts, np.diff(np.r_[starts, b.num_rows])) + 1
            upto = starts[1] if len(starts) > 1 else b.num_rows
            if goes_on:
                place[:upto] += seen
            head = np.zeros(b.num_rows, bool)
            if not began or (goes_on and in_first):
                head[:upto] = True
            in_first = bool(head[-1])
            open_, seen, began = keys[codes[-1]], int(place[-1]), True
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, mine, np.int32)), pa.array(place), pa.array(head)], names=schema.fieldNames())

    rows = kept(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(number, schema), "ranked")
    held = rows.groupBy(part).agg(F.min_by(group, F.struct(~F.col(first), local)).alias("head"), F.max_by(F.struct(group, local), F.struct(~F.col(first), group, local)).alias("tail"), F.bool_and(first).alias("whole"))
    before, carried, group_before = {}, 0, object()
    for r in sorted(held.collect(), key=lambda r: r[part]):  # a row for each partition
        before[r[part]] = carried if r["head"] == group_before else 0
        group_before = r["tail"][0]
        carried = r["tail"][1] + (before[r[part]] if r["whole"] else 0)
    known = spark.createDataFrame(list(before.items()), f"{part} int, _before long")
    return rows.join(F.broadcast(known), part).withColumn(place, (F.col(local) + F.when(F.col(first), F.col("_before")).otherwise(0)).cast("int")).select(*df.columns, place)


def dealt_join(big: DataFrame, small: DataFrame, key: str, counts: DataFrame, total: int, row: tuple[str, ...], how: str = "inner", least: int = 4096) -> DataFrame:
    """``big`` join ``small`` on ``key``. ``counts`` (key, n) says how many of the ``total`` rows of ``big`` have a key.

    Keys of many rows are dealt to several tasks by the hash of the columns ``row``, the rows of ``small`` repeated for each.
    """
    share = max(least, -(-total // 4096))  # so at most 4096 keys have more
    salt, parts, hot_key = "_salt", "_parts", "_hot"
    hot = F.broadcast(counts.where(F.col("n") > share).select(F.col(key).alias(hot_key), F.ceil(F.col("n") / share).alias(parts)))
    n = F.coalesce(F.col(parts), F.lit(1).cast("long"))
    dealt = big.join(hot, F.col(key) == F.col(hot_key), "left").withColumn(salt, F.pmod(F.xxhash64(*row), n)).drop(hot_key, parts)
    each = small.join(hot, F.col(key) == F.col(hot_key), "left").withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop(hot_key, parts)
    return dealt.join(each.hint("merge"), [key, salt], how).drop(salt)
