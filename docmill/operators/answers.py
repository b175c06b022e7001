"""Model-based labels, each asked for once: a durable log of answers that all outputs and later runs read."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.qualify import FIELDS, answer, clamp
from docmill.sources.scratch import fresh, kept

LOG = "key string, id string, level string, tags array<string>, summary string, error string, attempts int, ms long, asked_at double"
_KINDS = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.float64()]
#: Items that a slot asks for between two commits to the log: as many answers are lost at most where a run is cut off.
WAVE = 500


def item_key(prompt: str = "") -> Column:
    """What tells requests apart: a digest of the item's fields and of the prompt they go to."""
    return F.sha2(F.to_json(F.array(F.lit(prompt), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FIELDS])), 256)


class AnswerLog:
    """Answers by key, in one Parquet table that waves are appended to.

    A wave's answers appear when its job commits. A key may be there more than once, where an error was asked about again:
    the latest row counts.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh(spark, "answers")
        spark.createDataFrame([], LOG).write.mode("ignore").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(self.path)

    def calls(self) -> int:
        """Calls that the answers took. The log holds what a task committed, so neither a task that is repeated nor calls side by side miscount."""
        return self.rows().agg(F.coalesce(F.sum("attempts"), F.lit(0)).alias("n")).first().n

    def latest(self) -> DataFrame:
        """One row a key."""
        value = F.struct(*[c for c in self.rows().columns if c != "key"])
        return self.rows().groupBy("key").agg(F.max_by(value, "asked_at").alias("v")).select("key", "v.*")


@dataclass(frozen=True)
class Asked:
    """Labels of all items, and what this run did for them."""

    labels: DataFrame
    n_asked: int
    duration_ms: int
    log: AnswerLog


def ask(
    items: DataFrame,
    caller: Callable[[dict], str],
    log: str | None = None,
    prompt: str = "",
    concurrency: int = 5,
    retries: int = 2,
    backoff_ms: int = 400,
    again: bool = False,
    wave: int = WAVE,
    keep: tuple[str, ...] = ("pos",),
) -> Asked:
    """A label for each item (id, title, categorie, content), with the columns in ``keep``.

    Items that the log at ``log`` answers aren't asked about, nor is one twice that is given twice; ``again`` asks about those
    once more that have an error. The rest is dealt to ``concurrency`` slots (1 to 20), each of which has one call in flight at most,
    however many tasks Spark runs, and goes wave by wave into the log. A task that is lost repeats its part of one
    wave; a run that is cut off repeats one wave. An item whose calls all fail is UNKNOWN with its error, and logged as that.
    Null fields count as empty. Empty input asks nothing.
    """
    started = time.monotonic()
    slots, retries, backoff_ms = clamp(concurrency, 5, 1, 20), clamp(retries, 2, 0, 5), clamp(backoff_ms, 400, 0, 30_000)
    book = AnswerLog(items.sparkSession, log)
    keyed = items.withColumn("key", item_key(prompt))
    known = book.latest().where("error IS NULL") if again else book.rows()
    todo = keyed.select("key", *FIELDS).join(known.select("key").distinct(), "key", "left_anti").dropDuplicates(["key"])
    # both numbers are of the key, so that a wave is a filter on a column and takes no order of all items
    part = lambda at, n: F.pmod(F.conv(F.substring("key", at, 12), 16, 10).cast("long"), F.lit(n))
    todo = kept(todo.withColumn("slot", part(1, slots).cast("int")), "items")
    n = todo.count()
    waves = -(-n // (wave * slots))
    for w in range(waves):
        now = todo.where(part(13, waves) == w) if waves > 1 else todo
        now.repartition(slots, "slot").mapInArrow(_calls(caller, retries, backoff_ms), LOG).write.mode("append").parquet(book.path)
    duration = int((time.monotonic() - started) * 1000)
    labels = keyed.select(*keep, "key").join(book.latest(), "key").select(*keep, "id", "level", "tags", "summary", "error")
    return Asked(labels, n, duration, book)


def _calls(caller: Callable[[dict], str], retries: int, backoff_ms: int):
    """Asks about the items of a partition; those of one slot one after another, slots side by side."""

    def one_slot(items: list[dict]) -> list[tuple]:
        out = []
        for item in items:
            began = time.monotonic()
            found, attempts = answer({c: item[c] or "" for c in FIELDS}, caller, retries, backoff_ms)
            out.append((item["key"], *found, attempts, int((time.monotonic() - began) * 1000), time.time()))
        return out

    def run(batches):
        for b in batches:
            queues: dict[int, list[dict]] = {}
            for item in b.to_pylist():
                queues.setdefault(item["slot"], []).append(item)
            if queues:
                with ThreadPoolExecutor(len(queues)) as pool:
                    rows = [r for answers in pool.map(one_slot, queues.values()) for r in answers]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=[x.split()[0] for x in LOG.split(", ")])

    return run
