"""Diagnostics: token estimates, empty fields, counters and capped lists, as aggregates over per-row counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.jstext import WS, trim


def words(c: Column, white: str = WS) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(f"[^{white}]+")), F.lit(0))


def tokens(n_words: Column) -> Column:
    return F.ceil(n_words * F.lit(1.3)).cast("long")


def blanks(*values: Column) -> Column:
    """How many of the values are null or blank."""
    return sum((F.when(v.isNull() | (trim(v.cast("string")) == ""), 1).otherwise(0) for v in values), F.lit(0))


def totals(docs: DataFrame, n_words: Column, n_empty: Column) -> DataFrame:
    """One row: documents, words, estimated tokens, empty fields. Words and tokens are null where no row has a number of words."""
    d = docs.agg(F.count("*").alias("document_count"), F.sum(n_words).alias("word_count"), F.coalesce(F.sum(n_empty), F.lit(0)).alias("empty_fields"))
    return d.withColumn("estimated_tokens", tokens(F.col("word_count")))


def diagnostics(docs: DataFrame, content: str = "content", fields: tuple[str, ...] = ()) -> DataFrame:
    """:func:`totals` by the tools' rules: a null or blank content is an empty field too, nothing counts as 0."""
    return totals(docs, words(F.col(content)), blanks(*map(F.col, (content, *fields)))).fillna(0)


def capped(df: DataFrame, order: list[str], text: str, limit: int = 500, omitted: str = "Other warnings omitted.") -> DataFrame:
    """The first ``limit`` lines by ``order``, and one line for all others."""
    top = df.orderBy(*order).limit(limit + 1)
    ranked = top.select(F.row_number().over(Window.orderBy(*order)).alias("place"), text)
    return ranked.select("place", F.when(F.col("place") > limit, F.lit(omitted)).otherwise(F.col(text)).alias(text))
