"""A corpus pipeline: five stages over documents, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.llm import jaccard, language_id, mixing, packing, suffix_dedup
from docmill.llm.common import OWN, PACKED, drop_stash, packed, shielded, stash, table, unpacked


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which language ID finds a language; the others go: no text, no letter, or smallest encodings of nearly one size.

    The language is learned from labelled rows of ``docs``. Rows with null doc_id are judged alike, repeated
    rows each; empty input gives no rows. All columns are kept, whatever their names.
    """
    dictionaries = language_id.fit(docs.where(~language_id.held_out()))
    free, now = shielded(docs, ("lang_pred", "score", "rejected"))
    return language_id.predict(free, dictionaries).where("NOT rejected").select(*[F.col(n).alias(c) for c, n in now.items()])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five-word shingles, similarity 0.8 or more.

    Of rows with one id, one stays (the text of the smallest hash); rows without id stay all. Documents without
    words are linked with nothing and stay. Null text comes out empty. Empty input gives no rows; all columns are kept.
    """
    first = jaccard.near_classes(docs, k=5, num=80, den=100).where("doc_id = component_id").select("doc_id").distinct()
    kept = packed(docs).join(first.hint("merge"), "doc_id", "left_semi")
    twice = stash(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if not twice.isEmpty():
        # only ids given twice meet; their rows are ordered by what they hold
        order = Window.partitionBy("doc_id").orderBy(F.xxhash64(PACKED), *[F.xxhash64(c) for c in docs.columns if c not in ("doc_id", "text")])
        again = kept.join(twice, "doc_id", "left_semi").withColumn(OWN + "n", F.row_number().over(order)).where(F.col(OWN + "n") == 1).drop(OWN + "n")
        kept = kept.join(twice, "doc_id", "left_anti").unionByName(again)
    return unpacked(kept, docs.schema).unionByName(docs.where(F.col("doc_id").isNull()))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that start earlier; documents of which nothing but blanks is left go.

    n_chars, if it is a column, is the length of what is left where something went. Rows with null doc_id stay whole, repeated
    rows are cut alike; null text comes out empty. Empty input gives no rows. All columns are kept, whatever their names.
    """
    free, now = shielded(docs, ("n_bytes", "n_removed", "n_spans", "kept"))
    cut = suffix_dedup.cut_repeats(free)
    cut = cut.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(dict(docs.dtypes)["n_chars"])
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(size))
    return cut.select(*[F.col(n).alias(c) for c, n in now.items()])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a document that is taken in part is there once more.

    Rows are told apart by a number of their own, so those without id or with one id count each. Documents
    of size 0 are never taken. Empty input gives no rows; all columns are kept, whatever their names.
    """
    row, copies = OWN + "row", OWN + "copies"
    rows = stash(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    taken = mixing.mix(rows, row=row).where("taken > 0").select(row, F.ceil(F.col("taken") / F.col("size")).alias(copies))
    return rows.join(taken, row).withColumn(OWN + "copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens. Null text is empty; every row is packed, rows with null or repeated ids too."""
    return packing.pack(stash(packing.cut(docs), "pieces"))


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_near_copies),
    ("suffix-array dedup", without_repeats),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", sequences),
]

#: SQL has no tokenizer and no zstandard; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, "stage")
            if last is not None:  # what the stage has read is written anew
                drop_stash(last)
            last = docs
    return docs
