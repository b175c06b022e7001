"""Language ID by compression: the language whose dictionary encodes a text smallest."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.common import table, tidy

#: Bounds of the fitted sample: rows of each language, characters of each row, and languages.
ROWS, CHARS, LANGUAGES = 128, 2000, 256


def held_out(col: str = "doc_id"):
    """Whether crc32 of the id as text is a multiple of 5. A null id counts as empty text, whose crc32 is 0: it is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, label: str = "lang", rows: int = ROWS, chars: int = CHARS) -> dict[str, bytes]:
    """Raw-content dictionaries by language, from a bounded hash-random sample of labelled rows.

    Of each of the LANGUAGES most common languages, ``rows`` rows by hash of the id and ``chars`` characters
    of each; only the dictionaries reach the driver (at most LANGUAGES * rows * chars characters). Rows
    without label or text don't count. The most common language comes first, ties by name.
    """
    common = docs.where(F.col(label).isNotNull() & (F.length("text") > 0)).groupBy(label).count().orderBy(F.desc("count"), label).limit(LANGUAGES)
    names = [r[label] for r in common.collect()]  # at most LANGUAGES
    order = Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    # ranks by id first, with text cut: a top-n of each language leaves each task
    s = docs.where(F.col(label).isin(names) & (F.length("text") > 0)).select("doc_id", label, F.substring("text", 1, chars).alias("text"))
    s = s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows)
    found: dict[str, list[str]] = {}
    for row in s.orderBy(label, F.desc("rank")).toLocalIterator():
        found.setdefault(row[label], []).append(row["text"].lower())
    return {lang: "\n".join(found[lang]).encode("utf-8", "replace") for lang in names}


class Classifier:
    """Encodes blocks of whole texts with each dictionary; small sums win."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 9, block: int = 4096):
        import zstandard as z

        self.block, self.coders = block, {}
        for lang, content in dictionaries.items():
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders[lang] = z.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

    def __call__(self, text: str | None) -> tuple[str, float, int]:
        """Language, margin (the second smallest encoding over the smallest, less 1, at most 1) and that margin in bytes."""
        if not text or not self.coders or not any(map(str.isalpha, text)):
            return "und", 0.0, 0
        data = text.lower().encode("utf-8", "replace")
        # short blocks, so that the dictionary and not the text's own past explains the text
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), i, lang) for i, (lang, c) in enumerate(self.coders.items()))
        if len(sizes) == 1:
            return sizes[0][2], 1.0, sizes[0][0]
        least, second = sizes[0][0], sizes[1][0]
        return sizes[0][2], min(1.0, second / max(1, least) - 1), second - least


def predict(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.01, margin_bytes: int = 1) -> DataFrame:
    """The rows of ``docs`` with lang_pred, score (0 to 1) and rejected.

    Every whole text is encoded. Null text or text without a letter (Unicode category L) is ``und`` with
    score 0, and rejected; so is a text whose two smallest sizes differ by less than ``margin`` of the
    smallest and ``margin_bytes`` more, though it keeps its language: a byte or two is chance in a short
    text, a hundredth in a long one. Ties go to the more common language. Repeated rows are judged alike;
    empty input gives no rows. Columns of these names in the input are replaced, others kept.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(dictionaries)  # bounded by the sample
    own = ["lang_pred", "score", "rejected"]
    docs = docs.drop(*own)

    @tidy
    def run(batches):
        of = Classifier(shared.value)
        for batch in batches:
            found = [of(x.as_py()) for x in batch.column(batch.schema.get_field_index("text"))]
            # extra / score is the smallest size
            narrow = [lang == "und" or (score < 1 and extra - margin_bytes < (margin * extra / score if score else 1)) for lang, score, extra in found]
            cols = [pa.array([p[0] for p in found], pa.string()), pa.array([p[1] for p in found], pa.float64()), pa.array(narrow, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *own])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    d = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), d).select("doc_id", "held_out", "lang_pred", "score", "rejected")
