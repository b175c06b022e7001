"""Row-local operators on streams: the same expressions, unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.redact import redact_columns
from docmill.functions.text import clean


def redacted_stream(stream: DataFrame, col: str = "text") -> DataFrame:
    """A stream of documents with clean, redacted text and counts."""
    return redact_columns(stream.withColumn("cleaned", clean(F.col(col), control=True)), "cleaned", "redacted").drop("cleaned")
