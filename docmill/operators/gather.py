"""Diagnostics of a run, counted by the write of its rows: sums by an observation, lists as the first few by position."""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docmill.operators.articles import two_decimals
from docmill.operators.rules import COUNTERS
from docmill.sources.scratch import kept

FINDING = "struct<type:string,fieldPath:string,placeholder:string,preview:string>"
#: Fields of a run's diagnostics, in the order in which they are told.
SCHEMA = (
    f"inputFiles array<string>, rowCount long, documentCount long, emptyFieldCount long, encodingFixCount long, redactionCounts struct<secret:long,certificate:long,ip:long,internalPath:long>, redactionFindings array<{FINDING}>, "
    "removedBase64Images long, excludedEmptyArticles long, excludedInactiveArticles long, excludedMenuPages long, detectedMenuPages long, averageInternalLinksPerArticle double, articlesWithMostlyLinks long, exportedArticles long, "
    "totalItems long, qualifiedItems long, failedItems long, durationMs long, averageMsPerItem long, errors array<string>, estimatedTokens long, warnings array<string>"
)
#: Fields that are null where a tool doesn't tell them; all others are 0 or empty then.
OPTIONAL = ("rowCount", "documentCount")
MOST_FINDINGS, MOST_WARNINGS, OMITTED = 50, 500, "Additional warnings omitted."


def counted(df: DataFrame, sums: dict[str, Column], what: str) -> tuple[DataFrame, dict]:
    """``df`` as a kept table, and sums over its rows that its write has observed: the plan runs once for both."""
    seen = Observation()
    rows = kept(df.observe(seen, *[F.coalesce(c, F.lit(0)).alias(n) for n, c in sums.items()]), what)
    return rows, seen.get


def redaction_sums() -> dict[str, Column]:
    """What was corrected and redacted, from the counters of rows."""
    return {n: F.sum(n) for n in ("n_fixes", *COUNTERS.values())}


def first_lines(warnings: DataFrame | None, order: tuple[str, ...], most: int = MOST_WARNINGS) -> list[str]:
    """The first lines (column text) by ``order``, and one for all others; of a list of any length, most + 1 rows reach the driver."""
    if warnings is None:
        return []
    lines = [r["text"] for r in warnings.orderBy(*order).limit(most + 1).collect()]
    return [*lines[:most], OMITTED] if len(lines) > most else lines


def first_findings(findings: DataFrame | None, order: tuple[str, ...], most: int = MOST_FINDINGS) -> list[tuple]:
    """The first findings (type, fieldPath, placeholder, preview) by ``order``."""
    if findings is None:
        return []
    return [tuple(r) for r in findings.orderBy(*order).limit(most).select("type", "fieldPath", "placeholder", "preview").collect()]


def average_links(spark: SparkSession, links: int, articles: int) -> float:
    """Links an article, at two decimals."""
    if not articles:
        return 0.0
    return spark.range(1).select(two_decimals(F.lit(links / articles)).alias("x")).first().x


def diagnostics(spark: SparkSession, files: list[str], began: float, sums: dict | None = None, words: int = 0, n_items: int | None = None, **fields) -> DataFrame:
    """One row of all fields. ``sums`` holds n_fixes and the counters of kinds; ``words`` estimates tokens; ``began`` (of time.monotonic) gives the time a run took.

    ``n_items``: items whose time is averaged. What a tool doesn't tell is 0, empty, or null if it is one of OPTIONAL.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    sums = sums or {}
    took = int((time.monotonic() - began) * 1000) if "durationMs" not in fields else fields["durationMs"]
    told = {
        "inputFiles": files,
        "encodingFixCount": sums.get("n_fixes", 0),
        "redactionCounts": tuple(sums.get(n, 0) for n in COUNTERS.values()),
        "estimatedTokens": math.ceil(words * 1.3),
        "durationMs": took,
        "averageMsPerItem": math.floor(took / n_items + 0.5) if n_items else 0,
    } | {k: v for k, v in fields.items() if k != "durationMs"}
    unknown = set(told) - set(names)
    if unknown:
        raise ValueError(f"no such fields: {', '.join(sorted(unknown))}")
    lists = {"redactionFindings": [], "errors": [], "warnings": [], "averageInternalLinksPerArticle": 0.0}
    return spark.createDataFrame([tuple(told.get(n, None if n in OPTIONAL else lists.get(n, 0)) for n in names)], SCHEMA)
