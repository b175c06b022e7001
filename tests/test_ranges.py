"""Pages and sheet rows through Spark's data source API: ranges of large files in several tasks, small files together."""

import datetime

import pytest
from pyspark.sql import functions as F

from docmill.sources import ranges, readers


class Parts:
    """Units are what bars part in a file, items or cells what commas part."""

    def units_of(self, file):
        return file.read().decode().split("|") if file.size() else []

    def count(self, file):
        return len(self.units_of(file))

    def units(self, file, first, end):
        return [[datetime.date(2025, 1, 7) if x == "day" else x for x in u.split(",")] for u in self.units_of(file)[first:end]]


parts = Parts()


@pytest.fixture
def load(spark):
    spark.dataSource.register(ranges.PageSource)
    spark.dataSource.register(ranges.SheetSource)
    return lambda kind, path, **options: spark.read.format(kind).options(parser="tests.test_ranges:parts", **options).load(str(path))


def test_pages_of_one_file_in_several_tasks(load, tmp_path):
    (tmp_path / "big.pdf").write_text("|".join(f"page,{i}" for i in range(100)))
    (tmp_path / "a.pdf").write_text("x,y|z")
    (tmp_path / "none.pdf").write_text("")
    df = load("docmill_pages", tmp_path, largeBytes=100, unitsPerTask=7)
    got = df.withColumn("task", F.spark_partition_id()).collect()
    big = [r for r in got if r.path.endswith("big.pdf")]
    assert {r.page: r.text for r in big} == {i + 1: f"page {i}" for i in range(100)} and len({r.task for r in big}) == 15
    assert sorted((r.page, r.text) for r in got if r.path.endswith("a.pdf")) == [(1, "x y"), (2, "z")] and len(got) == 102
    assert load("docmill_pages", tmp_path / "a.pdf").count() == 2 and load("docmill_pages", tmp_path / "none.pdf").count() == 0
    with pytest.raises(Exception, match="parser"):
        load("docmill_pages", tmp_path, parser="nowhere:none").count()


def test_rows_of_sheets(spark, load, tmp_path):
    (tmp_path / "s.xlsx").write_text("Nom,Né le,|ann,day,|,,|bob,,x")
    cells = load("docmill_sheets", tmp_path, largeBytes=1, unitsPerTask=2).withColumnRenamed("path", "file")
    rows = readers.sheet_records(cells).orderBy("row").collect()
    assert [r.asDict() for r in rows] == [{"file": str(tmp_path / "s.xlsx"), "row": i, "nom": n, "ne_le": d, "field_3": x} for i, n, d, x in ((1, "ann", "2025-01-07", ""), (2, "bob", "", "x"))]
