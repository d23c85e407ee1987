"""Workbooks are made by tasks, in a folder, and hold every row once."""

import pytest
from pyspark.sql import functions as F

from docfields.functions import lexicon as lx
from docfields.plans import fixtures
from docfields.sinks import sheets
from tests.sql import same_as_sql


def _rows(spark, start, end):
    r = spark.range(start, end).withColumn("file_name", F.concat("id", F.lit(" <&>.pdf"))).withColumn("is_incomplete", F.col("id") % 3 == 0)
    fields = [F.when((F.col("id") % 3 == 0) & F.lit(f == "client"), None).otherwise(F.lit("x")).alias(f) for f in lx.FIELDS]
    return r.select("*", *fields, F.lit(0.5).alias("confidence"), F.lit("ocr").alias("engine_used"), F.lit(False).alias("has_error"))


@pytest.mark.parametrize("n", [1, 3])
def test_books(spark, monkeypatch, n):
    def to_driver(self, *_, **__):
        raise AssertionError("rows pass through the driver")

    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toLocalIterator", to_driver)
    at = fixtures.folder(spark, "books")
    sheets.export(_rows(spark, 0, 100), f"{at}/a", mark_missing=True, n=n)
    sheets.append(_rows(spark, 100, 130), f"{at}/a", f"{at}/b", sheet="RÉSULTATS", mark_missing=True)
    assert len(sheets.books(f"{at}/b")) == n
    assert all(sheets.sheet_names(p) == [sheets.RESULTS_SHEET, sheets.INCOMPLETE_SHEET] for p in sheets.books(f"{at}/b"))
    every = sheets.frame(spark, f"{at}/b", "résultats").collect()
    assert sorted(r.file_name for r in every) == sorted(f"{i} <&>.pdf" for i in range(130))
    assert {r.client for r in every} == {"x", "[MISSING]"}
    some = sheets.frame(spark, f"{at}/b", sheets.INCOMPLETE_SHEET.upper()).collect()
    assert sorted(r.file_name for r in some) == sorted(f"{i} <&>.pdf" for i in range(0, 130, 3)) and {r.client for r in some} == {""}


def test_books_without_rows(spark):
    at = fixtures.folder(spark, "books")
    sheets.export(_rows(spark, 0, 0), f"{at}/a")
    sheets.append(_rows(spark, 0, 0), f"{at}/a", f"{at}/b")
    assert len(sheets.books(f"{at}/b")) == 1 and sheets.frame(spark, f"{at}/b", sheets.RESULTS_SHEET).count() == 0


def test_full_sheets_go_on(tmp_path, monkeypatch):
    """Sheets that a full one goes on in are read, and appended to, with it."""
    monkeypatch.setattr(sheets, "SHEET_ROWS", 4)
    a, b = f"file://{tmp_path}/a.xlsx", f"file://{tmp_path}/b.xlsx"
    rows = [(str(i),) for i in range(10)]
    sheets._kept(a, lambda out: sheets.write(out, [("R", rows), ("I", [("h",)])]))
    assert sheets.sheet_names(a) == ["R", "R (2)", "R (3)", "I"] and list(sheets.read(a, "R")) == rows
    sheets._kept(b, lambda out: sheets.write(out, [("R", [*sheets.read(a, "R"), *rows]), ("I", sheets.read(a, "I"))]))
    assert list(sheets.read(b, "R")) == rows * 2 and list(sheets.read(b, "I")) == [("h",)]


def test_workbook_as_sql(spark):
    same_as_sql(spark, "q_workbook", "/root/testdata/sf0.01")
