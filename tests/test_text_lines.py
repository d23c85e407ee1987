"""Texts of made lines and their amounts are compiled, and are those that the SQL states."""

import re

import pytest
from pyspark.sql import functions as F

from docfields.functions import parse
from docfields.plans import synth
from tests.sql import same_as_sql

SF = "/root/testdata/sf0.001"
NAMES = ["q_extract_amount", "q_label_detect", "q_alias_anchor", "q_alias_relaxed", "q_plausible", "q_sql_scalars"]


@pytest.mark.parametrize("name", NAMES)
def test_lines_are_compiled(spark, name):
    """No array a document, whose parts are interpreted, and no method over the 8,000 bytes that the JVM compiles."""
    import __spark_entry__ as entry

    run = entry.queries()[name](spark, SF)._jdf.queryExecution()
    assert "named_struct" not in run.executedPlan().toString()  # was there before
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        run = entry.queries()[name](spark, SF)._jdf.queryExecution()
        sizes = re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.PythonSQLUtils.explainString(run, "codegen"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(map(int, sizes)) <= 8000


@pytest.mark.parametrize("name", NAMES)
def test_texts_as_sql(spark, name):
    same_as_sql(spark, name)


def test_texts_are_those_of_lines(spark):
    whole = synth.flat_lines(spark, SF).select("invoice_id", "pos", "text")
    own = synth.texts(spark, SF)
    assert own.exceptAll(whole).isEmpty() and whole.exceptAll(own).isEmpty()


def test_odd_orders(spark, tmp_path):
    """Keys below nothing and without a value, dates and prices without one."""
    import duckdb

    con = duckdb.connect()
    con.sql(f"COPY (SELECT 0 AS c_custkey, 'Client -5' AS c_name) TO '{tmp_path}/customer.parquet'")
    orders = "SELECT k AS o_orderkey, 0 AS o_custkey, CASE WHEN k % 8 <> 5 THEN k * 1.5 END AS o_totalprice, CASE WHEN k % 8 <> 6 THEN TIMESTAMP '1998-02-06' END AS o_orderdate"
    con.sql(f"COPY ({orders} FROM (SELECT range AS k FROM range(-150, 300) UNION ALL SELECT NULL)) TO '{tmp_path}/orders.parquet'")
    same_as_sql(spark, "q_extract_amount", str(tmp_path))


def test_first_number_of_a_text(spark):
    """A number is found in the text as it stands; it was cleaned by three patterns before."""
    cases = [
        ("INV-1995-0000001", "-1995"), ("- 5", "5"), ("-\u00a05", "5"), ("-x5", "-5"), ("--5", "-5"), ("1\u202f234,5 €", "1234,5"), ("5TND%", ""), ("5 TND 6%7", "57"), ("7-8", "7"), ("x,5.", "5"), ("1€2x3", "123"),
        ("٣ 4", "4"), ("-.5", "5"), ("20,00% -3", "-3"), ("\x1f9\x1f9", "99"), ("no", None), ("-" * 50_000 + "5", "-5"), ("-" + "x" * 50_000, None), ("x" * 50_000 + "-1", "-1"), (None, None),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.d for r in rows.select("i", parse.amount_digits(F.col("t")).alias("d")).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(cases)] == cases
    plan = rows.select(parse.amount_digits(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" not in plan
