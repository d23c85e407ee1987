"""Ordered output, order and lookups as people read, and the session's SQL functions."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from docfields.functions import collation, register
from docfields.operators import results
from docfields.sinks import ordered
from docfields.sources import pages
from tests.sql import same_as_sql


def test_ordered_table(spark, tmp_path):
    """Ties, nulls, repeated rows, a key with half of the rows; places, pages and bounds."""
    rng, at = random.Random(1), str(tmp_path / "t")
    rows = [(rng.choice([7, 7, *range(40), None]), rng.choice(["a", "b", None]), rng.randrange(5)) for _ in range(3000)]
    ordered.write_ordered(spark.createDataFrame(rows, "a int, b string, c int").repartition(5), at, ["a", "b"], descending=("b",), file_rows=400)
    got = sorted(ordered.read_ordered(spark, at).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(rows)))
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, {"b": 0, "a": 1, None: 2}[r[1]]))
    assert [(r.a, r.b) for r in got] == [r[:2] for r in want] and sorted(map(str, (tuple(r)[:3] for r in got))) == sorted(map(str, rows))
    some = sorted(ordered.page(spark, at, 990, 50).collect(), key=lambda r: r.position)
    assert [tuple(r) for r in some] == [tuple(r) for r in got[990:1040]] and ordered.page(spark, at, 5000, 10).collect() == []
    assert len(ordered.page(spark, at, 990, 50).inputFiles()) < len(ordered.read_ordered(spark, at).inputFiles())
    found = ordered.between(spark, at, "a", F.lit(3), F.lit(5))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(str(r) for r in rows if r[0] is not None and 3 <= r[0] <= 5)
    assert len(found.inputFiles()) < len(ordered.files_of(spark, at).collect())
    plan = ordered.read_ordered(spark, at)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "rangepartitioning" not in plan
    ordered.write_ordered(spark.createDataFrame([], "a int"), str(tmp_path / "none"), ["a"])
    assert ordered.read_ordered(spark, str(tmp_path / "none")).collect() == []


def bare(s):
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).lower()


def test_order_and_lookups_as_read(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("aàAÀbBeéEzZ") for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    rows = spark.createDataFrame([(n,) for n in [*names, None]], "name string").repartition(3)
    got = [r.name for r in collation.by_reading(rows, "name").collect()]
    assert got[0] is None and [bare(n) for n in got[1:]] == sorted(map(bare, names))
    table = spark.createDataFrame([("ABE", 1, None), ("àbé", 2, "x"), ("zz", 3, "y"), (None, 4, "z")], "name string, number int, more string")
    found = {r.name: (r.number, r.more) for r in collation.looked_up(rows, table, "name").collect()}
    assert found == {n: {"abe": (1, None), "zz": (3, "y")}.get(n and bare(n), (None, None)) for n in [*names, None]}


def test_sql_functions_stay_in_the_jvm(spark):
    register.register(spark)
    texts = ["N° Facture : 1 234,56 TND", "it's 'x' \\ \"y\"", "", None, "15 décembre 2024", "Total  TTC:\t-3,5", "½ № ﬁ", "Date"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    told = spark.sql(f"SELECT t, {', '.join(f'{n}(t) AS {n}' for n in register.SCALARS)} FROM {{rows}}", rows=rows)
    own = rows.select("t", *[body(F.col("t")).alias(n) for n, (_, _, body) in register.SCALARS.items()])
    assert sorted(map(str, told.collect())) == sorted(map(str, own.collect())) and told.where("extract_amount IS NOT NULL").count() >= 3
    lines = spark.sql("SELECT l.* FROM {rows}, LATERAL document_lines(t) AS l", rows=spark.createDataFrame([('{"rec_texts":["a"]}',), ("no",), (None,)], "t string"))
    assert [tuple(r) for r in lines.collect()] == [(0, "a", 0.0, None, None, None, None)]
    for plan in (told, lines):
        shown = plan._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in shown and "Arrow" not in shown and "Join" not in shown and "Exchange" not in shown


def test_values_of_sql_functions_are_those_of_cases(spark):
    register.register(spark)
    assert spark.sql("SELECT extract_amount('$ 1,234.56') AS a, extract_date('le 1/2/2024') AS d, normalize_text('ÉTÉ  °') AS n").first().asDict() == {"a": "1234.560", "d": "2024-02-01", "n": "ete"}


def test_files_and_scalar_texts(spark):
    rows = spark.createDataFrame([("a/b.PDF", 1023), ("C:\\x\\y.Tiff", 1536), ("z.tar.gz", None), ("noend", 5 << 20), (None, 1)], "p string, n long")
    got = [tuple(r.i) for r in rows.select(results.file_item(F.col("p"), F.col("n")).alias("i")).collect()]
    assert got[:4] == [("b.PDF", "1023 B", "📋"), ("y.Tiff", "1.5 KB", "🖼"), ("z.tar.gz", "?", "📄"), ("noend", "5.0 MB", "📄")]
    replies = spark.createDataFrame([('[[[[0,0],[9,9]],"alone"]]',), ('[[[[0,0],[9,9]],["both",0.5]]]',)], "r string")
    assert sorted((x.text, x.confidence) for r in replies.select(pages.older_payload_lines(F.col("r")).alias("l")).collect() for x in r.l) == [("alone", 0.0), ("both", 0.5)]


@pytest.mark.parametrize("name", ["q_sql_functions", "q_sql_scalars", "q_sql_lines", "q_reading_order", "q_reading_lookup", "q_sorted_scores", "q_general_scores", "q_field_percent", "q_file_items", "q_scalar_texts"])
def test_queries_equal_sql(spark, name):
    same_as_sql(spark, name)
