"""Candidates of labels in gathered documents: as those of lines, without an exchange, a join or a table."""

import random

import pytest
from pyspark.sql import functions as F

from docfields.operators import bands, layout
from tests.sql import same_as_sql
from tests.test_layout import LINES, random_lines


@pytest.mark.parametrize("long_lines", [0, 25, 10_000])
def test_gathered_as_lines(spark, long_lines):
    rng = random.Random(5)
    rows = [x for d, (n, high) in enumerate([(1, 40), (12, 100), (30, 300), (40, 4000), (150, 1500), (400, 9000)]) for x in random_lines(rng, f"d{d}", n, high)]
    flagged = [(*x, rng.random() < 0.4, rng.choice([True, True, False, None])) for x in rows]
    lines = spark.createDataFrame(flagged, f"{LINES}, is_anchor boolean, fits boolean").repartition(3)
    docs = layout.documents(lines, ("is_anchor", "fits"))
    flat = docs.select("invoice_id", F.explode(F.flatten("rows")).alias("l")).select("invoice_id", *[f"l.{c}" for c in ("pos", "row_idx", "box", "confidence", "is_anchor", "fits")])
    want = sorted(tuple(r) for r in bands.candidates(flat, 25).collect())
    assert sorted(tuple(r) for r in bands.candidates_of(docs, long_lines).collect()) == want and {w[3] for w in want} == {1, 2, 3}


def test_no_line_is_exchanged_again(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["q_band_candidates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan  # lines were written and exchanged for each side of each join
    same_as_sql(spark, "q_band_candidates", "/root/testdata/sf0.01")
