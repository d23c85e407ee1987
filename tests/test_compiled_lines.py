"""Made lines are worked out by compiled steps: no function over an array of lines, and nothing of the texts before documents are dealt."""

import pytest

from docfields.plans import synth
from tests.sql import same_as_sql


@pytest.mark.parametrize("made", [synth.flat_lines, synth.invoice_lines])
def test_lines_without_functions_over_arrays(spark, made):
    plan = made(spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert "lambda" not in plan.optimizedPlan().toString() and "size(" not in plan.optimizedPlan().toString()
    assert plan.executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["q_field_confidence", "q_completeness", "q_numero"])
def test_queries_of_these_lines(spark, name):
    import __spark_entry__  # noqa: F401

    same_as_sql(spark, name)
