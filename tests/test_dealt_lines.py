"""Made lines come dealt by document, so that what operators ask for needs no exchange of lines."""

import pytest

from tests.sql import same_as_sql


@pytest.mark.parametrize("name", ["q_line_ordinal", "q_extract_fields"])
def test_lines_are_exchanged_once(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # of documents; lines were exchanged again


def test_ordinals_as_sql(spark):
    same_as_sql(spark, "q_line_ordinal", "/root/testdata/sf0.01")
