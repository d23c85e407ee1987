"""Lines made for queries are those that the SQL states, without a join that is one piece of code too large for the JVM to compile."""

import pytest

from docfields.plans import synth

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("made", "sql"), [(synth.flat_lines, synth.LINES), (synth.invoice_lines, synth.INVOICE_LINES)])
def test_made_lines(spark, made, sql):
    import duckdb

    got = made(spark, SF)
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()
    flat = got if "x1" in got.columns else got.select("invoice_id", "pos", "text", "box.*", "confidence", "page_index", "line_index")
    con = duckdb.connect()
    for t in synth.DUCK:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(f"SELECT {', '.join(flat.columns)} FROM ({synth.duck(sql)})").fetchall()
    assert sorted(map(tuple, flat.collect())) == sorted(want)
