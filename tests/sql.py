"""A query's rows against those of its SQL."""

import os


def same_as_sql(spark, name, sf_dir="/root/testdata/sf0.001"):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    got, want = entry.queries()[name](spark, sf_dir), con.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    shown = lambda v: str(round(v, 6)) if isinstance(v, float) else str(v)
    assert sorted(tuple(shown(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(shown(r[i]) for i in order) for r in want.fetchall())
