"""Replies read as columns say what the single expressions say, and are parsed once."""

from pyspark.sql import functions as F

from docfields.functions import lexicon as lx
from docfields.sources.replies import client_fields, read_replies, server_fields
from tests.sql import same_as_sql

VALUES = ['"a"', "null", "1", "-7", "0", "0.0", "-0.5", "12.50", "1.0", "0.0001", "0.00001", "1e3", "1E-7", "-12.25", "123456789012345.5", "1234567890.12345", "12345678901234567890", "1.5e300", "true", "false", "[1, 2.5]", '{"k": 1}', '""', "99999999999999999999.5"]
ODD = [None, "", " ", "``", "```json```", "``````", "```json```json{}``````", "null", "null x", "nullx", "nothing", "true", "truex", "falsefalse", "1 2", "-", "-x", "NaN", "Infinity", "'a'", '"text"', "[]", "[{}]", "{", "{}", "{} x", '{"date": 1}{', "{'date': 1}", '\xa0{"date": "1"}　', ' ```json\x85{"date": "2"}\n``` ', '﻿{}', '{"date": "1", "date": "2"}', "/* */{}", "+1", ".5", "```json {\"date\": 5}", "a ``` b"]


def test_replies_as_single_expressions(spark):
    full = lambda f, v: "{" + ", ".join(f'"{g}": {v if g == f else chr(34) + g + chr(34)}' for g in lx.FIELDS) + "}"
    replies = ODD + [form % full(f, v) for f in (lx.FIELDS[0], lx.FIELDS[7]) for v in VALUES for form in ("%s", "```json\n%s\n``` ")] + ['{"date": %s}' % v for v in VALUES]
    x = read_replies(spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string"), "reply")
    x = x.select("reply", "client", "server", client_fields(F.col("reply")).alias("c"), server_fields(F.col("reply")).alias("s"))
    rows = x.collect()
    assert len(rows) == len(replies)
    for r in rows:
        assert (r.client, r.server) == (r.c, r.s), r.reply


def test_typed_replies_are_parsed_once(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["q_typed_replies"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1  # once for each reader before
    same_as_sql(spark, "q_typed_replies", "/root/testdata/sf0.001")
