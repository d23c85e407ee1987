"""Kept results, standing of batches, breakers and typed replies, each against a plain version."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from docfields.functions import lexicon as lx
from docfields.sinks.kept import KeptTable
from docfields.sources import breaker, providers, replies
from docfields.streaming import standing
from tests.sql import same_as_sql


def files_of(folder):
    return {os.path.join(at, n) for at, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


def test_upsert_rewrites_what_it_touches(spark, tmp_path):
    table = KeptTable(spark, str(tmp_path / "t"), "id", 16)
    rows = [(i, f"v{i}", None) for i in range(400)] + [(None, "none", 1)]
    table.upsert(spark.createDataFrame(rows, "id long, value string, more int").repartition(3))
    assert sorted(map(str, map(tuple, table.rows().collect()))) == sorted(map(str, rows))
    before = files_of(tmp_path)
    again = spark.createDataFrame([(5, "old", 1), (5, "new", 2), (None, "known", 1), (1000, "added", 1)], "id long, value string, turn int")
    touched = table.upsert(again.drop("turn").limit(0)) + table.upsert(again, order=["turn"])
    assert 0 < len(touched) <= 3
    want = {i: v for i, v, _ in rows} | {5: "new", None: "known", 1000: "added"}
    assert {r.id: r.value for r in table.rows().collect()} == want
    same = {f for f in before if int(f.split("bucket_of_16=")[1].split("/")[0]) not in touched}
    assert same and same <= files_of(tmp_path)
    table.upsert(again, order=["turn"])  # once more changes nothing
    assert {r.id: r.value for r in table.rows().collect()} == want and table.rows().count() == len(want)
    with pytest.raises(ValueError, match="number of buckets"):
        KeptTable(spark, str(tmp_path / "t"), "id", 8).rows()


def test_standing_after_a_restart(spark, tmp_path):
    """Files arrive in three parts; the query is started anew for each, and once with nothing new."""
    rng, schema = random.Random(2), "batch long, stage string, is_selected boolean, has_error boolean, is_incomplete boolean"
    flag = lambda: rng.choice([True, False, None])
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice(["queued", "done", "other", None]), flag(), flag(), flag()) for _ in range(600)]
    table = KeptTable(spark, str(tmp_path / "t"), "batch", 4)
    for part in (rows[:200], rows[200:350], rows[350:], []):
        if part:
            spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        standing.keep_standing(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), table, str(tmp_path / "checkpoint"))
    want = {}
    for b in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == b]
        done = [r for r in own if r[1] == "done"]
        errors, incomplete = sum(r[3] is True for r in done), sum(r[4] is True and r[3] is not True for r in done)
        queued = [r for r in own if r[1] == "queued"]
        want[b] = (len(queued), sum(r[2] is True for r in queued), len(done), errors, incomplete, len(done) - errors, "error" if errors else "warning" if incomplete else "success")
    assert {r.batch: tuple(r)[1:] for r in table.rows().collect()} == want


def machine(rows):
    """place: (answered_by, has_error, first called, second called), by the rules as a loop over one batch."""
    gone, closed, out = (401, 403, 404, 410, 429, 503), set(), {}
    for place, engine, first, second, a, b in rows:
        calls = []

        def ask(who, code, calls=calls, closing=True):
            calls.append(who)
            if code in gone and closing:
                closed.add(who)
            return code == 200

        if engine == "secondary" and second:
            got = ("secondary", not ("second" not in closed and ask("second", b)))
        elif first and engine in ("auto", "primary") and "first" not in closed:
            if ask("first", a):
                got = ("primary", False)
            elif a not in gone or engine == "primary":
                got = ("primary", True)
            else:
                got = ("secondary" if second and "second" not in closed and ask("second", b) else "ocr", False)
        elif engine == "auto" and second and "second" not in closed:
            got = ("secondary" if ask("second", b, closing=False) else "ocr", False)
        else:
            got = ("ocr", False)
        out[place] = (*got, "first" in calls, "second" in calls)
    return out


ASKED = "batch string, place long, engine string, has_primary boolean, has_secondary boolean, a int, b int"


def asked(n, seed):
    rng = random.Random(seed)
    code = lambda: rng.choice([200] * 12 + [500, 0, 429, 401, 503])
    batch = lambda i: rng.choice(["hot", "hot", f"b{i % 25}", None])
    return [(batch(i), i, rng.choice(["auto", "auto", "primary", "secondary", "ocr", None]), rng.choice([True, True, False, None]), rng.random() < 0.7, code(), code()) for i in range(n)]


def first(row):
    if row["a"] == 0:
        raise TimeoutError("late")
    return row["a"], "first"


def second(row):
    return row["b"], "second"


def test_breaker_in_order(spark):
    rows = asked(1500, 4)
    got = breaker.route_in_order(spark.createDataFrame(rows, ASKED).repartition(5), first, second).collect()
    want = {p: w for b in {r[0] for r in rows} for p, w in machine([r[1:] for r in rows if r[0] == b]).items()}
    assert {r.place: (r.answered_by, r.has_error, r.primary_called, r.secondary_called) for r in got} == want and len(got) == len(rows)
    assert any(r.reply == "TimeoutError: late" for r in got)
    assert sum(w[2] for w in want.values()) < sum(r[3] is True and r[2] in ("auto", "primary") for r in rows)  # calls are spared
    assert breaker.route_in_order(spark.createDataFrame([], ASKED), first, second).collect() == []


def test_known_replies_are_routed_alike(spark):
    rows = [(b, p, e, f is True, s, x, y) for b, p, e, f, s, x, y in asked(800, 6)]
    files = spark.createDataFrame(rows, ASKED).withColumnRenamed("a", "primary_code").withColumnRenamed("b", "secondary_code")
    got = {r.place: (r.answered_by, r.has_error) for r in providers.routed(files).collect()}
    assert got == {p: w[:2] for b in {r[0] for r in rows} for p, w in machine([r[1:] for r in rows if r[0] == b]).items()}


def test_breaker_stays_closed_over_restarts(spark, tmp_path):
    rows = asked(600, 5)
    for part in (rows[:200], rows[200:400], rows[400:]):
        spark.createDataFrame(part, ASKED).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        routed = breaker.route_stream(spark.readStream.schema(ASKED).parquet(str(tmp_path / "in")), first, second)
        routed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {r.place: (r.answered_by, r.has_error, r.primary_called, r.secondary_called) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {p: w for b in {r[0] for r in rows} for p, w in machine([r[1:] for r in rows if r[0] == b]).items()}


def unfenced(text):
    bare = text.strip()
    bare = bare[7:] if bare.startswith("```json") else bare
    return (bare[:-3] if bare.endswith("```") else bare).strip()


def plain_client(text):
    try:
        told = json.loads(unfenced(text))
    except ValueError:
        return "not JSON"
    if not isinstance(told, dict):
        return "not an object"
    odd = [f for f in lx.FIELDS if not isinstance(told.get(f), str | None)]
    return f"not a text: {odd[0]}" if odd else tuple(told.get(f) for f in lx.FIELDS)


def plain_server(text):
    try:
        told = json.loads(unfenced(text))
    except ValueError:
        return "not JSON"
    if not isinstance(told, dict):
        return "not an object"
    absent = [f for f in lx.FIELDS if f not in told]
    shown = lambda v: v if v is None else json.dumps(v, separators=(",", ":")) if isinstance(v, dict | list) else str(v)
    return f"missing: {absent[0]}" if absent else tuple(shown(told[f]) for f in lx.FIELDS)


def test_replies_by_type(spark):
    rng = random.Random(7)
    values = ['"x"', '"12,5 é\\n"', "null", "1", "-7", "1250.00", "0.5", "1e5", "12345678.25", "1.5e-7", "0.0001", "123456789012345678901234567890", "2e16", "1E+2", "true", "false", '{"a": [1, null]}', "[]", "0.1", "100", '"12.0"', "9007199254740993"]
    texts = []
    for _ in range(400):
        own = {f: rng.choice(values[:3] if rng.random() < 0.7 else values) for f in lx.FIELDS if rng.random() < 0.97}
        body = "{" + ", ".join(f'"{f}": {v}' for f, v in own.items()) + ', "other": {"x": 1}}'
        texts.append(rng.choice(["{}", "```json\n{}\n```", "```json{}", " \n{}```\n", "```{}```"]).replace("{}", body))
    texts += [f'{{{", ".join(f"""{chr(34)}{f}{chr(34)}: {v}""" for f in lx.FIELDS)}}}' for v in values]
    texts += ["", "null", "[1]", '"x"', "nothing", "{", "```json\n```"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    for r in rows.select("i", replies.client_fields(F.col("t")).alias("c"), replies.server_fields(F.col("t")).alias("s")).collect():
        for got, want in ((r.c, plain_client(texts[r.i])), (r.s, plain_server(texts[r.i]))):
            assert (got.problem or tuple(got[f] for f in lx.FIELDS)) == want, texts[r.i]
    none = spark.range(1).select(replies.client_fields(F.lit(None).cast("string")).alias("c")).first().c
    assert none.problem == "not JSON" and none.client is None


@pytest.mark.parametrize("name", ["q_upsert_table", "q_live_standing", "q_breaker", "q_typed_replies"])
def test_queries_equal_sql(spark, name):
    same_as_sql(spark, name)
