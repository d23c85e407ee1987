"""Rows of random documents and candidates near labels against plain loops; long documents in linear time."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docfields.operators import bands, layout
from tests.sql import same_as_sql

LINES = "invoice_id string, pos int, text string, box struct<x1:double,y1:double,x2:double,y2:double>, confidence double, page_index int, line_index int"


def random_lines(rng, doc, n, high=400):
    """Lines that overlap a little, a lot, in chains, or have no height; on two pages or none."""
    out = []
    for pos in range(n):
        y, x, h = rng.uniform(0, high), rng.uniform(0, 900), rng.choice([0.0, 8.0, 15.0, 15.0, 30.0])
        if rng.random() < 0.3 and out:
            y = out[-1][3][1] + rng.choice([0.0, 4.0, 7.0, 7.5, 8.0])
        out.append((doc, pos, f"t{pos}", (x, y, x + rng.uniform(5, 80), y + h), rng.choice([0.5, 0.9]), rng.choice([0, 0, 1, None]), pos))
    return out


def plain_rows(lines):
    """pos: (row_idx, col_idx) of one document."""
    order = sorted(lines, key=lambda x: (-1 if x[5] is None else x[5], x[3][1], x[1]))
    seeds, rows = [], []
    for x in order:
        for s, row in zip(seeds, rows, strict=True):
            shorter = min(s[3][3] - s[3][1], x[3][3] - x[3][1])
            if s[5] == x[5] and shorter > 0 and (min(s[3][3], x[3][3]) - max(s[3][1], x[3][1])) / shorter > 0.5:
                row.append(x)
                break
        else:
            seeds.append(x)
            rows.append([x])
    place = {x[1]: i for i, x in enumerate(order)}
    parts = []
    for k, row in enumerate(rows):
        row.sort(key=lambda x: (x[3][0], place[x[1]]))
        part = []
        for x in row:
            taller = max(part[-1][3][3] - part[-1][3][1], x[3][3] - x[3][1]) if part else 0
            if part and taller > 0 and x[3][0] - part[-1][3][2] > 5 * taller:
                parts.append((place[seeds[k][1]], part))
                part = []
            part.append(x)
        parts.append((place[seeds[k][1]], part))
    mean = lambda part, a, b: sum((x[3][a] + x[3][b]) / 2 for x in part) / len(part)
    parts.sort(key=lambda p: (p[0], mean(p[1], 1, 3), mean(p[1], 0, 2)))
    return {x[1]: (r, c) for r, (_, part) in enumerate(parts) for c, x in enumerate(part)}


def test_rows_of_random_documents(spark):
    rng = random.Random(3)
    docs = {f"d{i}": random_lines(rng, f"d{i}", rng.choice([1, 2, 5, 20, 60, 300])) for i in range(60)}
    got = layout.visual_rows(spark.createDataFrame([x for own in docs.values() for x in own], LINES).repartition(4)).collect()
    want = {(d, p): at for d, own in docs.items() for p, at in plain_rows(own).items()}
    assert {(r.invoice_id, r.pos): (r.row_idx, r.col_idx) for r in got} == want and len(got) == len(want)
    assert any(c > 0 for _, c in want.values()) and len({r for r, _ in want.values()}) > 20


def test_long_documents(spark):
    """Eight times the lines take well under 64 times the time."""
    took = []
    for n in (500, 2500, 20_000):
        lines = spark.createDataFrame(random_lines(random.Random(n), "d", n, 5 * n), LINES)
        began = time.time()
        assert layout.visual_rows(lines).count() == n
        took.append(time.time() - began)
    assert took[2] < 20 * max(took[1], 1)


@pytest.mark.parametrize("long_lines", [0, 15, 10_000])
def test_candidates_against_loops(spark, long_lines):
    rng, rows, want = random.Random(5), [], set()
    for d in range(12):
        own = []
        for pos in range(rng.choice([0, 3, 12, 18, 60])):
            x, y = rng.uniform(-300, 1500), rng.uniform(0, 1500)
            box = (x, y, x + rng.choice([0.0, 40.0, 200.0]), y + 15.0) if rng.random() < 0.95 else (None, y, x, y)
            own.append((f"d{d}", pos, rng.choice([None, *range(12)]), box, 0.9, rng.choice([True, False, False, None]), rng.choice([True, False, None])))
        rows += own
        whole = [x for x in own if x[3][0] is not None and x[2] is not None]
        for a in (x for x in whole if x[5]):
            found = {1: set(), 2: set(), 3: set()}
            for c in (x for x in whole if x[6]):
                steps, v = c[2] - a[2], max(0, max(a[3][1], c[3][1]) - min(a[3][3], c[3][3]))
                if steps == 0 and a[1] != c[1] and 0 <= c[3][0] - a[3][2] <= 500:
                    found[1].add(c[1])
                elif 1 <= steps <= 4 and v <= 250:
                    found[2].add(c[1])
                elif -4 <= steps <= -1 and v <= 250:
                    found[3].add(c[1])
            for phase in (1, 2) if found[1] | found[2] else (3,):
                want |= {(f"d{d}", a[1], p, phase) for p in found[phase]}
    schema = "invoice_id string, pos int, row_idx int, box struct<x1:double,y1:double,x2:double,y2:double>, confidence double, is_anchor boolean, fits boolean"
    got = bands.candidates(spark.createDataFrame(rows, schema).repartition(3), long_lines)
    assert sorted((r.invoice_id, r.anchor, r.pos, r.phase) for r in got.collect()) == sorted(want) and {w[3] for w in want} == {1, 2, 3}
    if long_lines == 0:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_flags_of_nothing(spark):
    none = spark.createDataFrame([], "invoice_id string, pos int, row_idx int, box struct<x1:double,y1:double,x2:double,y2:double>, confidence double, is_anchor boolean, fits boolean")
    assert bands.candidates(none).collect() == [] and bands.candidates(none.withColumn("more", F.lit(1)), 0).collect() == []


def test_query_equals_sql(spark):
    same_as_sql(spark, "q_band_candidates")
