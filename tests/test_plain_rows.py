"""Rows of documents without open rows by the short fold, the same as by the search of open rows; labels looked up as the patterns find them."""

import random

from pyspark.sql import functions as F

from docfields.functions import lexicon as lx
from docfields.functions import text as tx
from docfields.operators import layout

LINES = "id int, lines array<struct<page_index:int,y1:double,pos:int,box:struct<x1:double,y1:double,x2:double,y2:double>>>"


def seeds(spark, docs):
    rows = [(i, sorted((p, y1, n, (0.0, y1, 1.0, y2)) for n, (p, y1, y2) in enumerate(d))) for i, d in enumerate(docs)]
    x = spark.createDataFrame(rows, LINES)
    return [(r.lines, r.plain, r.every) for r in x.select("lines", layout._plain_seeds(F.col("lines")).alias("plain"), layout._seeds(F.col("lines")).alias("every"), "id").orderBy("id").collect()]


def by_loop(lines):
    firsts, out = [], []
    for n, (page, y1, _, box) in enumerate(lines):
        def joins(s):
            shorter = min(max(0.0, lines[s].box.y2 - lines[s].y1), max(0.0, box.y2 - y1))
            return lines[s].page_index == page and shorter > 0 and max(0.0, min(lines[s].box.y2, box.y2) - max(lines[s].y1, y1)) / shorter > 0.5

        at = next((s for s in firsts if joins(s)), n)
        firsts += [n] if at == n else []
        out.append(at)
    return out


def test_plain_seeds(spark):
    draw = random.Random(7)
    docs = [[(0, 0.0, 15.0), (0, 3.0, 15.0), (0, 40.0, 55.0), (1, 0.0, 9.0), (1, 9.0, 18.0)], [(0, 0.0, 20.0), (0, 8.0, 28.0), (0, 16.0, 36.0)], []]
    docs += [[(draw.randrange(2), float(y := draw.randrange(0, 40 * n, 4)), float(y + draw.choice([0, 10, 12, 60]))) for _ in range(n)] for n in (1, 2, 3, 5, 9, 140, 300) for _ in range(12)]
    got = seeds(spark, docs)
    assert [p for _, p, _ in got[:3]] == [[0, 0, 2, 3, 4], None, []]
    assert all(every == by_loop(lines) and plain in (None, every) for lines, plain, every in got)
    assert {p is None for _, p, _ in got} == {True, False}


def test_whole_labels(spark):
    labels = [label for own in lx.whole_labels().values() for label in own]
    x = spark.createDataFrame([(label,) for label in labels], "t string")
    told = x.select("t", tx.label_fields(F.col("t")).alias("looked"), *[tx.contains_label(F.col("t"), f).alias(f) for f in lx.FIELDS]).collect()
    assert len(told) == len(labels) and all(r.looked == [f for f in lx.FIELDS if r[f]] for r in told)
