"""Column functions on cases, rules, and queries against their SQL."""

import os
import random

import pytest
from pyspark.sql import functions as F

from docfields.functions import lexicon, parse, text
from docfields.operators import amounts

AMOUNTS = [
    ("1 234,56 TND", "1234.560"), ("$ 1,234.56", "1234.560"), ("1,234,567", "1234567.000"), ("-123,45", "-123.450"),
    ("TVA 20,00% 20,00 €", "20.000"), ("TVA 20%", None), ("9999999999999999999.99", "9999999999999999999.990"),
    ("xyz123.45abc", "123.450"), ("1.234.567", None), ("1,234", "1.234"), ("", None), ("100.00 20.00", None), ("2 20.00", "220.000"),
    ("1.0005", "1.000"), ("9" * 41, None), (None, None),
]
DATES = [
    ("15/03/2024", "2024-03-15"), ("15/03/24", "2024-03-15"), ("15-03-2024", "2024-03-15"), ("15 décembre 2024", "2024-12-15"),
    ("99/99/2024", None), ("01/13/2024", None), ("le 1/2/2024 a Tunis", "2024-02-01"), ("29/02/2023", None), ("29/02/2024", "2024-02-29"),
    ("2024-03-15", None), ("1/1/024", "2024-01-01"), ("3 may 2024", None), (None, None),
]
NORMS = [("N° Facture", "n facture"), ("nº", "no"), ("  Café  ÉTÉ\t", "cafe ete"), ("½ œ ß €", "12"), ("№ 5", "no 5"), ("ﬁn", "fin"), ("", "")]
LABELS = [("REF-2024-001", False), ("NO", True), ("no.", True), ("Societe Nouvelle SARL", False), ("Transport", True), ("total", True), ("12.50", False)]


def check(spark, cases, f):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, x string")
    got = {r.i: r.y for r in rows.select("i", f(F.col("x")).alias("y")).collect()}
    assert [(a, got[i]) for i, (a, _) in enumerate(cases)] == cases


def test_amounts(spark):
    check(spark, AMOUNTS, parse.extract_amount)


def test_dates(spark):
    check(spark, DATES, lambda x: parse.extract_date(x, text.normalize_text(x)))


def test_normal_forms(spark):
    check(spark, NORMS, text.normalize_text)
    assert all(lexicon.normalise(a) == b for a, b in NORMS)


def test_labels(spark):
    check(spark, LABELS, lambda x: text.looks_like_label(text.normalize_text(x)))


def test_inline(spark):
    cases = [("Total HT : 1 250,00", "1250.000"), ("Total HT 99.5", "99.500"), ("Total HT", None)]
    check(spark, cases, lambda x: text.inline_value(F.lit("montant_ht"), x))
    check(spark, [("Client nouvelle sarl", "ouvelle sarl")], lambda x: text.inline_value(F.lit("client"), x))


def test_one_decimal_of_doubles(spark):
    rng = random.Random(1)
    xs = [k / 20 for k in range(2000)] + [k / 1000 for k in range(3000)] + [0.0145 * 100, 0.15, 0.35, 1e-12, 123456789.05, 1e10 + 0.25] + [rng.uniform(0, 200) for _ in range(2000)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", amounts.tenths_text(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in got] == [(x, f"{x:.1f}") for x in xs]


RECONCILE = [
    (("1000", "200", None, None), ("1000", "200", None, "1200.000", ["montant_ttc"], False)),
    (("100", "20", None, "125"), ("100", "20", "5.000", "125", ["montant_taxe"], False)),
    (("1000", "200", None, "9999"), ("1000", "200", None, "9999", [], True)),
    (("1000", None, None, "900"), ("1000", None, None, "900", [], False)),
    ((None, "200", None, "1200"), ("1000.000", "200", None, "1200", ["montant_ht"], False)),
    (("1 000,00", "200", "0", "1200"), ("1 000,00", "200", "0", "1200", [], False)),
]


def test_reconcile(spark):
    rows = spark.createDataFrame([(i, *a) for i, (a, _) in enumerate(RECONCILE)], "i int, montant_ht string, montant_tva string, montant_taxe string, montant_ttc string")
    got = {r.i: tuple(r.r) for r in rows.select("i", amounts.reconciled().alias("r")).collect()}
    assert [got[i] for i in range(len(RECONCILE))] == [b for _, b in RECONCILE]


@pytest.mark.parametrize("name", ["q_normalize_text", "q_alias_anchor", "q_extract_amount", "q_cluster_rows", "q_reconcile", "q_score_fields"])
def test_against_sql(spark, name):
    import duckdb

    from docfields.plans import catalog

    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    got = catalog.QUERIES[name](spark, sf_dir)
    want = con.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(str(r[i]) for i in order) for r in want.fetchall())


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
