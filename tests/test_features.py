"""A line's features are columns that Spark compiles, and say what the single expressions say."""

from pyspark.sql import functions as F

from docfields.functions import parse
from docfields.functions import text as tx
from docfields.operators import extract

TEXTS = [
    "Total TTC : 1.234,50 TND", "TVA 20% 12,500", "12 500,5 €", "31/02/2024", "7 février 2024", "5-6-99", "1 mai 0000", "Numéro de facture", "Invoice No: INV-2024-77", "- ref :", "–", "",
    "N° de la facture d'origine", "Client  Étoile \x1c SARL", "² rue", "date 3/4/123", "total hors taxe 5", "montant ²", "中文中文", "Customer : total", "1,2,3", "a, b, c", "ﬁche 12",
]


def test_features_are_compiled(spark):
    """Amounts and dates outside functions over arrays, without an exception for each number that is no date."""
    t = F.col("text")
    lines = spark.createDataFrame([(x,) for x in TEXTS], "text string")
    plan = lines.select(parse.extract_amount(t))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
    numbers = extract.featured(lines).select("amount", "as_date", "words", "plausible_number")._jdf.queryExecution().optimizedPlan().toString()
    assert "gettimestamp" not in numbers


def test_features_as_single_expressions(spark):
    t = F.col("text")
    lines = spark.createDataFrame([(x,) for x in TEXTS], "text string")
    norm = tx.normalize_text(t)
    x = extract.featured(lines).select(
        "text", "amount", "as_date", "words", "plausible", "plausible_number", "labels",
        tx.clean_value("montant_ht", t).alias("amount_"), tx.clean_value("date", t).alias("date_"), F.when(tx.is_plausible(norm), tx.clean_value("client", t)).alias("words_"),
        tx.is_plausible(norm).alias("plausible_"), tx.is_plausible_number(norm).alias("number_"),
    )
    got = {r.text: r for r in x.collect()}
    assert all((r.amount, r.as_date, r.words, r.plausible, r.plausible_number) == (r.amount_, r.date_, r.words_, r.plausible_, r.number_) for r in got.values())
    assert [got[t].amount for t in TEXTS[:3]] == ["1234.500", "12.500", "12500.500"]
    assert [got[t].as_date for t in TEXTS[3:7]] == [None, "2024-02-07", "2099-06-05", "0000-05-01"]


def test_replies_are_written_once(spark):
    """Each value of a reply is read once, not once for every field; fences and blanks as before."""
    from docfields.sources.replies import client_fields, server_fields, unfenced

    r = F.col("reply")
    rows = [("```json\n{\"date\": \"1\"}\n```",), (" ```json```",), ("``",), ("x``` ",), ("```json {\"date\": 5}",), ("a ``` b",), (None,), ("``````",), ("```json```json{}``````",)]
    replies = spark.createDataFrame(rows, "reply string")
    assert [x.u for x in replies.select(unfenced(r).alias("u")).collect()] == ['{"date": "1"}', "", "``", "x", '{"date": 5}', "a ``` b", None, "```", "```json{}```"]
    for fields, reads in ((client_fields, 9), (server_fields, 19)):  # 16 and 96 where each field wrote all of them
        plan = replies.select(fields(r).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("variant_get") <= reads
    got = [(x.f.date, x.f.problem) for x in replies.select(client_fields(r).alias("f")).collect()]
    assert got[:5] == [("1", None), (None, "not JSON"), (None, "not JSON"), (None, "not JSON"), (None, "not a text: date")]
