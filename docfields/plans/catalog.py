"""Named queries over the driver's tables, with equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfields.functions import geometry as g
from docfields.functions import lexicon as lx
from docfields.functions import parse, text
from docfields.operators import amounts, layout, results
from docfields.plans import synth

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "q_extract_fields"

LINES, DOCS = synth.duck(synth.LINES), synth.duck(synth.DOCUMENTS)
FIELDS = f"""SELECT invoice_id, k, number_text AS numero_facture, iso_date AS date, supplier_text AS fournisseur, client_text AS client,
  CAST(ht AS STRING) AS montant_ht, CAST(tva AS STRING) AS montant_tva, CAST(taxe AS STRING) AS montant_taxe, CAST(ttc AS STRING) AS montant_ttc, ht, tva, taxe, ttc
FROM ({DOCS})"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight fields of the synthetic documents as strings, and the key."""
    d = synth.documents(spark, sf_dir)
    named = [F.col(a).alias(b) for a, b in zip(("number_text", "iso_date", "supplier_text", "client_text"), lx.FIELDS, strict=False)]
    return d.select("invoice_id", "k", *named, *[F.col(a).cast("string").alias(b) for a, b in zip(("ht", "tva", "taxe", "ttc"), lx.AMOUNTS, strict=True)])


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(lower(regexp_replace(strip_accents({x}), '[^\x00-\x7F]', '', 'g')), '[\s\x1c-\x1f]+', ' ', 'g'))"


def _collapse(x: str) -> str:
    return rf"trim(regexp_replace(replace({x}, chr(160), ' '), '[\s\x1c-\x1f]+', ' ', 'g'))"


def _sql(regex: str) -> str:
    return "'" + regex.replace("'", "''") + "'"


# -- text


@query(f"SELECT doc_id, md5({_norm('text')}) AS digest, CAST(length({_norm('text')}) AS BIGINT) AS n FROM documents")
def q_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("norm"))
    return d.select("doc_id", F.md5("norm").alias("digest"), F.length("norm").cast("long").alias("n"))


@query(f"SELECT doc_id, md5({_collapse('text')}) AS digest FROM documents")
def q_collapse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(text.collapse_text(F.col("text"))).alias("digest"))


@query(r"SELECT doc_id, coalesce(length(regexp_replace(text, '[^\x00-\x7F\p{L}]', '', 'g')) / nullif(length(text), 0) >= 0.5, false) AS latin FROM documents")
def q_latin_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.looks_like_latin_text(F.col("text")).alias("latin"))


@query(f"SELECT doc_id, md5(trim({_collapse('text')}, ' :-' || chr(9) || chr(10) || chr(13))) AS digest FROM documents")
def q_strip_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(text.strip_noise(F.col("text"))).alias("digest"))


def _norm_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.texts(spark, sf_dir).select("invoice_id", "pos", "text", text.normalize_text(F.col("text")).alias("norm"))


NORM_LINES = f"(SELECT invoice_id, pos, text, {_norm('text')} AS norm FROM ({LINES}))"


@query(f"SELECT invoice_id, pos, regexp_matches(norm, {_sql(lx.any_label_regex())}) AS is_label, regexp_matches(trim(norm, '.,;:'), {_sql(lx.date_regex())}) AS is_date FROM {NORM_LINES}")
def q_label_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _norm_lines(spark, sf_dir).select("invoice_id", "pos", text.looks_like_label(F.col("norm")).alias("is_label"), text.looks_like_date(F.col("norm")).alias("is_date"))


@query(" UNION ALL ".join(f"SELECT invoice_id, pos, '{f}' AS field FROM {NORM_LINES} WHERE regexp_matches(norm, {_sql(lx.label_regex(f))})" for f in lx.FIELDS))
def q_alias_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _norm_lines(spark, sf_dir).select("invoice_id", "pos", F.explode(text.label_fields(F.col("norm"))).alias("field"))


@query(f"SELECT invoice_id, pos, regexp_matches(norm, {_sql(lx.relaxed_regex('numero_facture'))}) AS relaxed FROM {NORM_LINES}")
def q_alias_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _norm_lines(spark, sf_dir).select("invoice_id", "pos", text.contains_label_relaxed(F.col("norm"), "numero_facture").alias("relaxed"))


_COMMAS = "length(norm) - length(replace(norm, ',', ''))"


@query(
    f"SELECT invoice_id, pos, p AS plausible, p AND regexp_matches(norm, '[0-9]') AND NOT regexp_matches(norm, {_sql(lx.address_regex())}) AND {_COMMAS} < 2 AS plausible_number "
    f"FROM (SELECT *, length(norm) >= 2 AND NOT regexp_matches(norm, {_sql(lx.any_label_regex())}) AS p FROM {NORM_LINES})"
)
def q_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("norm")
    return _norm_lines(spark, sf_dir).select("invoice_id", "pos", text.is_plausible(n).alias("plausible"), text.is_plausible_number(n).alias("plausible_number"))


@query(
    f"""SELECT invoice_id, CAST(round(greatest(-0.3, least(0.3, CASE WHEN contains(upper(v), 'INV') OR contains(upper(v), 'FAC') THEN 0.25 ELSE 0 END
  + CASE WHEN regexp_matches(v, '2023|2024|2025|2026') THEN 0.2 ELSE 0 END - CASE WHEN length(v) < 3 THEN 0.3 WHEN length(v) < 5 THEN 0.1 ELSE 0 END
  - CASE WHEN regexp_matches(v, '^[0-9]+$') AND length(v) < 6 THEN 0.2 ELSE 0 END)) * 100) AS BIGINT) AS quality FROM (SELECT invoice_id, number_text AS v FROM ({DOCS}))"""
)
def q_invoice_number_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.documents(spark, sf_dir).select("invoice_id", F.round(text.number_quality(F.col("number_text")) * 100).cast("long").alias("quality"))


# -- amounts and dates


def _amount_sql(x: str) -> str:
    """Amount of a text x in DuckDB, as nested selects over one column."""
    cleaned = rf"trim(regexp_replace(regexp_replace(regexp_replace({_collapse(x)}, 'TND|DT|€|\$|£', '', 'g'), '-?\d[\d.,]*\s*%', '', 'g'), '[^\d,.\-\s]', '', 'g'))"
    first = rf"replace(regexp_extract({cleaned}, '-?\d[\d\s.,]*\d|-?\d'), ' ', '')"
    return first


_PLAIN = """CASE WHEN contains(a, ',') AND contains(a, '.') THEN CASE WHEN instr(reverse(a), ',') < instr(reverse(a), '.') THEN replace(replace(a, '.', ''), ',', '.') ELSE replace(a, ',', '') END
  WHEN contains(a, ',') THEN CASE WHEN length(a) - length(replace(a, ',', '')) = 1 AND instr(reverse(a), ',') BETWEEN 2 AND 4 THEN replace(a, ',', '.') ELSE replace(a, ',', '') END ELSE a END"""


@query(f"SELECT invoice_id, pos, CAST(try_cast({_PLAIN} AS DECIMAL(28,3)) AS VARCHAR) AS amount FROM (SELECT invoice_id, pos, nullif({_amount_sql('text')}, '') AS a FROM ({LINES}))")
def q_extract_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.texts(spark, sf_dir).select("invoice_id", "pos", parse.extract_amount(F.col("text")).alias("amount"))


_MONTH_CASE = "CASE regexp_extract(n, '(\\d{1,2}) ([a-z]+) (\\d{4})', 2) " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(lx.MONTHS, 1)) + " END"


@query(
    rf"""SELECT invoice_id, CASE WHEN regexp_matches(t, '\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b')
  THEN CAST(try_strptime(regexp_extract(t, '(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}})', 1) || '/' || regexp_extract(t, '(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}})', 2) || '/' || regexp_extract(t, '(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}})', 3), '%d/%m/%Y')::DATE AS VARCHAR)
  ELSE CAST(try_strptime(regexp_extract(n, '(\d{{1,2}}) ([a-z]+) (\d{{4}})', 1) || '/' || CAST({_MONTH_CASE} AS VARCHAR) || '/' || regexp_extract(n, '(\d{{1,2}}) ([a-z]+) (\d{{4}})', 3), '%d/%m/%Y')::DATE AS VARCHAR) END AS iso
FROM (SELECT invoice_id, date_text AS t, {_norm("date_text")} AS n FROM ({DOCS}))"""
)
def q_extract_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = synth.documents(spark, sf_dir)
    return d.select("invoice_id", parse.extract_date(F.col("date_text"), text.normalize_text(F.col("date_text"))).alias("iso"))


@query(f"SELECT invoice_id, CASE WHEN lang = 0 THEN CAST(ht AS VARCHAR) END AS value FROM ({DOCS})")
def q_parse_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = synth.documents(spark, sf_dir)
    return d.select("invoice_id", parse.format_amount(parse.parse_decimal(F.regexp_replace("ht_text", " TND", ""))).alias("value"))


# -- geometry and layout


@query(
    f"""SELECT a.invoice_id, a.pos, greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS v_overlap, greatest(0, greatest(a.y1, b.y1) - least(a.y2, b.y2)) AS v_gap,
  greatest(0, greatest(a.x1, b.x1) - least(a.x2, b.x2)) AS h_gap, round(1000 - greatest(0, b.x1 - a.x2) * 5 - abs((b.y1 + b.y2) / 2 - (a.y1 + a.y2) / 2) * 5 + b.confidence * 100, 6) AS score_right,
  round(800 - greatest(0, greatest(a.y1, b.y1) - least(a.y2, b.y2)) * 8 - greatest(0, greatest(a.x1, b.x1) - least(a.x2, b.x2)) * 3 + b.confidence * 100, 6) AS score_below
FROM ({LINES}) a JOIN ({LINES}) b ON a.invoice_id = b.invoice_id AND b.pos = a.pos + 1"""
)
def q_box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("invoice_id").orderBy("pos")
    x = synth.ocr_lines(spark, sf_dir).withColumn("b", F.lead("box").over(w)).withColumn("c", F.lead("confidence").over(w)).withColumn("p", F.lead("pos").over(w)).where("p = pos + 1")
    a, b, c = F.col("box"), F.col("b"), F.col("c")
    return x.select(
        "invoice_id", "pos", g.vertical_overlap(a, b).alias("v_overlap"), g.vertical_gap(a, b).alias("v_gap"), g.horizontal_gap(a, b).alias("h_gap"),
        F.round(g.score_right(a, b, c), 6).alias("score_right"), F.round(g.score_below(a, b, c), 6).alias("score_below"),
    )


@query(
    f"SELECT invoice_id, pos, CAST(row_number() OVER (PARTITION BY invoice_id, page_index ORDER BY y1, x1, confidence DESC, pos) - 1 AS INT) AS line_index FROM ({LINES}) WHERE confidence >= 0.3"
)
def q_line_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.detected_lines(synth.ocr_lines(spark, sf_dir), lx.LEAST_DETECTION).select("invoice_id", "pos", "line_index")


_ROWS = f"""(SELECT invoice_id, pos, text, CAST(dense_rank() OVER (PARTITION BY invoice_id ORDER BY y1, sub) - 1 AS INT) AS row_idx,
  CAST(row_number() OVER (PARTITION BY invoice_id, y1, sub ORDER BY x1, pos) - 1 AS INT) AS col_idx
FROM (SELECT *, sum(cut) OVER (PARTITION BY invoice_id, y1 ORDER BY x1, pos) AS sub
  FROM (SELECT *, CASE WHEN x1 - lag(x2) OVER (PARTITION BY invoice_id, y1 ORDER BY x1, pos) > 75 THEN 1 ELSE 0 END AS cut FROM ({LINES}))))"""


@query(f"SELECT invoice_id, pos, row_idx, col_idx FROM {_ROWS}")
def q_cluster_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.visual_rows(synth.ocr_lines(spark, sf_dir)).select("invoice_id", "pos", "row_idx", "col_idx")


@query(
    f"SELECT invoice_id, string_agg(t, chr(10) ORDER BY row_idx) AS raw_text FROM (SELECT invoice_id, row_idx, string_agg(trim(text), chr(9) ORDER BY col_idx) AS t FROM {_ROWS} GROUP BY 1, 2) GROUP BY 1"
)
def q_raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.raw_text(layout.documents(synth.ocr_lines(spark, sf_dir)))


@query(
    """SELECT user_id, island, count(*) AS n, min(event_id) AS first_event FROM (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island
FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600000000 THEN 1 ELSE 0 END AS cut FROM events)) GROUP BY 1, 2"""
)
def q_gap_split_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of a user's events, cut where over an hour passes: the gap split along time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.withColumn("cut", F.when(F.col("us") - F.lag("us").over(w) > 3_600_000_000, 1).otherwise(0)).withColumn("island", F.sum("cut").over(w))
    return e.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


# -- rules over amounts

_TAX = "coalesce(taxe, 0)"
_N = "(CAST(ht IS NOT NULL AS INT) + CAST(tva IS NOT NULL AS INT) + CAST(ttc IS NOT NULL AS INT))"
_RATE = "CAST(CAST(round_even(CAST(tva AS DECIMAL(28,10)) / ht * 100, 1) AS DECIMAL(38,1)) AS VARCHAR)"
_ISSUES = f"""list_filter([CASE WHEN {_N} >= 2 AND ht = tva AND ht > 0 THEN 'HT equals TVA (duplication error)' END,
  CASE WHEN {_N} >= 2 AND ht = ttc AND ht > 0 THEN 'HT equals TTC (duplication error)' END, CASE WHEN {_N} >= 2 AND tva > ttc THEN 'TVA exceeds TTC (impossible)' END,
  CASE WHEN {_N} >= 2 AND ht < 0 THEN 'Negative HT amount' END, CASE WHEN {_N} >= 2 AND tva < 0 THEN 'Negative TVA amount' END, CASE WHEN {_N} >= 2 AND ttc < 0 THEN 'Negative TTC amount' END,
  CASE WHEN {_N} >= 2 AND ht > 0 AND tva > 0 AND (tva < ht * 0.05 OR tva > ht * 0.30) THEN 'Unlikely VAT rate' END,
  CASE WHEN {_N} >= 2 AND abs(ht + tva + {_TAX} - ttc) > 0.50 THEN 'Arithmetic mismatch: HT+IVA+Taxe=' || CAST(CAST(ht + tva + {_TAX} AS DECIMAL(28,3)) AS VARCHAR) || ' ≠ TTC=' || CAST(ttc AS VARCHAR) END,
  CASE WHEN ttc IS NULL THEN 'TTC amount missing' END], lambda x: x IS NOT NULL)"""


@query(f"SELECT invoice_id, array_to_string({_ISSUES}, '; ') AS issues FROM ({FIELDS})")
def q_cross_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.transform(amounts.issues(), lambda i: F.when(i.startswith("Unlikely VAT rate"), "Unlikely VAT rate").otherwise(i))
    return fields(spark, sf_dir).select("invoice_id", F.array_join(told, "; ").alias("issues"))


_THREE = "ht IS NOT NULL AND tva IS NOT NULL AND ttc IS NOT NULL"
_FILLS = f"({_THREE} AND taxe IS NULL AND ttc - ht - tva >= 0 AND (abs(ht + tva - ttc) <= 0.02 OR ttc - ht - tva <= greatest(ht, tva) * 2))"
_RECONCILED = f"""SELECT invoice_id, k, numero_facture, date, fournisseur, client, tva IS NULL AND ttc IS NOT NULL AND ttc - ht - {_TAX} >= 0 AS f_tva,
  montant_ht, CASE WHEN tva IS NULL AND ttc - ht - {_TAX} >= 0 THEN CAST(CAST(ttc - ht - {_TAX} AS DECIMAL(28,3)) AS VARCHAR) ELSE montant_tva END AS montant_tva,
  CASE WHEN {_FILLS} THEN CAST(CAST(ttc - ht - tva AS DECIMAL(28,3)) AS VARCHAR) ELSE montant_taxe END AS montant_taxe,
  CASE WHEN ttc IS NULL AND tva IS NOT NULL THEN CAST(CAST(ht + tva + {_TAX} AS DECIMAL(28,3)) AS VARCHAR) ELSE montant_ttc END AS montant_ttc,
  concat_ws(',', CASE WHEN tva IS NULL AND ttc - ht - {_TAX} >= 0 THEN 'montant_tva' END, CASE WHEN {_FILLS} THEN 'montant_taxe' END, CASE WHEN ttc IS NULL AND tva IS NOT NULL THEN 'montant_ttc' END) AS computed,
  coalesce({_THREE} AND abs(ht + tva + {_TAX} - ttc) > 0.02 AND NOT {_FILLS}, false) AS mismatch FROM ({FIELDS})"""


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fields(spark, sf_dir).withColumn("r", amounts.reconciled())
    return x.select("invoice_id", "k", *lx.FIELDS[:4], *[F.col(f"r.{c}").alias(c) for c in lx.AMOUNTS], F.array_join("r.computed_fields", ",").alias("computed"), F.col("r.amount_mismatch").alias("mismatch"))


@query(f"SELECT invoice_id, montant_ht, montant_tva, montant_taxe, montant_ttc, computed, mismatch FROM ({_RECONCILED})")
def q_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir).select("invoice_id", *lx.AMOUNTS, "computed", "mismatch")


@query(
    f"""SELECT invoice_id, montant_ht, CASE WHEN (({_THREE} AND abs(ht + tva + {_TAX} - ttc) > 0.50 AND ht = tva) OR (tva IS NULL AND ttc IS NOT NULL)) AND ttc - ht - {_TAX} >= 0
  THEN CAST(CAST(ttc - ht - {_TAX} AS DECIMAL(28,3)) AS VARCHAR) ELSE montant_tva END AS montant_tva,
  CASE WHEN ({_THREE} AND abs(ht + tva + {_TAX} - ttc) > 0.50 AND ht <> tva) OR (tva IS NOT NULL AND ttc IS NULL) THEN CAST(CAST(ht + tva + {_TAX} AS DECIMAL(28,3)) AS VARCHAR) ELSE montant_ttc END AS montant_ttc FROM ({FIELDS})"""
)
def q_validate_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields(spark, sf_dir).withColumn("v", amounts.validated()).select("invoice_id", "v.montant_ht", "v.montant_tva", "v.montant_ttc")


@query(f"SELECT invoice_id, coalesce(ht = tva, false) OR coalesce(ht = taxe, false) OR coalesce(ht = ttc, false) OR coalesce(tva = taxe, false) OR coalesce(tva = ttc, false) OR coalesce(taxe = ttc, false) AS collision FROM ({FIELDS})")
def q_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields(spark, sf_dir).select("invoice_id", amounts.collision().alias("collision"))


_PENALTY = "list_sum([0] || list_transform({i}, lambda i: CASE WHEN contains(i, 'duplication') THEN 25 WHEN contains(i, 'impossible') OR contains(i, 'Negative') THEN 20 WHEN contains(i, 'Arithmetic') THEN 15 ELSE 10 END))"


@query(
    f"""SELECT invoice_id, CAST(greatest(0, 90 - {_PENALTY.format(i=_ISSUES)} - CASE WHEN CAST(tva IS NULL AS INT) + CAST(ttc IS NULL AS INT) >= 2 THEN 10 ELSE 0 END) AS BIGINT) AS confidence_pct FROM ({FIELDS})"""
)
def q_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure = F.create_map(*[x for f in lx.FIELDS for x in (F.lit(f), F.lit(0.9))])
    x = fields(spark, sf_dir).withColumn("issues", amounts.issues())
    return x.select("invoice_id", F.round(amounts.confidence(sure, F.col("issues")) * 100).cast("long").alias("confidence_pct"))


# -- results

_RESULTS = f"SELECT *, k % 13 = 0 AS has_error, k % 17 = 0 AS is_selected, k % 13 = 0 OR montant_tva IS NULL OR montant_taxe IS NULL OR montant_ttc IS NULL AS is_incomplete, CAST((k % 101) AS DOUBLE) / 100 AS confidence FROM ({_RECONCILED})"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _reconciled(spark, sf_dir).withColumn("has_error", F.col("k") % 13 == 0).withColumn("is_selected", F.col("k") % 17 == 0)
    x = x.withColumn("confidence", (F.col("k") % 101).cast("double") / 100).withColumn("engine_used", F.when(F.col("k") % 2 == 0, "gemini").otherwise("ocr"))
    return x.withColumn("is_incomplete", results.is_incomplete(F.col("has_error")))


@query(
    f"SELECT invoice_id, is_incomplete, concat_ws(', ', CASE WHEN montant_tva IS NULL THEN 'montant_tva' END, CASE WHEN montant_taxe IS NULL THEN 'montant_taxe' END, CASE WHEN montant_ttc IS NULL THEN 'montant_ttc' END) AS missing FROM ({_RESULTS})"
)
def q_missing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("invoice_id", "is_incomplete", F.array_join(results.missing_fields(), ", ").alias("missing"))


@query(f"SELECT 'complete' AS mode, count(*) AS n FROM ({_RESULTS}) WHERE NOT is_incomplete UNION ALL SELECT 'missing', count(*) FROM ({_RESULTS}) WHERE is_incomplete UNION ALL SELECT 'both', count(*) FROM ({_RESULTS})")
def q_export_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _results(spark, sf_dir)
    parts = [results.export_view(x, m).agg(F.count(F.lit(1)).alias("n")).select(F.lit(m).alias("mode"), "n") for m in ("complete", "missing", "both")]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"SELECT invoice_id FROM ({_RESULTS}) WHERE is_selected OR NOT (SELECT bool_or(is_selected) FROM ({_RESULTS}))")
def q_selection_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.selection(_results(spark, sf_dir)).select("invoice_id")


@query(f"SELECT count(*) AS total, count(*) FILTER (has_error) AS errors, count(*) FILTER (is_incomplete AND NOT has_error) AS incomplete, count(*) FILTER (NOT has_error) AS success FROM ({_RESULTS})")
def q_summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.summary(_results(spark, sf_dir))


@query(f"SELECT CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.40 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n FROM ({_RESULTS}) GROUP BY 1")
def q_confidence_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).groupBy(results.confidence_bucket(F.col("confidence")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"SELECT invoice_id, coalesce(montant_tva, '[MISSING]') AS montant_tva, coalesce(montant_ttc, '[MISSING]') AS montant_ttc, CASE WHEN has_error THEN '—' ELSE CAST(k % 101 AS VARCHAR) || '%' END AS confidence_text, CASE WHEN k % 2 = 0 THEN 'Gemini (cloud)' ELSE 'OCR local' END AS engine FROM ({_RESULTS})"
)
def q_export_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _results(spark, sf_dir)
    return x.select("invoice_id", *results.export_cells(True)).select("invoice_id", "montant_tva", "montant_ttc", "confidence_text", "engine")


_OK = [(f, "true") for f in lx.FIELDS[:4]] + [(c, f"CASE WHEN r.{c} IS NULL AND t.{c} IS NULL THEN true WHEN r.{c} IS NULL OR t.{c} IS NULL THEN false ELSE abs(CAST(r.{c} AS DOUBLE) - CAST(t.{c} AS DOUBLE)) < 0.01 END") for c in lx.AMOUNTS]
_CELLS = " UNION ALL ".join(f"SELECT r.invoice_id, '{f}' AS field, {ok} AS ok FROM ({_RECONCILED}) r JOIN ({FIELDS}) t ON r.invoice_id = t.invoice_id" for f, ok in _OK)


@query(f"SELECT coalesce(field, 'overall') AS field, count(*) FILTER (ok) AS correct, count(*) AS total FROM ({_CELLS}) GROUP BY ROLLUP (field)")
def q_score_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.field_accuracy(results.scored(_reconciled(spark, sf_dir), fields(spark, sf_dir)))


@query(f"SELECT invoice_id, count(*) FILTER (ok) AS correct FROM ({_CELLS}) GROUP BY 1")
def q_score_invoice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.scored(_reconciled(spark, sf_dir), fields(spark, sf_dir)).groupBy("invoice_id").agg(F.count_if("ok").alias("correct"))


@query(f"SELECT invoice_id, CASE WHEN k % 13 = 0 THEN '0.000' ELSE montant_taxe END AS montant_taxe FROM ({_RESULTS})")
def q_rerun_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _results(spark, sf_dir).select("invoice_id", "montant_taxe", "has_error")
    again = x.where("has_error").withColumn("montant_taxe", F.lit("0.000"))
    return results.upsert(x, again, "invoice_id").select("invoice_id", "montant_taxe")


@query(
    """SELECT event_id, CASE code WHEN 422 THEN 'format' WHEN 500 THEN CASE WHEN event_id % 3 = 0 THEN 'poppler' WHEN event_id % 3 = 1 THEN 'engine' ELSE 'internal' END ELSE 'HTTP ' || CAST(code AS VARCHAR) END AS message
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 422 WHEN 1 THEN 500 WHEN 2 THEN 503 ELSE 404 END AS code FROM events)"""
)
def q_error_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    turn: Column = F.col("event_id") % 4
    code = F.when(turn == 0, 422).when(turn == 1, 500).when(turn == 2, 503).otherwise(404)
    body = F.when(F.col("event_id") % 3 == 0, "pdfinfo failed").when(F.col("event_id") % 3 == 1, "PaddleOCR died").otherwise("?")
    return e.select("event_id", results.error_message(code, body).alias("message"))
