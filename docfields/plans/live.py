"""Queries over results that are kept while files arrive and rows are tried again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfields.functions import lexicon as lx
from docfields.functions import collation, text
from docfields.functions import geometry as g
from docfields.functions.register import register
from docfields.operators import amounts, bands, layout, results
from docfields.plans import fixtures, synth
from docfields.plans.catalog import _CELLS, _PLAIN, _RESULTS, _ROWS, DOCS, LINES, NORM_LINES, _amount_sql, _reconciled, _results, _sql, _table, fields, query
from docfields.plans.desk import _ASKED, _MACHINE, _ROUTE
from docfields.sinks import ordered
from docfields.sinks.kept import KeptTable
from docfields.sources import breaker, pages
from docfields.sources.replies import read_replies
from docfields.streaming import standing


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's Parquet, a file or a folder, as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


_STEPS = "CASE WHEN k % 26 = 0 THEN 'second' WHEN k % 13 = 0 THEN 'first' ELSE '' END"


@query(f"SELECT invoice_id, CASE {_STEPS} WHEN '' THEN montant_taxe WHEN 'first' THEN '0.000' ELSE '1.000' END AS montant_taxe, {_STEPS} AS rerun FROM ({_RESULTS}) UNION ALL SELECT 'NEW-' || k, '2.000', 'second' FROM ({_RESULTS}) WHERE k % 100 = 1")
def q_upsert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of results after two reruns of some of its rows, the second with new ones; rows that a rerun repeats go by their number."""
    table = KeptTable(spark, f"{fixtures.folder(spark, 'kept')}/results", "invoice_id", 16)
    rows = _results(spark, sf_dir).select("invoice_id", "k", "montant_taxe").withColumn("rerun", F.lit(""))
    table.upsert(rows)
    again = lambda some, name, tax: some.withColumn("montant_taxe", F.lit(tax)).withColumn("rerun", F.lit(name))
    table.upsert(again(rows.where("k % 13 = 0"), "first", "0.000"))
    failed = rows.where("k % 26 = 0")
    new = rows.where("k % 100 = 1").withColumn("invoice_id", F.concat(F.lit("NEW-"), F.col("k").cast("string")))
    twice = again(failed, "second", "9.000").withColumn("n", F.lit(1)).union(again(failed.union(new), "second", "1.000").withColumn("n", F.lit(2)))
    told = twice.withColumn("montant_taxe", F.when(F.col("invoice_id").startswith("NEW-"), "2.000").otherwise(F.col("montant_taxe")))
    table.upsert(told, order=["n"])
    return table.rows().select("invoice_id", "montant_taxe", "rerun")


_STANDING = "SELECT user_id % 60 AS batch, CASE WHEN event_type = 'signup' THEN 'queued' WHEN event_type <> 'view' THEN 'done' ELSE 'seen' END AS stage, event_id % 3 = 0 AS is_selected, event_type = 'error' AS has_error, event_id % 4 = 0 AS is_incomplete FROM {events}"


@query(
    f"""SELECT batch, count(*) FILTER (stage = 'queued') AS files, count(*) FILTER (stage = 'queued' AND is_selected) AS files_selected, count(*) FILTER (stage = 'done') AS total, count(*) FILTER (stage = 'done' AND has_error) AS errors,
  count(*) FILTER (stage = 'done' AND is_incomplete AND NOT has_error) AS incomplete, count(*) FILTER (stage = 'done' AND NOT has_error) AS success,
  CASE WHEN bool_or(stage = 'done' AND has_error) THEN 'error' WHEN bool_or(stage = 'done' AND is_incomplete) THEN 'warning' ELSE 'success' END AS severity FROM ({_STANDING.format(events="events")}) GROUP BY 1"""
)
def q_live_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each batch and how bad they are, kept as a stream of files goes by."""
    at = fixtures.folder(spark, "standing")
    table = KeptTable(spark, f"{at}/table", "batch", 8)
    standing.keep_standing(spark.sql(_STANDING.replace("{events}", "{e}"), e=stream_of(spark, sf_dir, "events")), table, f"{at}/checkpoint")
    return table.rows()


# -- providers and their replies

@query(f"SELECT {_ROUTE}, p_called AS primary_called, s_called AS secondary_called FROM ({_MACHINE})")
def q_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who answers for each file of each batch, in the files' order, and which providers are called for it."""
    asked = spark.sql(_ASKED.replace("{events}", "{e}"), e=_table(spark, sf_dir, "events"))
    routed = breaker.route_in_order(asked, lambda row: (row["primary_code"], "first"), lambda row: (row["secondary_code"], "second"))
    return routed.select("place", "batch", "answered_by", "has_error", "primary_called", "secondary_called")


_FORMS = ["texts", "number", "fraction", "flag", "nested", "part", "list", "words"]
_TTC = "CASE form WHEN 'texts' THEN CAST(ht AS VARCHAR) WHEN 'number' THEN CAST(k AS VARCHAR) WHEN 'fraction' THEN regexp_replace(CAST(k * 1000 + 0.5 AS VARCHAR), '0+$', '') WHEN 'flag' THEN 'True' WHEN 'nested' THEN '{\"k\":' || k || '}' END"
_WRONG = "CASE form WHEN 'list' THEN 'not an object' WHEN 'words' THEN 'not JSON' {more} END"


@query(
    f"""SELECT invoice_id, form, CASE WHEN form IN ('texts', 'part') THEN number_text END AS client_number, CASE WHEN form = 'texts' THEN CAST(ht AS VARCHAR) END AS client_ttc,
  {_WRONG.format(more="WHEN 'texts' THEN NULL WHEN 'part' THEN NULL ELSE 'not a text: montant_ttc'")} AS client_problem, {_TTC} AS server_ttc, CASE WHEN form NOT IN ('part', 'list', 'words') THEN number_text END AS server_number,
  {_WRONG.format(more="WHEN 'part' THEN 'missing: date'")} AS server_problem FROM ({DOCS}), (VALUES {", ".join(f"('{f}')" for f in _FORMS)}) AS f(form)"""
)
def q_typed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of replies by the types of their values, as the client and as the server take them."""
    d = synth.documents(spark, sf_dir)
    k, quoted = F.col("k").cast("string"), lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    ttc = {"texts": quoted(F.col("ht")), "number": k, "fraction": F.concat((F.col("k") * 1000).cast("string"), F.lit(".50")), "flag": F.lit("true"), "nested": F.concat(F.lit('{"k": '), k, F.lit("}"))}
    number = F.concat(F.lit('"numero_facture": '), quoted(F.col("number_text")))
    rest = ", ".join(f'"{f}": null' for f in lx.FIELDS[1:-1])
    replies = {form: F.concat(F.lit("```json\n{"), number, F.lit(f', {rest}, "montant_ttc": '), value, F.lit("}\n``` ")) for form, value in ttc.items()}
    replies |= {"part": F.concat(F.lit("{"), number, F.lit("}")), "list": F.concat(F.lit("["), k, F.lit("]")), "words": F.lit("no fields here")}
    told = F.explode(F.array(*[F.struct(F.lit(f).alias("form"), replies[f].alias("reply")) for f in _FORMS]))
    x = read_replies(d.select("invoice_id", told.alias("r")).select("invoice_id", "r.form", "r.reply"), "reply", "c", "s")
    return x.select(
        "invoice_id", "form", F.col("c.numero_facture").alias("client_number"), F.col("c.montant_ttc").alias("client_ttc"), F.col("c.problem").alias("client_problem"),
        F.col("s.montant_ttc").alias("server_ttc"), F.col("s.numero_facture").alias("server_number"), F.col("s.problem").alias("server_problem"),
    )


# -- candidates of labels in documents of any length

_FLAGGED = f"""SELECT l.invoice_id, l.pos, r.row_idx, x1, y1, x2, y2, confidence, regexp_matches(norm, {_sql(lx.any_label_regex())}) AS is_anchor, length(norm) >= 2 AND NOT regexp_matches(norm, {_sql(lx.any_label_regex())}) AS fits
  FROM ({LINES}) l JOIN {_ROWS} r ON l.invoice_id = r.invoice_id AND l.pos = r.pos JOIN {NORM_LINES} n ON l.invoice_id = n.invoice_id AND l.pos = n.pos"""


@query(
    f"""WITH f AS ({_FLAGGED}), p AS (SELECT a.invoice_id, a.pos AS anchor, c.pos, c.row_idx - a.row_idx AS d, greatest(0, greatest(a.y1, c.y1) - least(a.y2, c.y2)) AS v, greatest(0, greatest(a.x1, c.x1) - least(a.x2, c.x2)) AS h,
    c.x1 - a.x2 AS gap, abs((a.y1 + a.y2) / 2 - (c.y1 + c.y2) / 2) AS dy, c.confidence FROM f a JOIN f c ON a.invoice_id = c.invoice_id AND c.row_idx BETWEEN a.row_idx - {lx.LOOKAHEAD_ROWS} AND a.row_idx + {lx.LOOKAHEAD_ROWS} WHERE a.is_anchor AND c.fits),
  q AS (SELECT *, CASE WHEN d = 0 AND anchor <> pos AND gap BETWEEN 0 AND {lx.LARGEST_HORIZONTAL_GAP} THEN 1 WHEN d > 0 AND v <= {lx.LARGEST_VERTICAL_GAP} THEN 2 WHEN d < 0 AND v <= {lx.LARGEST_VERTICAL_GAP} THEN 3 END AS phase FROM p)
SELECT invoice_id, anchor, pos, phase, CAST(round(CASE phase WHEN 1 THEN 1000 - gap * 5 - dy * 5 ELSE 800 - v * 8 - h * 3 END + confidence * 100, 6) AS DOUBLE) AS score
FROM (SELECT *, min(phase) OVER (PARTITION BY invoice_id, anchor) AS best FROM q WHERE phase IS NOT NULL) WHERE phase < 3 OR best = 3"""
)
def q_band_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines near each label; documents of over 16 lines by bands of rows, as long ones would be."""
    lines = synth.ocr_lines(spark, sf_dir).withColumn("_n", text.normalize_text(F.col("text"))).withColumn("is_anchor", text.looks_like_label(F.col("_n")))
    lines = lines.withColumn("fits", (F.length("_n") >= 2) & ~F.col("is_anchor")).drop("_n")
    docs = layout.documents(lines, ("is_anchor", "fits"))  # gathered once, so no line is exchanged or written again
    return bands.candidates_of(docs, long_lines=16).withColumn("score", F.round("score", 6))


# -- functions of the session


@query(
    f"""SELECT n.invoice_id, n.pos, norm, CAST(try_cast({_PLAIN} AS DECIMAL(28,3)) AS VARCHAR) AS amount, regexp_matches(norm, {_sql(lx.any_label_regex())}) AS is_label
FROM {NORM_LINES} n JOIN (SELECT invoice_id, pos, nullif({_amount_sql('text')}, '') AS a FROM ({LINES})) m ON n.invoice_id = m.invoice_id AND n.pos = m.pos"""
)
def q_sql_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form, amount and label of lines by the session's SQL functions."""
    register(spark)
    return spark.sql("SELECT invoice_id, pos, normalize_text(text) AS norm, extract_amount(text) AS amount, looks_like_label(text) AS is_label FROM {lines}", lines=synth.texts(spark, sf_dir))


@query("SELECT event_id, n AS pos, CASE n WHEN 0 THEN event_type ELSE 'b' END AS text, CASE n WHEN 0 THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence, CASE n WHEN 0 THEN CAST(event_id % 50 + 10 AS DOUBLE) END AS x2 FROM events, (VALUES (0), (1)) AS v(n)")
def q_sql_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of recognisers' replies by the session's table function."""
    register(spark)
    reply = """'{"rec_texts":["' || event_type || '","b"],"rec_scores":[0.9],"rec_polys":[[[0,0],[' || (event_id % 50 + 10) || ',0],[1,9]]]}'"""
    replies = _table(spark, sf_dir, "events").select("event_id", F.expr(reply).alias("reply"))
    return spark.sql("SELECT event_id, l.pos, l.text, l.confidence, l.x2 FROM {replies}, LATERAL document_lines(reply) AS l", replies=replies)


# -- order


_SPELLED = "SELECT p_partkey, p_brand, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, 'e', 'é') ELSE p_name END AS name FROM {part}"
_READ = "lower(strip_accents(name))"


@query(f"SELECT p_partkey, name, rank() OVER (PARTITION BY p_brand ORDER BY {_READ}) AS as_read, rank() OVER (PARTITION BY p_brand ORDER BY encode(name)) AS by_letter, count(*) OVER (PARTITION BY p_brand, {_READ}) AS alike FROM ({_SPELLED.format(part='part')})")
def q_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each part's name in its brand, without case and accents and letter by letter, and how many read like it."""
    x = spark.sql(_SPELLED.replace("{part}", "{p}"), p=_table(spark, sf_dir, "part")).withColumn("_read", collation.read(F.col("name")))
    place = lambda c: F.rank().over(Window.partitionBy("p_brand").orderBy(c)).cast("long")
    alike = F.count(F.lit(1)).over(Window.partitionBy("p_brand", "_read"))
    return x.select("p_partkey", "name", place("_read").alias("as_read"), place("name").alias("by_letter"), alike.alias("alike"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN NULL ELSE c_nationkey END AS nation, CASE c_custkey % 4 WHEN 3 THEN NULL ELSE n_regionkey END AS region FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q_reading_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of customers by names that are spelled in several ways, or not at all like a nation's."""
    nation = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    turn = F.col("c_custkey") % 4
    spelled = F.when(turn == 0, F.lower("name")).when(turn == 1, F.translate("name", "AEIO", "ÀÉÎÖ")).when(turn == 2, F.col("name")).otherwise(F.concat("name", F.lit("?")))
    rows = _table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("nation")).select("c_custkey", spelled.alias("name"))
    return collation.looked_up(rows, nation, "name").select("c_custkey", "nation", "region")


@query(f"SELECT invoice_id, correct, row_number() OVER (ORDER BY correct DESC, invoice_id) - 1 AS position FROM (SELECT invoice_id, count(*) FILTER (ok) AS correct FROM ({_CELLS}) GROUP BY 1)")
def q_sorted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by fields found, written in order and read back with their places."""
    at = f"{fixtures.folder(spark, 'sorted')}/scores"
    told = results.scored(_reconciled(spark, sf_dir), fields(spark, sf_dir)).groupBy("invoice_id").agg(F.count_if("ok").alias("correct"))
    ordered.write_ordered(told, at, ["correct", "invoice_id"], descending=("correct",))
    return ordered.read_ordered(spark, at)


# -- scores, accuracy, files


@query(
    f"""SELECT a.invoice_id, a.pos, round(1000 - greatest(0, b.x1 - a.x2) * 10 - abs((b.y1 + b.y2) / 2 - (a.y1 + a.y2) / 2) * 5 + b.confidence * 100, 6) AS in_line,
  round(800 - greatest(0, greatest(a.y1, b.y1) - least(a.y2, b.y2)) * 10 - abs((b.x1 + b.x2) / 2 - (a.x1 + a.x2) / 2) * 2 + b.confidence * 100, 6) AS apart
FROM ({LINES}) a JOIN ({LINES}) b ON a.invoice_id = b.invoice_id AND b.pos = a.pos + 1"""
)
def q_general_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general score of each line as the value of the line before, as if in one line and as if apart."""
    w = Window.partitionBy("invoice_id").orderBy("pos")
    x = synth.ocr_lines(spark, sf_dir).withColumn("b", F.lead("box").over(w)).withColumn("c", F.lead("confidence").over(w)).withColumn("p", F.lead("pos").over(w)).where("p = pos + 1")
    score = lambda same: F.round(g.score_general(F.col("box"), F.col("b"), F.col("c"), same), 6)
    return x.select("invoice_id", "pos", score(True).alias("in_line"), score(False).alias("apart"))


_BEFORE = ", ".join(f"('{f}', {v * 100})" for f, v in results.BASELINE.items())


@query(
    f"""SELECT field, correct, total, round(percent, 6) AS percent, round(percent - before, 6) AS change, CASE WHEN percent > before THEN 'UP' WHEN percent < before THEN 'DOWN' WHEN percent = before THEN 'SAME' END AS status
FROM (SELECT *, correct * 100.0::DOUBLE / total AS percent FROM (SELECT coalesce(field, 'overall') AS field, count(*) FILTER (ok) AS correct, count(*) AS total FROM ({_CELLS}) GROUP BY ROLLUP (field))) LEFT JOIN (VALUES {_BEFORE}) AS b(f, before) ON field = f WHERE field <> 'overall'"""
)
def q_field_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of documents right in each field, against what it was before."""
    told = results.field_accuracy(results.scored(_reconciled(spark, sf_dir), fields(spark, sf_dir))).where("field != 'overall'")
    return results.against_baseline(told).select("field", "correct", "total", F.round("percent", 6).alias("percent"), F.round("change", 6).alias("change"), "status")


_ENDINGS = ["PDF", "jpeg", "tif", "txt"]


@query(
    "SELECT doc_id, 'doc.' || doc_id || '.' || e AS name, CASE WHEN doc_id % 5 = 0 THEN '?' WHEN n_chars < 1024 THEN n_chars || ' B' ELSE (((n_chars * 10 + 512) // 1024) // 10) || '.' || (((n_chars * 10 + 512) // 1024) % 10) || ' KB' END AS size_text,"
    " CASE e WHEN 'PDF' THEN '📋' WHEN 'txt' THEN '📄' ELSE '🖼' END AS sign FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'PDF' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'tif' ELSE 'txt' END AS e FROM documents)"
)
def q_file_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as a list shows them: name, size and sign of their kind."""
    d = _table(spark, sf_dir, "documents")
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(F.when(F.col("doc_id") % 2 == 0, "C:\\in\\").otherwise("/in/"), F.lit("doc."), F.col("doc_id").cast("string"), F.lit("."), ending)
    return d.select("doc_id", results.file_item(path, F.when(F.col("doc_id") % 5 != 0, F.col("n_chars"))).alias("i")).select("doc_id", "i.*")


@query("SELECT event_id, event_type AS text, CASE event_id % 2 WHEN 0 THEN 0.8 ELSE 0.0 END::DOUBLE AS confidence FROM events")
def q_scalar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of older replies whose text comes with a score or alone."""
    e = _table(spark, sf_dir, "events")
    quoted = F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    told = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), quoted, F.lit(",0.8]"))).otherwise(quoted)
    reply = F.concat(F.lit("[[[[0,0],[9,9]],"), told, F.lit("]]"))
    return e.select("event_id", F.explode(pages.older_payload_lines(reply)).alias("l")).select("event_id", "l.text", "l.confidence")


# -- rows of lines that overlap in part, and in chains

_SCATTERED = """SELECT CAST(l_orderkey AS VARCHAR(20)) AS invoice_id, l_linenumber AS pos, CAST(l_partkey * 7 % 60 AS DOUBLE) AS y1, CAST(l_partkey * 7 % 60 + CASE l_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 15 ELSE 24 END AS DOUBLE) AS y2,
  CAST(l_suppkey * 37 % 400 AS DOUBLE) AS x1, CAST(l_suppkey * 37 % 400 + 40 AS DOUBLE) AS x2 FROM {lineitem}"""


@query(
    f"""WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY y1, pos) AS n FROM ({_SCATTERED.format(lineitem="lineitem")})),
  r(invoice_id, n, parent, seeds) AS (SELECT invoice_id, n, n, [{{'n': n, 'y1': y1, 'y2': y2}}] FROM l WHERE n = 1
    UNION ALL SELECT invoice_id, n, coalesce(joined, n), CASE WHEN joined IS NULL THEN list_append(seeds, {{'n': n, 'y1': y1, 'y2': y2}}) ELSE seeds END
    FROM (SELECT l.invoice_id, l.n, l.y1, l.y2, r.seeds, list_filter(r.seeds, lambda s: least(s.y2 - s.y1, l.y2 - l.y1) > 0 AND (least(s.y2, l.y2) - greatest(s.y1, l.y1)) / least(s.y2 - s.y1, l.y2 - l.y1) > 0.5)[1].n AS joined
      FROM r JOIN l ON l.invoice_id = r.invoice_id AND l.n = r.n + 1)),
  cut AS (SELECT l.*, r.parent, CASE WHEN greatest(y2 - y1, lag(y2 - y1) OVER w) > 0 AND x1 - lag(x2) OVER w > 5 * greatest(y2 - y1, lag(y2 - y1) OVER w) THEN 1 ELSE 0 END AS c
    FROM l JOIN r ON l.invoice_id = r.invoice_id AND l.n = r.n WINDOW w AS (PARTITION BY l.invoice_id, r.parent ORDER BY x1, l.n)),
  part AS (SELECT *, sum(c) OVER (PARTITION BY invoice_id, parent ORDER BY x1, n) AS p FROM cut),
  placed AS (SELECT *, avg((y1 + y2) / 2) OVER (PARTITION BY invoice_id, parent, p) AS my, avg((x1 + x2) / 2) OVER (PARTITION BY invoice_id, parent, p) AS mx FROM part)
SELECT invoice_id, pos, CAST(dense_rank() OVER (PARTITION BY invoice_id ORDER BY parent, my, mx, p) - 1 AS INT) AS row_idx, CAST(row_number() OVER (PARTITION BY invoice_id, parent, p ORDER BY x1, n) - 1 AS INT) AS col_idx FROM placed"""
)
def q_cluster_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual rows of lines scattered over a page, which overlap by any share, in chains, and some without height."""
    flat = spark.sql(_SCATTERED.replace("{lineitem}", "{l}"), l=_table(spark, sf_dir, "lineitem"))
    lines = synth.boxed(flat.select("*", F.lit("t").alias("text"), F.lit(0.9).alias("confidence"), F.lit(0).alias("page_index"), F.lit(0).alias("line_index")))
    return layout.visual_rows(lines).select("invoice_id", "pos", "row_idx", "col_idx")


# -- the rate that an issue tells

_RATED = "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,3)) AS ht, CAST(l_quantity * (l_partkey % 60) * 7 AS DECIMAL(18,3)) AS tva FROM {lineitem}"


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN ht > 0 AND tva > 0 AND (tva < ht * 0.05 OR tva > ht * 0.30) THEN 'Unlikely VAT rate: ' || printf('%.1f', CAST(tva AS DOUBLE) / CAST(ht AS DOUBLE) * 100) || '%' END AS issue FROM ({_RATED.format(lineitem='lineitem')})")
def q_vat_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of amounts whose rate is unlikely, the rate included."""
    x = spark.sql(_RATED.replace("{lineitem}", "{l}"), l=_table(spark, sf_dir, "lineitem"))
    told = x.select("l_orderkey", "l_linenumber", F.col("ht").cast("string").alias("montant_ht"), F.col("tva").cast("string").alias("montant_tva"), *[F.lit(None).cast("string").alias(c) for c in lx.FIELDS if c not in ("montant_ht", "montant_tva")])
    rate = F.filter(amounts.issues(), lambda i: i.startswith("Unlikely VAT rate"))
    return told.select("l_orderkey", "l_linenumber", F.get(rate, F.lit(0)).alias("issue"))
