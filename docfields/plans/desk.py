"""Queries around extraction: files and pages, replies and routing, result rows, workbooks, arrivals, SQL functions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.functions import geometry as g
from docfields.functions import lexicon as lx
from docfields.functions import text
from docfields.functions.register import register
from docfields.operators import results
from docfields.plans import fixtures, golden, synth
from docfields.plans.catalog import _RESULTS, DOCS, LINES, _norm, _results, _table, query
from docfields.sinks import sheets
from docfields.sources import ocr_json, pages, providers
from docfields.streaming.arrivals import extract_arrivals


def _values(rows: list[tuple], columns: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({columns})"


# -- files, pages, lines

#: name: content
FILES = {
    "a.PNG": fixtures.png(7, 5, 90), "b.bmp": fixtures.bmp(5, 3, (10, 20, 30)), "c.tiff": fixtures.tiff([(4, 4, 0), (6, 2, 255), (3, 9, 17)]),
    "d.pdf": b"%PDF-1.4 nothing", "e.txt": b"not a document", "f.png": b"\x89PNG broken", "g.jpg": b"",
}


def _folder(spark: SparkSession) -> str:
    at = fixtures.folder(spark, "files")
    for name, content in FILES.items():
        fixtures.put(spark, f"{at}/{name}", content)
    fixtures.put(spark, f"{at}/inner/z.png", FILES["a.PNG"])
    return at


_SCANNED = [(n, n.rsplit(".", 1)[1].lower(), len(c), f"{len(c)} B", ocr_json.CONTENT_TYPES[n.rsplit(".", 1)[1].lower()]) for n, c in FILES.items() if c and not n.endswith("txt")]


@query(_values(_SCANNED, "name, kind, length, size_text, content_type").replace("SELECT *", "SELECT name, kind, CAST(length AS BIGINT) AS length, size_text, content_type"))
def q_scan_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the folder among the paths dropped, not of those in it, with size and content type."""
    at = _folder(spark)
    found = ocr_json.scan_documents(spark, pages.dropped_folder(spark, [f"{at}/a.PNG", at]))
    return found.select("name", "kind", "length", results.size_text(F.col("length")).alias("size_text"), ocr_json.content_type(F.col("path")).alias("content_type"))


@query(_values([("b.bmp", "bmp", None), ("e.txt", "txt", "unsupported file type: .txt"), ("g.jpg", "jpg", "empty file")], "name, kind, error"))
def q_picked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files picked one by one; those that aren't read say why."""
    at = _folder(spark)
    return pages.guarded(pages.picked(spark, [f"{at}/g.jpg", f"{at}/b.bmp", f"{at}/e.txt"])).select("name", "kind", "error")


_PAGES = [
    ("a.PNG", 0, 7, 5, 90, None), ("b.bmp", 0, 5, 3, 20, None), ("c.tiff", 0, 4, 4, 0, None), ("c.tiff", 1, 6, 2, 255, None), ("c.tiff", 2, 3, 9, 17, None), ("d.pdf", 0, 8, 8, 1, None),
    ("e.txt", None, None, None, None, "unsupported file type: .txt"), ("f.png", None, None, None, None, "corrupt file: error"), ("g.jpg", None, None, None, None, "empty file"),
]


@query(_values(_PAGES, "name, page_index, width, height, middle, error"))
def q_decode_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and frames of files, with the green of the first pixel; PDF by a decoder that stands for one."""
    import numpy as np

    at = _folder(spark)
    files = pages.picked(spark, [f"{at}/{n}" for n in FILES])
    got = pages.pages_of(files, {"pdf": lambda content: [np.full((8, 8, 3), 1, np.uint8)]})
    green = F.conv(F.hex(F.substring("pixels", 2, 1)), 16, 10).cast("int")
    return got.select(F.element_at(F.split("path", "/"), -1).alias("name"), "page_index", "width", "height", green.alias("middle"), "error")


_INK = [("a.PNG", 0, 7, 5), ("b.bmp", 0, 5, 3), ("c.tiff", 0, 4, 4), ("c.tiff", 2, 3, 9)]


@query(_values([(n, p, 0, "ink", 30, 30, 30 + w, 30 + h) for n, p, w, h in _INK], "name, page_index, pos, text, x1, y1, x2, y2"))
def q_recognise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages from a stand-in recogniser; boxes include the white border."""
    at = _folder(spark)
    got = pages.recognised(pages.pages_of(pages.picked(spark, [f"{at}/{n}" for n in FILES])))
    return got.select(F.element_at(F.split("path", "/"), -1).alias("name"), "page_index", "pos", "text", *[F.col(f"box.{c}").cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(
    "SELECT event_id, form, n, text, confidence, x2 FROM (SELECT event_id, form, 0 AS n, event_type AS text, CASE form WHEN 'new' THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence, CAST(event_id % 50 + 10 AS DOUBLE) AS x2 FROM events, (VALUES ('new'), ('old'), ('wrapped')) AS f(form)"
    " UNION ALL SELECT event_id, form, 1, 'b', 0.0::DOUBLE, NULL FROM events, (VALUES ('new')) AS f(form))"
)
def q_payload_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of recognisers' replies, the newer form (a score and a polygon missing) and the older, bare and wrapped."""
    e = _table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("event_id") % 50 + 10).cast("string").alias("x"))
    poly = F.concat(F.lit("[[0,0],["), "x", F.lit(",0],["), "x", F.lit(",9],[0,9]]"))
    new = F.concat(F.lit('{"rec_texts":["'), "event_type", F.lit('","b"],"rec_scores":[0.9],"rec_polys":['), poly, F.lit("]}"))
    old = F.concat(F.lit("[["), poly, F.lit(',["'), "event_type", F.lit('",0.8]]]'))
    flat = lambda form, lines: e.select("event_id", F.lit(form).alias("form"), F.posexplode(lines).alias("n", "l"))
    every = flat("new", ocr_json.payload_lines(new)).unionByName(flat("old", pages.older_payload_lines(old))).unionByName(flat("wrapped", pages.older_payload_lines(F.concat(F.lit("["), old, F.lit("]")))))
    return every.select("event_id", "form", "n", "l.text", "l.confidence", F.col("l.box.x2").alias("x2"))


_READ = [(n, p, t, b[0], b[2], c) for n, p, t, b, c, _, _ in golden.lines()]


@query(_values(_READ, "invoice_id, pos, text, x1, x2, confidence").replace("SELECT *", "SELECT invoice_id, pos, text, CAST(x1 AS DOUBLE) AS x1, CAST(x2 AS DOUBLE) AS x2, CAST(confidence AS DOUBLE) AS confidence"))
def q_read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON files, in their order."""
    got = ocr_json.read_ocr_json(spark, _golden_files(spark))
    return got.select("invoice_id", "pos", "text", "box.x1", "box.x2", "confidence")


def _golden_files(spark: SparkSession) -> str:
    at = fixtures.folder(spark, "lines")
    for name in golden.LAYOUTS:
        told = [{"text": t, "box": dict(zip(("x1", "y1", "x2", "y2"), b, strict=True)), "confidence": c, "page_index": p} for n, _, t, b, c, p, _ in golden.lines() if n == name]
        fixtures.put(spark, f"{at}/{name}.json", json.dumps(told).encode())
    return at


@query(_values([(n, *v) for n, v in golden.TRUTH.items()], "invoice_id, " + ", ".join(lx.FIELDS)))
def q_read_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth from CSV; of rows with one id the last counts."""
    at = fixtures.folder(spark, "truth")
    rows = [("synthetic_003", *"12345678"), *[(n, *v) for n, v in golden.TRUTH.items()]]
    fixtures.put(spark, f"{at}/truth.csv", "\n".join([",".join(("invoice_id", *lx.FIELDS)), *map(",".join, rows)]).encode())
    return ocr_json.read_truth(spark, at)


@query(f"SELECT invoice_id, k FROM ({DOCS}) WHERE k % 7 = 3")
def q_missing_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the truth for which nothing was read, as scoring reports them."""
    d = synth.documents(spark, sf_dir).select("invoice_id", "k")
    return d.join(d.where("k % 7 != 3").select("invoice_id"), "invoice_id", "left_anti").select("invoice_id", "k")


# -- replies and routing

_ASKED = """SELECT event_id AS place, user_id % 60 AS batch, CASE user_id % 5 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' WHEN 2 THEN 'ocr' ELSE 'auto' END AS engine, user_id % 4 <> 0 AS has_primary, user_id % 3 <> 0 AS has_secondary,
  CASE WHEN event_id % 41 = 0 THEN 429 WHEN event_id % 43 = 0 THEN 401 WHEN event_id % 11 = 0 THEN 500 ELSE 200 END AS primary_code,
  CASE WHEN event_id % 37 = 0 THEN 503 WHEN event_id % 82 = 0 THEN 429 WHEN event_id % 13 = 0 THEN 0 ELSE 200 END AS secondary_code FROM {events}"""
_GONE = "IN (401, 403, 404, 410, 429, 503)"


_ENDS = f"""SELECT *, min(place) FILTER (p_try AND p_gone) OVER (PARTITION BY batch) AS p_end FROM (SELECT *, has_primary AND engine IN ('auto', 'primary') AS p_try, engine = 'secondary' AND has_secondary AS named,
  primary_code {_GONE} AS p_gone, secondary_code {_GONE} AS s_gone FROM ({_ASKED.format(events="events")}))"""
_MACHINE = f"""SELECT *, s_open AND (named OR (engine = 'auto' AND has_secondary AND (NOT p_called OR p_gone))) AS s_called FROM (SELECT *, p_try AND coalesce(place <= p_end, true) AS p_called, coalesce(place <= s_end, true) AS s_open
  FROM (SELECT *, min(place) FILTER (s_gone AND (named OR (place = p_end AND engine = 'auto' AND has_secondary))) OVER (PARTITION BY batch) AS s_end FROM ({_ENDS})))"""
_ROUTE = """place, batch, CASE WHEN named THEN 'secondary' WHEN p_called AND NOT (p_gone AND engine = 'auto') THEN 'primary' WHEN s_called AND secondary_code = 200 THEN 'secondary' ELSE 'ocr' END AS answered_by,
  CASE WHEN named THEN NOT (s_open AND secondary_code = 200) WHEN p_called AND NOT (p_gone AND engine = 'auto') THEN primary_code <> 200 ELSE false END AS has_error"""


@query(f"SELECT {_ROUTE} FROM ({_MACHINE})")
def q_engine_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who answers for each file of each batch; a provider that fails for good isn't asked again in its batch."""
    asked = spark.sql(_ASKED.replace("{events}", "{e}"), e=_table(spark, sf_dir, "events"))
    return providers.routed(asked).select("place", "batch", "answered_by", "has_error")


@query(
    f"SELECT invoice_id, form, CASE WHEN form = 'part' THEN number_text END AS numero_facture, CASE WHEN form = 'part' THEN CAST(ht AS VARCHAR) END AS montant_ht, CAST(NULL AS VARCHAR) AS montant_ttc, CASE WHEN form = 'whole' THEN CAST(k AS VARCHAR) END AS strict_ttc, form = 'whole' AS strict_ok FROM ({DOCS}), (VALUES ('whole'), ('part'), ('text')) AS f(form)"
)
def q_cloud_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of providers' replies: fenced, with a number as value, which is an error where texts are asked for; with fields missing; not JSON."""
    d = synth.documents(spark, sf_dir).select("invoice_id", "number_text", F.col("ht").cast("string").alias("h"), F.col("k").cast("string").alias("k"))
    pair = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    some = F.concat_ws(",", pair("numero_facture", quoted(F.col("number_text"))), pair("montant_ht", quoted(F.col("h"))))
    rest = F.concat_ws(",", *[pair(f, F.col("k") if f == "montant_ttc" else F.lit("null")) for f in lx.FIELDS if f not in ("numero_facture", "montant_ht")])
    forms = {"whole": F.concat(F.lit("```json\n{"), some, F.lit(","), rest, F.lit("}\n```")), "part": F.concat(F.lit("{"), some, F.lit("}")), "text": F.lit("no fields here")}
    x = d.withColumn("r", F.explode(F.array(*[F.struct(F.lit(n).alias("form"), v.alias("reply")) for n, v in forms.items()]))).select("invoice_id", "r.*")
    x = x.withColumn("loose", providers.reply_fields(F.col("reply"), strict=False)).withColumn("strict", providers.reply_fields(F.col("reply"), strict=True))
    return x.select("invoice_id", "form", "loose.numero_facture", "loose.montant_ht", "loose.montant_ttc", F.col("strict.montant_ttc").alias("strict_ttc"), F.col("strict").isNotNull().alias("strict_ok"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 10 = 0 THEN 0 WHEN p_partkey % 3 = 0 THEN 429 ELSE 200 END AS code, CASE WHEN p_partkey % 10 = 0 THEN 'TimeoutError' ELSE p_name END AS reply FROM part")
def q_provider_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a provider replies to files, in batches; what it raises is a row."""

    def provider(path: str, content: bytes) -> tuple[int, str]:
        if int(path) % 10 == 0:
            raise TimeoutError
        return 429 if int(path) % 3 == 0 else 200, content.decode()

    files = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.encode("p_name", "utf-8").alias("content"))
    return providers.called(files, provider)


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'DENIED: no ' || event_type WHEN 1 THEN ': ' || event_type ELSE CASE WHEN length(body) > 200 THEN substr(body, 1, 200) || '…' ELSE body END END AS summary FROM (SELECT *, repeat(event_type || ' ', CAST(event_id % 60 AS INT)) AS body FROM events)")
def q_error_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a failed call's reply says."""
    kind = F.col("event_id") % 3
    body = (
        F.when(kind == 0, F.concat(F.lit('{"error":{"status":"DENIED","message":"no '), "event_type", F.lit('"}}')))
        .when(kind == 1, F.concat(F.lit('{"error":{"message":"'), "event_type", F.lit('"}}')))
        .otherwise(F.expr("repeat(event_type || ' ', CAST(event_id % 60 AS INT))"))
    )
    return _table(spark, sf_dir, "events").select("event_id", providers.body_summary(body).alias("summary"))


# -- result rows

_GRAY = ", ".join(lx.FIELDS)


@query("SELECT 'dir/' || o_orderkey || '.pdf' AS path, o_orderkey || '.pdf' AS file_name, o_orderkey % 5 = 0 AS has_error, CASE WHEN o_orderkey % 5 = 0 THEN 'HTTP 500' END AS error_message, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 0.9 END::DOUBLE AS confidence, o_orderkey % 5 = 0 OR o_orderkey % 2 = 0 AS is_incomplete FROM orders")
def q_row_constructors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of documents that were read and of those that weren't, together."""
    o = _table(spark, sf_dir, "orders").withColumn("path", F.concat(F.lit("dir/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")))
    value = lambda f: F.when((F.col("o_orderkey") % 2 == 0) & F.lit(f == "client"), " ").otherwise("x").alias(f)
    good = o.where("o_orderkey % 5 != 0").select("path", *[value(f) for f in lx.FIELDS], F.lit(0.9).alias("confidence"), F.lit("ocr").alias("engine_used"))
    both = results.from_success(good).unionByName(results.from_error(o.where("o_orderkey % 5 = 0").select("path", F.lit("HTTP 500").alias("message"))))
    return both.select("path", "file_name", "has_error", "error_message", "confidence", "is_incomplete")


@query(f"SELECT invoice_id, CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 1 THEN 'new ' || k ELSE client END AS client, CASE WHEN k % 6 = 1 THEN '7.000' ELSE montant_taxe END AS montant_taxe, k % 13 = 0 OR montant_tva IS NULL OR montant_ttc IS NULL OR k % 6 = 0 OR (montant_taxe IS NULL AND k % 6 <> 1) AS is_incomplete FROM ({_RESULTS})")
def q_inline_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after people's edits: the last of each cell counts, the placeholder empties it."""
    r = _results(spark, sf_dir)
    cell = lambda seq, f, v: F.struct(F.lit(seq).alias("seq"), F.lit(f).alias("field"), v.alias("value"))
    one = F.array(cell(1, "client", F.lit("old")), cell(2, "client", F.concat(F.lit("new "), F.col("k").cast("string"))), cell(1, "montant_taxe", F.lit("7.000")))
    edits = r.where("k % 6 < 2").select("invoice_id", F.explode(F.when(F.col("k") % 6 == 1, one).otherwise(F.array(cell(1, "client", F.lit(results.PLACEHOLDER))))).alias("e")).select("invoice_id", "e.*")
    return results.edited(r, edits, "invoice_id").select("invoice_id", "client", "montant_taxe", "is_incomplete")


@query(f"SELECT invoice_id, CASE WHEN is_incomplete AND k % 4 = 0 THEN 'removed' WHEN is_incomplete THEN 'updated' WHEN k % 4 = 1 THEN 'added' ELSE 'none' END AS change FROM ({_RESULTS}) WHERE k % 4 < 3")
def q_rerun_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reruns do to the list of incomplete rows."""
    r = _results(spark, sf_dir)
    again = r.where("k % 4 < 3").withColumn("is_incomplete", F.when(F.col("k") % 4 == 0, False).when(F.col("k") % 4 == 1, True).otherwise(F.col("is_incomplete")))
    return results.membership(r, again, "invoice_id")


@query(f"SELECT total, errors, incomplete, total - errors AS success, CASE WHEN errors > 0 THEN 'error' WHEN incomplete > 0 THEN 'warning' ELSE 'success' END AS severity FROM (SELECT count(*) AS total, count(*) FILTER (has_error) AS errors, count(*) FILTER (is_incomplete AND NOT has_error) AS incomplete FROM ({_RESULTS}))")
def q_banner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a batch and how bad they are."""
    return results.banner(results.summary(_results(spark, sf_dir)))


@query(f"SELECT invoice_id, bool_or(has_error) OVER () AS any_error FROM ({_RESULTS}) WHERE has_error")
def q_retry_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to try again."""
    return results.to_retry(_results(spark, sf_dir)).select("invoice_id", F.lit(True).alias("any_error"))


@query(f"SELECT invoice_id FROM ({_RESULTS}) WHERE is_selected")
def q_selected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that are selected."""
    return results.chosen(_results(spark, sf_dir)).select("invoice_id")


@query("SELECT o_orderstatus AS name, count(*) FILTER (o_totalprice > 100000) AS passed, count(*) AS total, round(count(*) FILTER (o_totalprice > 100000) * 100.0::DOUBLE / count(*), 6) AS percent FROM orders GROUP BY 1")
def q_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks passed of all, and in percent."""
    o = _table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("name")).agg(F.count_if(F.col("o_totalprice") > 100000).alias("passed"), F.count(F.lit(1)).alias("total"))
    return o.withColumn("percent", F.round(results.progress(F.col("passed"), F.col("total")), 6))


@query(f"SELECT invoice_id, montant_ht FROM ({_RESULTS}) ORDER BY montant_ht DESC, invoice_id LIMIT 100")
def q_grid_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of a grid sorted by an amount: as text, letter by letter."""
    return _results(spark, sf_dir).select("invoice_id", "montant_ht").orderBy(F.col("montant_ht").desc(), "invoice_id").limit(100)


@query("SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN (((b * 10 + 512) // 1024) // 10) || '.' || (((b * 10 + 512) // 1024) % 10) || ' KB' ELSE (((b * 10 + 524288) // 1048576) // 10) || '.' || (((b * 10 + 524288) // 1048576) % 10) || ' MB' END AS size_text FROM (SELECT doc_id, n_chars * (doc_id % 700) AS b FROM documents)")
def q_size_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes as people read them."""
    return _table(spark, sf_dir, "documents").select("doc_id", results.size_text(F.col("n_chars") * (F.col("doc_id") % 700)).alias("size_text"))


@query(f"SELECT invoice_id, coalesce(montant_tva, '—') AS montant_tva, CASE k % 3 WHEN 0 THEN 'Done: ' || invoice_id || ' of ' || k WHEN 1 THEN '{{_other_}}' ELSE 'Nothing' END AS message FROM ({_RESULTS})")
def q_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with a placeholder, and messages from templates."""
    key = F.when(F.col("k") % 3 == 0, "done").when(F.col("k") % 3 == 1, "other").otherwise("none")
    told = results.message({"done": "Done: {0} of {1}", "none": "Nothing"}, key, F.col("invoice_id"), F.col("k"))
    return _results(spark, sf_dir).select("invoice_id", results.placeholder(F.col("montant_tva")).alias("montant_tva"), told.alias("message"))


@query("SELECT p_partkey, CAST(CASE WHEN a <> 2 THEN sign(a - 2) WHEN b <> 4 THEN sign(b - 4) ELSE -1 END AS INT) AS compared FROM (SELECT p_partkey, p_partkey % 4 AS a, p_partkey % 9 AS b FROM part)")
def q_compare_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions against 2.4.1, words among their parts."""
    v = F.concat(F.lit("v"), (F.col("p_partkey") % 4).cast("string"), F.lit("."), (F.col("p_partkey") % 9).cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".beta").otherwise(""))
    return _table(spark, sf_dir, "part").select("p_partkey", results.compare_versions(v, F.lit("2.4.1")).alias("compared"))


# -- values of lines


@query(
    f"""SELECT a.invoice_id, a.pos, a.x2 - a.x1 AS width, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) AS h_overlap, least(a.y2, b.y2) - greatest(a.y1, b.y1) > 7.5 AS same_row, round(1000 + 100 * a.confidence, 6) AS own_score
FROM ({LINES}) a JOIN ({LINES}) b ON a.invoice_id = b.invoice_id AND b.pos = a.pos + 1"""
)
def q_line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width, overlap and sameness of row of lines that follow each other, and the score of a value in its label's line."""
    from pyspark.sql import Window

    w = Window.partitionBy("invoice_id").orderBy("pos")
    x = synth.ocr_lines(spark, sf_dir).withColumn("b", F.lead("box").over(w)).withColumn("p", F.lead("pos").over(w)).where("p = pos + 1")
    a, b = F.col("box"), F.col("b")
    return x.select("invoice_id", "pos", g.width(a).alias("width"), g.horizontal_overlap(a, b).alias("h_overlap"), g.is_same_row(a, b).alias("same_row"), F.round(g.score_same_line(F.col("confidence")), 6).alias("own_score"))


@query(
    f"""SELECT invoice_id, CAST(ht AS VARCHAR) AS amount, iso_date, 'Maison ' || k AS words, CAST(ht AS VARCHAR) AS own_amount, 'ouvelle ' || k AS own_words FROM ({DOCS})"""
)
def q_clean_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that texts hold for a field, and values behind a label in the same text."""
    d = synth.documents(spark, sf_dir)
    k = F.col("k").cast("string")
    inline = lambda field, x: text.inline_value(F.lit(field), x)
    return d.select(
        "invoice_id", text.clean_value("montant_ht", F.concat(F.lit(" : "), "ht_text")).alias("amount"), text.clean_value("date", F.col("date_text")).alias("iso_date"),
        text.clean_value("client", F.concat(F.lit("- Maison "), k, F.lit(" :"))).alias("words"), inline("montant_ht", F.concat(F.lit("Total HT : "), "ht_text")).alias("own_amount"),
        inline("client", F.concat(F.lit("Client Nouvelle "), k)).alias("own_words"),
    )


@query(f"SELECT invoice_id, pos, {_norm('text')} AS norm FROM ({LINES})")
def q_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal form of lines by the session's SQL function."""
    register(spark)
    synth.flat_lines(spark, sf_dir).createOrReplaceTempView("docfields_lines")
    return spark.sql("SELECT invoice_id, pos, normalize_text(text) AS norm FROM docfields_lines")


# -- workbooks and arrivals


@query(f"SELECT sheet, invoice_id || '.pdf' AS file_name, coalesce(montant_tva, CASE sheet WHEN 'Résultats' THEN '[MISSING]' ELSE '' END) AS montant_tva, CASE WHEN has_error THEN '—' ELSE CAST(k % 101 AS VARCHAR) || '%' END AS confidence_text FROM ({_RESULTS}), (VALUES ('Résultats'), ('Extractions Incomplètes')) AS s(sheet) WHERE sheet = 'Résultats' OR is_incomplete")
def q_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows written to workbooks, the later half appended to them, and read back."""
    at = fixtures.folder(spark, "books")
    rows = _results(spark, sf_dir).withColumn("file_name", F.concat("invoice_id", F.lit(".pdf")))
    sheets.export(rows.where("k % 2 = 0"), f"{at}/a", mark_missing=True)
    sheets.append(rows.where("k % 2 = 1"), f"{at}/a", f"{at}/b", sheet="résultats", mark_missing=True)
    names = sheets.sheet_names(sheets.books(f"{at}/b")[0])
    found = [sheets.frame(spark, f"{at}/b", n.upper()).withColumn("sheet", F.lit(n)) for n in names]
    return found[0].unionByName(found[1]).select("sheet", "file_name", "montant_tva", "confidence_text")


_ARRIVED = [(n, golden.expected(n)[0], golden.TRUTH[n][7], int(round(golden.CONFIDENCE[n] * 1e6))) for n in golden.LAYOUTS]


@query(_values(_ARRIVED, "invoice_id, numero_facture, montant_ttc, micro_confidence"))
def q_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents extracted as a stream, two files at a time, from a folder of JSON lines to a table."""
    at = fixtures.folder(spark, "arrivals")
    extract_arrivals(spark, _golden_files(spark), f"{at}/rows", f"{at}/checkpoint", at_once=2)
    got = spark.read.parquet(f"{at}/rows")
    return got.select("invoice_id", "numero_facture", "montant_ttc", F.round(F.col("confidence") * 1_000_000).cast("int").alias("micro_confidence"))
