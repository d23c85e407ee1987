"""Documents made from the driver's tables: SQL that Spark and DuckDB read alike.

Every order gives one invoice. Its layout follows from the key: label and value side by
side, in one line, one below the other, apart by more than five heights, in two columns.
Amounts, labels and dates take turns so that every rule has cases on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.functions import geometry as g

#: What an order and its customer give.
BASE = """      SELECT o_orderkey AS k, 'DOC-' || CAST(o_orderkey AS STRING) AS invoice_id, o_orderkey % 5 AS lay, CAST(floor(o_orderkey / 5) AS BIGINT) % 3 AS lang,
        year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, CAST(o_totalprice AS DECIMAL(18,3)) AS ht,
        'SARL Moderne ' || CAST(o_orderkey % 97 AS STRING) AS supplier_text, c_name AS client_text,
        substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 10) AS iso_date
      FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

#: One row per order: the truth and the texts as printed.
DOCUMENTS = (
    """
SELECT k, invoice_id, lay, lang, number_text, date_text, iso_date, supplier_text, client_text, ht, tva, taxe, ttc,
  CASE lang WHEN 0 THEN replace(CAST(ht AS STRING), '.', ',') || ' TND' WHEN 1 THEN '$ ' || CAST(ht AS STRING) ELSE CAST(ht AS STRING) || ' €' END AS ht_text,
  CASE lang WHEN 0 THEN replace(CAST(tva AS STRING), '.', ',') || ' TND' WHEN 1 THEN '20% ' || CAST(tva AS STRING) ELSE CAST(tva AS STRING) || ' DT' END AS tva_text,
  CAST(taxe AS STRING) AS taxe_text,
  CASE lang WHEN 0 THEN replace(CAST(ttc AS STRING), '.', ',') WHEN 1 THEN '$' || CAST(ttc AS STRING) ELSE CAST(ttc AS STRING) || ' TND' END AS ttc_text
FROM (
  SELECT k, invoice_id, lay, lang, number_text, iso_date, supplier_text, client_text, ht, tva, taxe,
    CASE lang WHEN 2 THEN CAST(d AS STRING) || ' ' || CASE m WHEN 1 THEN 'janvier' WHEN 2 THEN 'février' WHEN 3 THEN 'mars' WHEN 4 THEN 'avril' WHEN 5 THEN 'mai'
        WHEN 6 THEN 'juin' WHEN 7 THEN 'juillet' WHEN 8 THEN 'août' WHEN 9 THEN 'septembre' WHEN 10 THEN 'octobre' WHEN 11 THEN 'novembre' ELSE 'décembre' END || ' ' || CAST(y AS STRING)
      WHEN 1 THEN lpad(CAST(d AS STRING), 2, '0') || '-' || lpad(CAST(m AS STRING), 2, '0') || '-' || CAST(y AS STRING)
      ELSE CAST(d AS STRING) || '/' || CAST(m AS STRING) || '/' || CAST(y AS STRING) END AS date_text,
    CASE k % 7 WHEN 0 THEN ht + tva + coalesce(taxe, CAST(0 AS DECIMAL(18,3))) + CAST(0.01 AS DECIMAL(18,3))
      WHEN 1 THEN ht + tva + CAST(0.6 AS DECIMAL(18,3)) WHEN 2 THEN ht + tva - CAST(5 AS DECIMAL(18,3))
      WHEN 3 THEN ht WHEN 4 THEN NULL ELSE ht + tva + coalesce(taxe, CAST(0 AS DECIMAL(18,3))) END AS ttc
  FROM (
    SELECT k, invoice_id, lay, lang, y, m, d, ht, supplier_text, client_text, iso_date,
      CASE k % 9 WHEN 0 THEN CAST(k AS STRING) WHEN 1 THEN 'FAC-' || CAST(y AS STRING) || '-' || CAST(k AS STRING) ELSE 'INV-' || CAST(y AS STRING) || '-' || lpad(CAST(k AS STRING), 7, '0') END AS number_text,
      CASE k % 11 WHEN 0 THEN ht WHEN 1 THEN NULL ELSE CAST(ht * CASE k % 4 WHEN 0 THEN CAST(0.07 AS DECIMAL(3,2)) WHEN 1 THEN CAST(0.13 AS DECIMAL(3,2)) WHEN 2 THEN CAST(0.19 AS DECIMAL(3,2)) ELSE CAST(0.03 AS DECIMAL(3,2)) END AS DECIMAL(18,3)) END AS tva,
      CASE k % 3 WHEN 0 THEN CAST(1 AS DECIMAL(18,3)) WHEN 1 THEN CAST(0 AS DECIMAL(18,3)) ELSE NULL END AS taxe
    FROM (
"""
    + BASE
    + """    ) AS base
  ) AS priced
) AS totalled
"""
)

#: Its recognised lines: two per field, a decoy and a faint one; pos is their order.
LINES = (
    """
SELECT invoice_id, n AS pos, txt AS text, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x1 + 80 AS DOUBLE) AS x2, CAST(y1 + 15 AS DOUBLE) AS y2,
  CASE WHEN n = 17 THEN CAST(0.2 AS DOUBLE) WHEN (k + n) % 23 = 0 THEN CAST(0.5 AS DOUBLE) WHEN n % 2 = 0 THEN CAST(0.95 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS confidence,
  0 AS page_index, n AS line_index
FROM (
  SELECT k, invoice_id, n,
    CASE WHEN n = 16 THEN '123 rue de Tunis, 1000, Tunis' WHEN n = 17 THEN 'tache'
      WHEN n % 2 = 0 AND lay = 1 THEN label || ' : ' || val WHEN n % 2 = 0 THEN label WHEN lay = 1 THEN NULL ELSE val END AS txt,
    CASE WHEN n >= 16 OR n % 2 = 0 THEN 10 WHEN lay = 2 THEN 10 WHEN lay = 3 THEN 170 WHEN lay = 4 THEN 390 ELSE 100 END AS x1,
    CASE WHEN n % 2 = 1 AND n < 16 AND lay = 2 THEN 40 + 50 * CAST(floor(n / 2) AS INT) ELSE 20 + 50 * CAST(floor(n / 2) AS INT) END AS y1
  FROM (
    SELECT k, invoice_id, lay, n,
      CASE CAST(floor(n / 2) AS INT)
        WHEN 0 THEN CASE lang WHEN 0 THEN 'N° Facture' WHEN 1 THEN 'Invoice No' ELSE 'Numéro de facture' END
        WHEN 1 THEN CASE lang WHEN 0 THEN 'Date' WHEN 1 THEN 'Invoice Date' ELSE 'Date de facturation' END
        WHEN 2 THEN CASE lang WHEN 0 THEN 'Fournisseur' WHEN 1 THEN 'Supplier' ELSE 'Émetteur' END
        WHEN 3 THEN CASE lang WHEN 0 THEN 'Client' WHEN 1 THEN 'Bill to' ELSE 'Destinataire' END
        WHEN 4 THEN CASE lang WHEN 0 THEN 'Total HT' WHEN 1 THEN 'Subtotal' ELSE 'Montant HT' END
        WHEN 5 THEN CASE lang WHEN 0 THEN 'TVA' WHEN 1 THEN 'VAT' ELSE 'Montant TVA' END
        WHEN 6 THEN CASE lang WHEN 0 THEN 'Timbre fiscal' WHEN 1 THEN 'Stamp duty' ELSE 'Taxe' END
        WHEN 7 THEN CASE lang WHEN 0 THEN 'Total TTC' WHEN 1 THEN 'Grand total' ELSE 'Net à payer' END END AS label,
      CASE CAST(floor(n / 2) AS INT) WHEN 0 THEN number_text WHEN 1 THEN date_text WHEN 2 THEN supplier_text WHEN 3 THEN client_text
        WHEN 4 THEN ht_text WHEN 5 THEN tva_text WHEN 6 THEN taxe_text WHEN 7 THEN ttc_text END AS val
    FROM ("""
    + DOCUMENTS
    + """) AS docs
    CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15), (16), (17)) AS numbers(n)
  ) AS printed
  WHERE n >= 16 OR val IS NOT NULL
) AS placed
WHERE txt IS NOT NULL
"""
)

#: Invoices whose extraction is known: the key and the texts as printed. Layouts: 0 value beside its label, a little
#: lower and less high; 1 in one line with it, absent where there is none; 2 below; 3 apart by more than
#: five heights, amounts on a second page; 4 further apart. Only layout 1 leaves values out.
INVOICES = (
    """
SELECT k, invoice_id, lay, lang, CASE k % 9 WHEN 0 THEN 'REF-2024-' || CAST(k AS STRING) ELSE number_text END AS number_text, date_text, iso_date, supplier_text,
  'Maison ' || CAST(k % 89 AS STRING) AS client_text, ht, tva, taxe, ttc, ht_text,
  CASE lang WHEN 0 THEN replace(CAST(tva AS STRING), '.', ',') || ' TND' WHEN 1 THEN '20% ' || CAST(tva AS STRING) ELSE CAST(tva AS STRING) || ' DT' END AS tva_text,
  CAST(taxe AS STRING) AS taxe_text, CASE lang WHEN 0 THEN replace(CAST(ttc AS STRING), '.', ',') WHEN 1 THEN '$' || CAST(ttc AS STRING) ELSE CAST(ttc AS STRING) || ' TND' END AS ttc_text
FROM (
  SELECT k, invoice_id, lay, lang, number_text, date_text, iso_date, supplier_text, ht, ht_text,
    CASE WHEN lay <> 1 THEN coalesce(tva, CAST(12.5 AS DECIMAL(18,3))) ELSE tva END AS tva, CASE WHEN lay <> 1 THEN coalesce(taxe, CAST(0.6 AS DECIMAL(18,3))) ELSE taxe END AS taxe,
    CASE WHEN lay <> 1 THEN coalesce(ttc, ht + CAST(13.1 AS DECIMAL(18,3))) ELSE ttc END AS ttc
  FROM ("""
    + DOCUMENTS
    + """) AS made) AS filled
"""
)

#: Their recognised lines. An address stands below the amounts, near them in every sixth invoice.
INVOICE_LINES = (
    """
SELECT invoice_id, n AS pos, txt AS text, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x1 + 80 AS DOUBLE) AS x2, CAST(y1 + high AS DOUBLE) AS y2,
  CASE WHEN n = 17 THEN CAST(0.2 AS DOUBLE) WHEN (k + n) % 23 = 0 THEN CAST(0.5 AS DOUBLE) WHEN n % 2 = 0 THEN CAST(0.95 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS confidence,
  page_index, n AS line_index
FROM (
  SELECT k, invoice_id, n,
    CASE WHEN n = 16 THEN '123 rue de Tunis, 1000, Tunis' WHEN n = 17 THEN 'tache'
      WHEN n % 2 = 0 AND lay = 1 THEN label || ' : ' || val WHEN n % 2 = 0 THEN label WHEN lay = 1 THEN NULL ELSE val END AS txt,
    CASE WHEN n >= 16 OR n % 2 = 0 THEN 10 WHEN lay = 2 THEN 10 WHEN lay = 3 THEN 167 WHEN lay = 4 THEN 250 ELSE 100 END AS x1,
    CASE WHEN n >= 16 THEN CASE WHEN k % 6 = 0 THEN 420 ELSE 900 END
      ELSE CASE WHEN lay = 3 AND n >= 8 THEN -180 ELSE 20 END + 50 * CAST(floor(n / 2) AS INT) + CASE WHEN n % 2 = 1 AND lay = 2 THEN 20 WHEN n % 2 = 1 AND lay = 0 THEN 3 ELSE 0 END END AS y1,
    CASE WHEN n % 2 = 1 AND lay = 0 THEN 12 ELSE 15 END AS high, CASE WHEN lay = 3 AND n >= 8 THEN 1 ELSE 0 END AS page_index
  FROM (
    SELECT k, invoice_id, lay, n,
      CASE CAST(floor(n / 2) AS INT)
        WHEN 0 THEN CASE lang WHEN 0 THEN 'N° Facture' WHEN 1 THEN CASE lay WHEN 2 THEN 'Invoice Number' ELSE 'Order Number' END ELSE 'Numéro de facture' END
        WHEN 1 THEN CASE lang WHEN 0 THEN 'Date' WHEN 1 THEN 'Invoice Date' ELSE 'Date de facturation' END
        WHEN 2 THEN CASE lang WHEN 0 THEN 'Fournisseur' WHEN 1 THEN 'Supplier' ELSE 'Émetteur' END
        WHEN 3 THEN CASE lang WHEN 0 THEN 'Client' WHEN 1 THEN 'Customer' ELSE 'Destinataire' END
        WHEN 4 THEN CASE lang WHEN 0 THEN 'Total HT' WHEN 1 THEN 'Subtotal' ELSE 'Montant HT' END
        WHEN 5 THEN CASE lang WHEN 0 THEN 'TVA' WHEN 1 THEN 'VAT' ELSE 'Montant TVA' END
        WHEN 6 THEN CASE lang WHEN 0 THEN 'Timbre fiscal' WHEN 1 THEN 'Stamp duty' ELSE 'Taxe' END
        WHEN 7 THEN CASE lang WHEN 0 THEN 'Total TTC' WHEN 1 THEN 'Grand total' ELSE 'Net à payer' END END AS label,
      CASE CAST(floor(n / 2) AS INT) WHEN 0 THEN number_text WHEN 1 THEN date_text WHEN 2 THEN supplier_text WHEN 3 THEN client_text
        WHEN 4 THEN ht_text WHEN 5 THEN tva_text WHEN 6 THEN taxe_text WHEN 7 THEN ttc_text END AS val
    FROM ("""
    + INVOICES
    + """) AS docs
    CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15), (16), (17)) AS numbers(n)
  ) AS printed
  WHERE n >= 16 OR val IS NOT NULL
) AS placed
WHERE txt IS NOT NULL
"""
)

DUCK = {"orders": "orders", "customer": "customer"}


def duck(sql: str) -> str:
    """The SQL over DuckDB's tables."""
    return sql.format(**DUCK)


#: Labels as printed in each language.
_LABELS = ("{number}|Date|Fournisseur|Client|Total HT|TVA|Timbre fiscal|Total TTC", "{number}|Invoice Date|Supplier|{client}|Subtotal|VAT|Stamp duty|Grand total", "{number}|Date de facturation|Émetteur|Destinataire|Montant HT|Montant TVA|Taxe|Net à payer")
#: What the number's label is in each language, and the client's in English, in LINES.
_NUMBER, _CLIENT = ("'N° Facture'", "'Invoice No'", "'Numéro de facture'"), "Bill to"
_VALUES = ("number_text", "date_text", "supplier_text", "client_text", "ht_text", "tva_text", "taxe_text", "ttc_text")


def _made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Documents by the SQL. What orders and customers give is dealt out anew, as a small file of orders is one task and each
    makes many lines; so the steps before and behind are compiled apart, each small enough for the JVM to compile in turn.
    They are dealt by invoice_id, as operators want lines: Spark then leaves out their own exchange, of many lines a document."""
    base = spark.sql(BASE, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in DUCK})
    return spark.sql(sql.replace(f"(\n{BASE}    )", "{base}"), base=base.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "invoice_id"))


def _labels(first: tuple[str, ...], client: str) -> list[str]:
    """Each field's label in a document's language."""
    own = [said.replace("{client}", client).split("|") for said in _LABELS]
    return ["CASE lang WHEN 0 THEN {} WHEN 1 THEN {} ELSE {} END".format(*(first if f == 0 else [f"'{x[f]}'" for x in own])) for f in range(len(_VALUES))]


def _printed(docs: DataFrame, first: tuple[str, ...], client: str, x1: str, y1: str, high: str, page: str) -> DataFrame:
    """The lines that LINES and INVOICE_LINES state. A document's texts are an array of its own columns, which is taken apart;
    a line's place, page and confidence are worked out from its number then. Each step is compiled, which a function over an array of lines is
    not, and documents stay dealt as they are. A join with the numbers is one piece of code too large for the JVM to compile.

    first: what the number's label is in each language; client: the client's in English; x1, y1, high, page: of line n, as in the SQL."""

    def text(n: int) -> str:
        if n >= 16:
            return "'tache'" if n == 17 else "'123 rue de Tunis, 1000, Tunis'"
        value, label = _VALUES[n // 2], f"label_{n // 2}"
        return f"CASE WHEN lay = 1 THEN {label} || ' : ' || {value} WHEN {value} IS NOT NULL THEN {label} END" if n % 2 == 0 else f"CASE WHEN lay = 1 THEN NULL ELSE {value} END"

    own = docs.selectExpr("invoice_id", "k", "lay", *_VALUES, *[f"{label} AS label_{f}" for f, label in enumerate(_labels(first, client))])
    # outer, or Spark asks the array's size before the documents are dealt, in one piece of code with all its texts
    l = own.selectExpr("invoice_id", "k", "lay", f"array({', '.join(map(text, range(18)))}) AS texts").selectExpr("invoice_id", "k", "lay", "posexplode_outer(texts) AS (n, text)").where("text IS NOT NULL")
    sure = "CASE WHEN n = 17 THEN CAST(0.2 AS DOUBLE) WHEN (k + n) % 23 = 0 THEN CAST(0.5 AS DOUBLE) WHEN n % 2 = 0 THEN CAST(0.95 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END"
    l = l.selectExpr("invoice_id", "n", "text", f"CAST({x1} AS INT) AS x1", f"CAST({y1} AS INT) AS y1", f"CAST({high} AS INT) AS high", f"{sure} AS confidence", f"CAST({page} AS INT) AS page_index")
    return l.selectExpr(
        "invoice_id", "n AS pos", "text", *[f"CAST({v} AS DOUBLE) AS {c}" for v, c in (("x1", "x1"), ("y1", "y1"), ("x1 + 80", "x2"), ("y1 + high", "y2"))], "confidence", "page_index", "n AS line_index"
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """invoice_id, the printed texts and the truth."""
    return _made(spark, sf_dir, DOCUMENTS)


def flat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LINES: lines with their box in four columns."""
    x1 = "CASE WHEN n >= 16 OR n % 2 = 0 THEN 10 WHEN lay = 2 THEN 10 WHEN lay = 3 THEN 170 WHEN lay = 4 THEN 390 ELSE 100 END"
    y1 = "CASE WHEN n % 2 = 1 AND n < 16 AND lay = 2 THEN 40 + 50 * (n DIV 2) ELSE 20 + 50 * (n DIV 2) END"
    return _printed(documents(spark, sf_dir), _NUMBER, _CLIENT, x1, y1, "15", "0")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LINES without boxes: invoice_id, pos, text. A document is taken apart by UNPIVOT, which is compiled, as what
    reads the lines then is too; a generator's array is interpreted. For queries that read no box."""
    own = [f"{label} AS label_{f}" for f, label in enumerate(_labels(_NUMBER, _CLIENT))]
    docs = documents(spark, sf_dir).selectExpr(
        "invoice_id", "lay", *_VALUES, *own, "CAST(NULL AS STRING) AS bare", "'123 rue de Tunis, 1000, Tunis' AS address", "'tache' AS faint", *[f"{n} AS n{n}" for n in range(18)]
    )
    places = [f"(n{n}, {'bare' if n % 2 else f'label_{n // 2}'}, {_VALUES[n // 2]})" for n in range(16)] + ["(n16, bare, address)", "(n17, bare, faint)"]
    lines = spark.sql(f"SELECT * FROM {{docs}} UNPIVOT INCLUDE NULLS ((pos, label, val) FOR place IN ({', '.join(places)}))", docs=docs)
    return lines.where("val IS NOT NULL AND (pos >= 16 OR label IS NOT NULL OR NOT lay <=> 1)").selectExpr(
        "invoice_id", "pos", "CASE WHEN label IS NULL THEN val WHEN lay = 1 THEN label || ' : ' || val ELSE label END AS text"
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts and values of the invoices whose extraction is known."""
    return _made(spark, sf_dir, INVOICES)


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INVOICE_LINES, as operators take them."""
    x1 = "CASE WHEN n >= 16 OR n % 2 = 0 THEN 10 WHEN lay = 2 THEN 10 WHEN lay = 3 THEN 167 WHEN lay = 4 THEN 250 ELSE 100 END"
    y1 = """CASE WHEN n >= 16 THEN CASE WHEN k % 6 = 0 THEN 420 ELSE 900 END
      ELSE CASE WHEN lay = 3 AND n >= 8 THEN -180 ELSE 20 END + 50 * (n DIV 2) + CASE WHEN n % 2 = 1 AND lay = 2 THEN 20 WHEN n % 2 = 1 AND lay = 0 THEN 3 ELSE 0 END END"""
    high, page = "CASE WHEN n % 2 = 1 AND lay = 0 THEN 12 ELSE 15 END", "CASE WHEN lay = 3 AND n >= 8 THEN 1 ELSE 0 END"
    number = ("'N° Facture'", "CASE lay WHEN 2 THEN 'Invoice Number' ELSE 'Order Number' END", "'Numéro de facture'")
    return boxed(_printed(invoices(spark, sf_dir), number, "Customer", x1, y1, high, page))


def boxed(lines: DataFrame) -> DataFrame:
    """Lines with their box as a struct, as operators take them."""
    box = g.box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return lines.select("invoice_id", F.col("pos").cast("int").alias("pos"), "text", box.alias("box"), "confidence", F.col("page_index").cast("int").alias("page_index"), F.col("line_index").cast("int").alias("line_index"))


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxed(flat_lines(spark, sf_dir))
