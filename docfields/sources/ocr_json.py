"""Sources: recognised lines as JSON files, ground truth as CSV, folders of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.functions import lexicon as lx

#: File name endings that are documents, and their content types.
CONTENT_TYPES = {"pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff"}
LINE = "array<struct<text:string,box:struct<x1:double,y1:double,x2:double,y2:double>,confidence:double,page_index:int,line_index:int>>"


def read_ocr_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of lines per file: lines with pos, their place in the array; line_index 0 where
    absent; invoice_id is the file's name without its ending. A file is one row, as its order counts."""
    return lines_of(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value"))


def lines_of(files: DataFrame) -> DataFrame:
    """Lines of files given by name and value (their text)."""
    files = files.select("name", F.from_json("value", LINE).alias("lines"))
    flat = files.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("invoice_id"), F.posexplode("lines").alias("pos", "l"))
    return flat.select("invoice_id", "pos", "l.text", "l.box", "l.confidence", F.coalesce("l.page_index", F.lit(0)).alias("page_index"), F.coalesce("l.line_index", F.lit(0)).alias("line_index"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth CSV with a header, all strings; of rows with one invoice_id the last of its file."""
    schema = ", ".join(f"`{c}` string" for c in ("invoice_id", *lx.FIELDS))
    rows = spark.read.csv(path, header=True, schema=schema).withColumn("_n", F.monotonically_increasing_id())
    last = rows.groupBy("invoice_id").agg(F.max_by(F.struct(*lx.FIELDS), "_n").alias("r"))
    return last.select("invoice_id", "r.*")


def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a folder, not of those in it: path, name, kind, length, content, in order of path."""
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").load(folder).withColumn("name", name).withColumn("kind", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)))
    return files.where(F.col("kind").isin(*CONTENT_TYPES)).select("path", "name", "kind", "length", "content").orderBy("path")


def content_type(path):
    """Content type by a path's ending."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    table = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    return F.coalesce(table[ending], F.lit("application/octet-stream"))


def payload_lines(payload):
    """Lines of a recogniser's reply (JSON with rec_texts, rec_scores, rec_polys): structs of text, confidence,
    box; a missing score is 0, a missing polygon a null box; without texts there are no lines."""
    from docfields.functions.geometry import envelope

    reply = F.from_json(payload, "rec_texts array<string>, rec_scores array<double>, rec_polys array<array<array<double>>>")
    scores = F.coalesce(reply["rec_scores"], F.array().cast("array<double>"))
    polygons = F.coalesce(reply["rec_polys"], F.array().cast("array<array<array<double>>>"))
    line = lambda t, i: F.struct(t.alias("text"), F.coalesce(F.get(scores, i), F.lit(0.0)).alias("confidence"), envelope(F.get(polygons, i)).alias("box"))
    return F.transform(reply["rec_texts"], line)

