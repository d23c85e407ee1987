"""Result rows: what is missing, export views, summaries, scoring against the truth, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions import lexicon as lx
from docfields.functions.parse import try_decimal

#: Accuracy per field before, as the scorer reports it.
BASELINE = {"numero_facture": 0.50, "fournisseur": 0.60} | {f: 0.95 for f in lx.FIELDS if f not in ("numero_facture", "fournisseur")}
PLACEHOLDER, MISSING = "—", "[MISSING]"


def is_blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def missing_fields() -> Column:
    """Names of the fields that are null or blank, in order."""
    return F.array_compact(F.array(*[F.when(is_blank(F.col(f)), F.lit(f)) for f in lx.FIELDS]))


def is_incomplete(has_error: Column) -> Column:
    return has_error | (F.size(missing_fields()) > 0)


def export_view(results: DataFrame, mode: str) -> DataFrame:
    """Rows of an export: "complete", "missing" or "both"."""
    if mode == "both":
        return results
    return results.where(~F.col("is_incomplete") if mode == "complete" else F.col("is_incomplete"))


def selection(results: DataFrame) -> DataFrame:
    """The selected rows, or all if none is selected."""
    some = results.agg(F.coalesce(F.max(F.col("is_selected").cast("int")), F.lit(0)).alias("_any"))
    return results.crossJoin(F.broadcast(some)).where("is_selected OR _any = 0").drop("_any")  # one row broadcast


def chosen(results: DataFrame) -> DataFrame:
    """The selected rows only, none if none is; a null flag isn't a selection."""
    return results.where("is_selected")


def to_retry(results: DataFrame) -> DataFrame:
    """The rows that failed, to be tried again; incomplete ones were read and stay."""
    return results.where("has_error")


def confidence_bucket(c: Column) -> Column:
    return F.when(c >= 0.75, "high").when(c >= 0.40, "medium").otherwise("low")


def export_cells(mark_missing: bool) -> list[Column]:
    """The cells of an export row as text: fields, confidence in percent (half to even), engine."""
    blank = F.lit(MISSING if mark_missing else "")
    cells = [F.when(is_blank(F.col(f)), blank).otherwise(F.col(f)).alias(f) for f in lx.FIELDS]
    percent = F.concat(F.bround(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%"))
    return [*cells, F.when(F.col("has_error"), PLACEHOLDER).otherwise(percent).alias("confidence_text"), F.when(F.col("engine_used") == "gemini", "Gemini (cloud)").otherwise("OCR local").alias("engine")]


def summary(results: DataFrame) -> DataFrame:
    """Counts of a batch: total, errors, incomplete without error, success."""
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("has_error").alias("errors"),
        F.count_if(F.col("is_incomplete") & ~F.col("has_error")).alias("incomplete"),
        F.count_if(~F.col("has_error")).alias("success"),
    )


def upsert(results: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """Rows of a rerun in place of those with the same key."""
    return results.join(again.select(key), key, "left_anti").unionByName(again.select(*results.columns))


def same_value(field: str, found: Column, truth: Column) -> Column:
    """Whether a value counts as right: amounts within 0.01, both null; others equal but for blanks around them."""
    if field in lx.AMOUNTS:
        a, b = try_decimal(found).cast("double"), try_decimal(truth).cast("double")
        return F.when(found.isNull() & truth.isNull(), True).when(found.isNull() | truth.isNull(), False).otherwise(F.coalesce(F.abs(a - b) < 0.01, F.lit(False)))
    return F.nullif(F.trim(found), F.lit("")).eqNullSafe(F.nullif(F.trim(truth), F.lit("")))


def scored(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(invoice_id, field, ok) of every field of documents that are in both."""
    t = truth.select(F.col("invoice_id").alias("_id"), *[F.col(f).alias(f"t_{f}") for f in lx.FIELDS])
    j = found.join(t, F.col("invoice_id") == F.col("_id"))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), same_value(f, F.col(f), F.col(f"t_{f}")).alias("ok")) for f in lx.FIELDS])
    return j.select("invoice_id", F.explode(pairs).alias("p")).select("invoice_id", "p.field", "p.ok")


def field_accuracy(cells: DataFrame) -> DataFrame:
    """correct and total of each field and, as field "overall", of all."""
    g = cells.rollup("field").agg(F.count_if("ok").alias("correct"), F.count(F.lit(1)).alias("total"))
    return g.withColumn("field", F.coalesce("field", F.lit("overall")))


def against_baseline(accuracy: DataFrame) -> DataFrame:
    """Adds to field_accuracy: percent right (0 without any), percent before, the change, and UP, DOWN or SAME."""
    before = F.element_at(F.create_map(*[F.lit(x) for f, v in BASELINE.items() for x in (f, v * 100)]), F.col("field"))
    percent = F.coalesce(F.try_divide(F.col("correct") * 100.0, F.col("total")), F.lit(0.0))
    x = accuracy.withColumn("percent", percent).withColumn("before", before).withColumn("change", F.col("percent") - F.col("before"))
    return x.withColumn("status", F.when(F.col("change") > 0, "UP").when(F.col("change") < 0, "DOWN").otherwise("SAME"))


def banner(counts: DataFrame) -> DataFrame:
    """Adds severity to summary(): error, warning (incomplete rows) or success."""
    return counts.withColumn("severity", F.when(F.col("errors") > 0, "error").when(F.col("incomplete") > 0, "warning").otherwise("success"))


def from_success(rows: DataFrame) -> DataFrame:
    """Result rows of documents that were read (path, the fields, confidence, engine_used)."""
    return _row(rows, F.col("confidence"), F.col("engine_used"), None)


def from_error(rows: DataFrame) -> DataFrame:
    """Result rows of documents that failed (path, message): no fields, confidence 0, engine "ocr"."""
    none = rows.select("path", "message", *[F.lit(None).cast("string").alias(f) for f in lx.FIELDS])
    return _row(none, F.lit(0.0), F.lit("ocr"), F.col("message"))


def _row(rows: DataFrame, confidence: Column, engine: Column, message: Column | None) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    failed = F.lit(message is not None)
    x = rows.select(
        "path", name.alias("file_name"), *lx.FIELDS, confidence.alias("confidence"), engine.alias("engine_used"), failed.alias("has_error"),
        (F.lit(None).cast("string") if message is None else message).alias("error_message"),
    )
    return x.withColumn("is_incomplete", is_incomplete(F.col("has_error")))


def edited(rows: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Rows with edits (key, field, value) in place of what was found, the last one given (seq) counting; the
    placeholder stands for null, and what follows from the fields is worked out again."""
    last = edits.groupBy(key, "field").agg(F.max_by(F.nullif(F.trim("value"), F.lit(PLACEHOLDER)), "seq").alias("v"))
    told = last.groupBy(F.col(key).alias("_key")).agg(F.map_from_entries(F.collect_list(F.struct("field", F.coalesce("v", F.lit("")).alias("v")))).alias("_edits"))
    j = rows.join(told, F.col(key) == F.col("_key"), "left")
    new = lambda f: F.when(F.map_contains_key("_edits", F.lit(f)), F.nullif(F.try_element_at("_edits", F.lit(f)), F.lit(""))).otherwise(F.col(f))
    j = j.withColumns({f: new(f) for f in lx.FIELDS}).drop("_key", "_edits")
    return j.withColumn("is_incomplete", is_incomplete(F.col("has_error")))


def membership(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """What a rerun does to the list of incomplete rows: key and change: added, removed, updated or none."""
    a = after.select(F.col(key).alias("_key"), F.col("is_incomplete").alias("_now"))
    j = before.join(a, F.col(key) == F.col("_key"))
    was, now = F.col("is_incomplete"), F.col("_now")
    return j.select(key, F.when(was & now, "updated").when(was, "removed").when(now, "added").otherwise("none").alias("change"))


def placeholder(value: Column) -> Column:
    return F.when(is_blank(value), F.lit(PLACEHOLDER)).otherwise(value)


def size_text(n_bytes: Column) -> Column:
    """Bytes as people read them: B, or KB and MB to one decimal, halves up."""
    tenths = lambda unit: F.floor((n_bytes * 10 + unit / 2) / unit).cast("long")
    told = lambda t, name: F.concat((F.floor(t / 10)).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit(f" {name}"))
    return F.when(n_bytes < 1 << 10, F.concat(n_bytes.cast("string"), F.lit(" B"))).when(n_bytes < 1 << 20, told(tenths(float(1 << 10)), "KB")).otherwise(told(tenths(float(1 << 20)), "MB"))


#: Signs of a file's kind.
SIGNS = {"pdf": "📋", "jpg": "🖼", "jpeg": "🖼", "png": "🖼", "bmp": "🖼", "tif": "🖼", "tiff": "🖼"}
OTHER_SIGN = "📄"


def file_item(path: Column, n_bytes: Column) -> Column:
    """A file as a list of files shows it: name (what follows the last slash or backslash), size_text ("?" where the size isn't known)
    and sign, by the ending in any letter case."""
    name = F.regexp_extract(path, r"([^/\\\\]*)$", 1)
    ending = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    table = F.create_map(*[F.lit(x) for pair in SIGNS.items() for x in pair])
    return F.struct(name.alias("name"), F.coalesce(size_text(n_bytes), F.lit("?")).alias("size_text"), F.coalesce(F.try_element_at(table, ending), F.lit(OTHER_SIGN)).alias("sign"))


def progress(done: Column, total: Column) -> Column:
    """Percent done; 0 of nothing."""
    return F.coalesce(F.try_divide(done * 100.0, total), F.lit(0.0))


def message(templates: dict[str, str], key: Column, *values: Column) -> Column:
    """The template of a key with {0}, {1}, ... filled in; {_key_} where there is none."""
    table = F.create_map(*[F.lit(x) for pair in templates.items() for x in pair])
    out = F.coalesce(F.try_element_at(table, key), F.concat(F.lit("{_"), key, F.lit("_}")))
    for i, v in enumerate(values):
        out = F.replace(out, F.lit(f"{{{i}}}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def compare_versions(a: Column, b: Column) -> Column:
    """1, 0 or -1 by the numbers between points; missing ones and words count as 0, a leading v not at all."""
    parts = lambda v: F.transform(F.split(F.regexp_replace(v, "^v+", ""), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
    pairs = F.zip_with(parts(a), parts(b), lambda x, y: F.signum(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))).cast("int"))
    return F.coalesce(F.get(F.filter(pairs, lambda s: s != 0), F.lit(0)), F.lit(0))


def error_message(code: Column, body: Column) -> Column:
    """What a failed call means."""
    low = F.lower(body)
    return (
        F.when(code == 422, "format")
        .when((code == 500) & low.rlike("poppler|pdfinfo|pdftoppm"), "poppler")
        .when((code == 500) & low.rlike("ocrengineerror|paddleocr"), "engine")
        .when(code == 500, "internal")
        .otherwise(F.concat(F.lit("HTTP "), code.cast("string")))
    )
