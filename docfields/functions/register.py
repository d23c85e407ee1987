"""The library's expressions under names in SQL: scalar functions and a table function, as SQL functions of the session.

A function's body is the SQL of the same column expression that plans built in Python use, so it is inlined where it
is called, stays in the JVM and is optimised with the query around it. The expression's SQL is had from a session in the
driver's own JVM, not over Spark Connect.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from docfields.functions import parse, text

#: name: (type of the argument, type of the result, expression)
SCALARS: dict[str, tuple[str, str, Callable[[Column], Column]]] = {
    "collapse_text": ("STRING", "STRING", text.collapse_text),
    "normalize_text": ("STRING", "STRING", text.normalize_text),
    "strip_noise": ("STRING", "STRING", text.strip_noise),
    "label_fields": ("STRING", "ARRAY<STRING>", lambda t: parse.let(text.normalize_text(t), text.label_fields)),
    "looks_like_label": ("STRING", "BOOLEAN", lambda t: text.looks_like_label(text.normalize_text(t))),
    "extract_amount": ("STRING", "STRING", parse.extract_amount),
    "extract_date": ("STRING", "STRING", lambda t: parse.extract_date(t, text.normalize_text(t))),
}
#: The columns of a document's lines.
TABLE = "pos INT, text STRING, confidence DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
#: A string literal, or an operator written like a function, which SQL wants between backquotes.
_CALL = re.compile(r"('(?:[^'\\]|\\.|'')*')|(?<![\w`])(and|or|not|<=>|[<>!=]=?|[-+*/%])\(")


def sql_of(column: Column) -> str:
    """The SQL of a column expression."""
    return _CALL.sub(lambda m: m[1] or f"`{m[2]}`(", column._jc.node().sql())


def register(spark: SparkSession) -> list[str]:
    """Makes the SCALARS and the table function document_lines (of a recogniser's reply, JSON, to be used with LATERAL) functions of
    the session, in place of those of the same name; their names. A null argument gives null, or no lines."""
    from docfields.sources.ocr_json import payload_lines

    for name, (given, returns, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(value {given}) RETURNS {returns} RETURN {sql_of(body(F.col('value')))}")
    box = ", ".join(f"CAST(l.box.{c} AS DOUBLE)" for c in ("x1", "y1", "x2", "y2"))
    lines = sql_of(payload_lines(F.col("payload")))
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION document_lines(payload STRING) RETURNS TABLE({TABLE}) RETURN "
        f"SELECT pos, l.text, l.confidence, {box} FROM posexplode({lines}) AS own(pos, l)"
    )
    return [*SCALARS, "document_lines"]
