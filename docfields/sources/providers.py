"""Cloud providers: replies to fields, which engine answers for a file, and when a provider is given up.

Providers themselves are functions over batches of files (see called); nothing here calls a
network. Routing is a rule over columns. A provider that fails for good is left out
for all later files of its batch: as the files have an order, that is a comparison with
the first such failure, one aggregate a batch, and no state that tasks would share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions import lexicon as lx
from docfields.functions.parse import let
from docfields.sources.replies import client_fields, server_fields

#: Replies that mean that a provider won't answer later either; confidence of a cloud row.
PERMANENT = (401, 403, 404, 410, 429, 503)
CLOUD_CONFIDENCE = 0.95
OK = 200
REPLIES = "path string, code int, reply string"
Provider = Callable[[str, bytes], tuple[int, str]]


def called(files: DataFrame, provider: Provider) -> DataFrame:
    """path, code, reply of a provider for files (path, content): a function of path and content that
    gives a status and a text. What it raises is status 0 with the problem's name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    out.append((path, *provider(path, bytes(content))))
                except Exception as problem:  # one file's failure is its row's
                    out.append((path, 0, type(problem).__name__))
            yield pd.DataFrame(out, columns=["path", "code", "reply"])

    return files.select("path", "content").mapInPandas(run, REPLIES)


def reply_fields(reply: Column, *, strict: bool) -> Column:
    """The eight fields of a reply as a struct, null where the reply is an error: as a server takes it (strict: all eight
    must be there, values as text) or as a client does (fields that aren't there are null, values that aren't text an error)."""
    told = server_fields(reply) if strict else client_fields(reply)
    return let(told, lambda t: F.when(t["problem"].isNull(), F.struct(*[t[f].alias(f) for f in lx.FIELDS])))


def body_summary(body: Column) -> Column:
    """What a failed call's reply says: "status: message" of its error, else its first 200 characters."""
    message, status = F.get_json_object(body, "$.error.message"), F.coalesce(F.get_json_object(body, "$.error.status"), F.lit(""))
    cut = F.when(F.length(body) > 200, F.concat(F.substring(body, 1, 200), F.lit("…"))).otherwise(body)
    return F.when(F.length(message) > 0, F.concat(status, F.lit(": "), message)).otherwise(cut)


def closings(files: DataFrame) -> DataFrame:
    """Per batch: the place of the file after which each provider is closed, as it failed for good when it was called: the first
    where it is asked for by name or, the first by auto, comes first; and the second where it is called in place of the first just
    then. files: as for routed."""
    gone = lambda c: F.col(c).isin(*PERMANENT)
    tried = F.col("has_primary") & F.col("engine").isin("auto", "primary") & gone("primary_code")
    named = (F.col("engine") == "secondary") & F.col("has_secondary") & gone("secondary_code")
    instead = (F.col("engine") == "auto") & F.col("has_secondary") & gone("secondary_code")
    ends = files.groupBy("batch").agg(
        F.min(F.when(tried, F.col("place"))).alias("primary_end"),
        F.min(F.when(named, F.col("place"))).alias("_named"),
        F.min_by(instead, F.when(tried, F.col("place"))).alias("_instead"),
    )
    return ends.select("batch", "primary_end", F.least("_named", F.when(F.col("_instead"), F.col("primary_end"))).alias("secondary_end"))


def routed(files: DataFrame) -> DataFrame:
    """files (batch, place, engine, has_primary, has_secondary, primary_code, secondary_code: what each would
    reply) with answered_by ("primary", "secondary", "ocr") and has_error. For replies that are all known; where a provider is
    to be called only while it is open, see breaker.route_in_order, which gives the same.

    The engine asked for is auto, primary, secondary or ocr. A provider asked for by name never falls back
    to another while it can be asked; auto goes from the first to the second to the recogniser
    where a provider fails for good, but a passing failure of the first is an error row even then. A second provider that fails in
    first place, as the first is closed or absent, stays open."""
    b = closings(files).withColumnRenamed("batch", "_batch")
    x = files.join(b, F.col("batch").eqNullSafe(F.col("_batch"))).drop("_batch")
    place, engine = F.col("place"), F.col("engine")
    primary_open = F.col("primary_end").isNull() | (place <= F.col("primary_end"))
    secondary_open = F.col("secondary_end").isNull() | (place <= F.col("secondary_end"))
    ok = lambda c: F.col(c) == OK
    row = lambda by, wrong: F.struct(F.lit(by).alias("answered_by"), wrong.alias("has_error"))
    no, yes = F.lit(False), F.lit(True)
    second_or_ocr = F.when(F.col("has_secondary") & secondary_open & ok("secondary_code"), row("secondary", no)).otherwise(row("ocr", no))
    by_name = row("secondary", ~(secondary_open & ok("secondary_code")))
    failed = F.when(F.col("primary_code").isin(*PERMANENT) & (engine == "auto"), second_or_ocr).otherwise(row("primary", yes))
    first = F.when(ok("primary_code"), row("primary", no)).otherwise(failed)
    route = (
        F.when((engine == "secondary") & F.col("has_secondary"), by_name)
        .when(F.col("has_primary") & engine.isin("auto", "primary") & primary_open, first)
        .when(engine == "auto", second_or_ocr)
        .otherwise(row("ocr", no))
    )
    return x.withColumn("_r", route).select(*files.columns, "_r.answered_by", "_r.has_error")
