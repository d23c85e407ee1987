"""How batches stand while files arrive: counts and severity as a streaming aggregate, kept in a table.

The aggregate's state is one row a batch; tasks add up before they shuffle, so a batch with very many files sends
few rows. Each trigger upserts the batches that changed, by their key, so a trigger that runs again replaces what it
wrote, and a query that is stopped and started on its checkpoint counts every file once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.operators import results
from docfields.sinks.kept import KeptTable

#: What a row of a stream tells of a file: that it was queued, or that it is done.
QUEUED, DONE = "queued", "done"


def standing(rows: DataFrame, key: str = "batch") -> DataFrame:
    """Per batch, of rows (key, stage, is_selected, has_error, is_incomplete): files and files_selected of those queued; total,
    errors, incomplete and success of those done; severity. A null flag counts as false, another stage as neither."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    queued, done = F.col("stage") == QUEUED, F.col("stage") == DONE
    some: dict[str, Column] = {
        "files": queued, "files_selected": queued & flag("is_selected"), "total": done, "errors": done & flag("has_error"),
        "incomplete": done & flag("is_incomplete") & ~flag("has_error"), "success": done & ~flag("has_error"),
    }
    return results.banner(rows.groupBy(key).agg(*[F.count_if(c).alias(n) for n, c in some.items()]))


def keep_standing(rows: DataFrame, table: KeptTable, checkpoint: str, key: str = "batch") -> None:
    """Reads what a streaming DataFrame has that wasn't read on this checkpoint, and upserts the standing of each batch that changed;
    returns when all is read. Run it again for what arrives later."""

    def put(some: DataFrame, number: int) -> None:
        table.upsert(some)

    stream = standing(rows, key).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()
