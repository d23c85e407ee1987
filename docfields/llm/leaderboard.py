"""A change feed of leaderboards: the items of highest revenue of each nation, day of arrival by day of arrival.

Lines are priced, dated and cut into batches by joins and expressions, written once, and fed batch by batch to a
streaming query with state, which is started anew for each on one checkpoint. Within the query every task first adds
up its lines by nation, day and item, so a nation with very many lines sends few rows. A nation's state
is its revenue by item, as packed arrays, and its last board; a call reads it into a dictionary and a max-heap with
lazy deletion: an entry is stale once its item's revenue has changed, and is skipped when it comes to the top.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docfields.llm.common import materialize, setting, shared_path

CHANGES = "nation_id int, arrival_day long, item_id long, batch int, change string, old_rank int, new_rank int, revenue long"
STATE = "items binary, revenues binary, board binary"
SUMS = "nation_id int, arrival_day long, item_id long, batch int, cents long"
#: Rows of partial sums that a task holds before it adds them up.
HELD_ROWS = 500_000

#: The day (since 1970) and number of days that the batches divide, and the days that a line may be late.
FIRST_DAY, DAYS, LATE_DAYS = 19723, 180, 3


def cents(amount: Column) -> Column:
    return F.floor(F.lit(100.0) * amount.cast("double") + 0.5).cast("long")


def arrivals(lines: DataFrame, vendors: DataFrame, items: DataFrame, batches: int = 10) -> DataFrame:
    """One thin row a line: nation_id and known (whether its item has a row), item_id, shipped_day, arrival_day, batch, cents.

    The joins' small sides are written tables, so Spark sees their size: it broadcasts one below its limit and
    else sorts and merges, splitting a hot vendor or item at run time."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    h = F.crc32(F.concat_ws(",", one("sale_id"), one("item_id"), one("vendor_id"), one("line_no")).cast("binary"))
    told = lines.select(
        "item_id", "vendor_id", "quantity", "flag", cents(F.col("amount")).alias("own"), h.alias("h"),
        F.coalesce(F.datediff(F.to_date("shipped_at"), F.lit("1970-01-01").cast("date")).cast("long"), F.lit(FIRST_DAY) + F.col("h") % 150).alias("shipped_day"),
    )
    told = told.withColumn("arrival_day", F.col("shipped_day") + F.col("h") % 7 + F.when(F.col("h") % 5 == 0, 20).otherwise(0))
    told = told.withColumn("batch", F.least(F.lit(batches), 1 + F.floor((F.col("arrival_day") - FIRST_DAY) * batches / DAYS)).cast("int"))
    of_vendor = materialize(vendors.where("vendor_id IS NOT NULL").groupBy(F.col("vendor_id").alias("v")).agg(F.min("nation_id").cast("int").alias("nation_id")), "board-vendors")
    of_item = materialize(items.where("item_id IS NOT NULL").groupBy(F.col("item_id").alias("i")).agg(cents(F.min("price")).alias("price")), "board-items")
    told = told.join(of_vendor, F.col("vendor_id") == F.col("v"), "left").join(of_item, F.col("item_id") == F.col("i"), "left")
    value = F.coalesce("own", F.col("quantity").cast("long") * F.col("price"), F.lit(0))
    return told.select(
        "nation_id", F.col("i").isNotNull().alias("known"), F.col("item_id").cast("long").alias("item_id"), "shipped_day", "arrival_day", "batch",
        F.when(F.col("flag") == "swapped", -value).otherwise(value).alias("cents"),
    )


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task's lines by nation, day and item."""
    keys = ["nation_id", "arrival_day", "item_id", "batch"]
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        out = pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([("cents", "sum")])
        return out.rename_columns([c.removesuffix("_sum") for c in out.column_names]).select([*keys, "cents"])

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) > HELD_ROWS:
            held = [summed()]
            if held[0].num_rows > HELD_ROWS // 2:  # hardly any line shares its sums with another here
                yield from held.pop().to_batches()
    if held:
        yield from summed().to_batches()


class Board:
    """Revenues of a nation's items and the heap of those above zero."""

    def __init__(self, revenues: dict[int, int], top: int) -> None:
        self.revenues, self.top = revenues, top
        self.heap = [(-r, i) for i, r in revenues.items() if r > 0]
        heapq.heapify(self.heap)

    def add(self, item: int, amount: int) -> None:
        now = self.revenues[item] = self.revenues.get(item, 0) + amount
        if amount and now > 0:
            heapq.heappush(self.heap, (-now, item))

    def best(self) -> list[int]:
        """Items by revenue, ties to the smaller item. Stale and double entries on the way are gone for good, valid ones go back."""
        found: dict[int, tuple[int, int]] = {}
        while self.heap and len(found) < self.top:
            entry = heapq.heappop(self.heap)
            if entry[1] not in found and self.revenues[entry[1]] == -entry[0]:
                found[entry[1]] = entry
        for entry in found.values():
            heapq.heappush(self.heap, entry)
        return list(found)


def _feeder(top: int):
    longs = lambda data: np.frombuffer(data, "<i8")

    def feed(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [f[["arrival_day", "item_id", "batch", "cents"]].to_numpy(np.int64) for f in frames]
        rows = np.concatenate(parts) if parts else np.zeros((0, 4), np.int64)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        first = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])) if len(rows) else np.zeros(0, np.int64)
        sums = np.add.reduceat(rows[:, 3], first) if len(rows) else rows[:, 3]
        rows = rows[first]
        held, revenues, last = (longs(x) for x in state.get) if state.exists else (longs(b""),) * 3
        board, shown, out = Board(dict(zip(held.tolist(), revenues.tolist(), strict=True)), top), last.tolist(), []
        days = np.flatnonzero(np.diff(rows[:, 0], prepend=rows[0, 0] - 1)) if len(rows) else []
        for a, b in zip(days, [*days[1:], len(rows)], strict=True):
            for item, amount in zip(rows[a:b, 1].tolist(), sums[a:b].tolist(), strict=True):
                board.add(item, amount)
            old, shown = {i: r for r, i in enumerate(shown, 1)}, board.best()
            new = {i: r for r, i in enumerate(shown, 1)}
            for item in sorted(old.keys() | new.keys()):
                was, now = old.get(item), new.get(item)
                if was != now:
                    change = "enter" if was is None else "exit" if now is None else "move"
                    out.append((key[0], int(rows[a, 0]), item, int(rows[a, 2]), change, was, now, board.revenues[item]))
        ids = np.fromiter(board.revenues.keys(), "<i8", len(board.revenues))
        state.update((ids.tobytes(), np.fromiter(board.revenues.values(), "<i8", len(ids)).tobytes(), np.array(shown, "<i8").tobytes()))
        if out:
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])
            yield frame.astype({"nation_id": "int32", "batch": "int32", "old_rank": "Int32", "new_rank": "Int32"})

    return feed


def changes(lines: DataFrame, vendors: DataFrame, items: DataFrame, *, top: int = 10, batches: int = 10, late_days: int = LATE_DAYS) -> DataFrame:
    """What changes on each nation's board of its `top` highest positive revenues after each day of arrival; see CHANGES.

    Every line counts, repeated ones too, except those whose vendor has no nation or whose item has no row, and
    those shipped over late_days days before the latest line of all earlier batches. Null keys and item ids
    fit no row, a null shipped_at is dealt out by the line's hash, null amounts are priced by the item's row, else 0; ids that
    vendors or items repeat count once, with their smallest nation or price. Empty lines, or none that counts, give an
    empty result; other columns don't matter. What comes to the driver is one row a batch.

    Source, checkpoint and results lie in a new folder of the shared folder. A nation's state and one batch's sums
    by day and item are held by one task; they grow with the items that the nation sells, not with the lines.
    """
    spark = lines.sparkSession
    folder = shared_path(spark, "leaderboard")
    told = arrivals(lines, vendors, items, batches)
    # rebalanced, so that a batch is a few files of a good size and not one for each task
    told.hint("rebalance", "batch").write.partitionBy("batch").parquet(f"{folder}/cut")
    cut = spark.read.schema(told.schema).parquet(f"{folder}/cut")
    latest = sorted(tuple(r) for r in cut.groupBy("batch").agg(F.max("shipped_day")).collect())
    store = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    path = lambda *names: spark._jvm.org.apache.hadoop.fs.Path("/".join([folder, *names]))
    store.mkdirs(path("source"))
    seen = None
    for batch, day in latest:
        store.rename(path("cut", f"batch={batch}"), path("source", f"batch={batch}"))
        rows = spark.readStream.schema(told.schema).parquet(f"{folder}/source").where("known AND nation_id IS NOT NULL")
        if seen is not None:
            rows = rows.where(F.col("shipped_day") + late_days >= seen)
        sums = rows.select("nation_id", "arrival_day", "item_id", "batch", "cents").mapInArrow(_add_up, SUMS)
        fed = sums.groupBy("nation_id").applyInPandasWithState(_feeder(top), CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)
        stream = fed.writeStream.format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        # the checkpoint lives as long as this call, in a folder whose file system checks its files: checksum files of Spark's own, one
        # more for each partition of the state and batch, took as long as committing it
        with setting(spark, "spark.sql.streaming.checkpoint.fileChecksum.enabled", "false"):
            stream.start().awaitTermination()
        seen = day if seen is None else max(seen, day)
    if not latest:
        return spark.createDataFrame([], CHANGES)
    return spark.read.schema(CHANGES).parquet(f"{folder}/changes")
