"""Sorted output: files that follow one another in order, with their bounds, read back in order without another sort.

Rows are dealt to ranges of the sort key and sorted within each, one file (or several) a range; Spark names files by
range, so their names are in order too. Beside the files lies a small table of them: rows, where a file begins in the whole,
and its first and last key. A row's place then is its file's beginning and its own number within the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILES = "_files"


def write_ordered(rows: DataFrame, path: str, keys: list[str], descending: tuple[str, ...] = (), file_rows: int = 5_000_000) -> None:
    """Writes rows sorted by keys (nulls last), those in `descending` from large to small. Rows that agree in all keys may fall into
    several ranges if their other columns differ; repeated rows stay together, in any order."""
    way = lambda c: F.col(c).desc_nulls_last() if c in descending else F.col(c).asc_nulls_last()
    others = [c for c in rows.columns if c not in keys]
    order = [*map(way, keys), *([F.xxhash64(*others).asc()] if others else [])]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", file_rows).parquet(path)
    spark = rows.sparkSession
    told = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"), F.struct(*keys).alias("key"))
    files = told.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min_by("key", "at").alias("first_key"), F.max_by("key", "at").alias("last_key"))
    start = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a file
    files.withColumn("start", start).write.parquet(f"{path}/{FILES}")


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """The files of an ordered table: file, n, start (rows before it), first_key, last_key."""
    return spark.read.parquet(f"{path}/{FILES}")


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """The rows with `position`, their place from 0 on: no exchange but of the table of files, and no sort."""
    rows = spark.read.parquet(path)
    placed = rows.withColumn("_file", F.col("_metadata.file_name")).withColumn("_at", F.col("_metadata.row_index"))
    start = files_of(spark, path).select(F.col("file").alias("_file"), "start")
    return placed.join(start, "_file").select(*rows.columns, (F.col("start") + F.col("_at")).alias("position"))


def page(spark: SparkSession, path: str, first: int, n: int) -> DataFrame:
    """The n rows from place `first` on, with position: only the files that hold some of them are read."""
    held = files_of(spark, path).where((F.col("start") < first + n) & (F.col("start") + F.col("n") > first)).select("file", "start").collect()
    rows = spark.read.parquet(*[f"{path}/{r.file}" for r in held]) if held else spark.read.parquet(path).limit(0)
    starts = F.create_map(*[F.lit(x) for r in held for x in (r.file, r.start)]) if held else F.create_map().cast("map<string,bigint>")
    placed = rows.withColumn("position", starts[F.col("_metadata.file_name")] + F.col("_metadata.row_index"))
    return placed.where(F.col("position").between(first, first + n - 1))


def between(spark: SparkSession, path: str, key: str, low: Column, high: Column) -> DataFrame:
    """Rows whose first sort key lies from low to high: only files whose bounds allow it are read. For keys sorted upwards."""
    files = files_of(spark, path)
    near = files.where((files[f"first_key.{key}"] <= high) & ((files[f"last_key.{key}"] >= low) | files[f"last_key.{key}"].isNull()))
    names = [f"{path}/{r.file}" for r in near.select("file").collect()]
    rows = spark.read.parquet(*names) if names else spark.read.parquet(path).limit(0)
    return rows.where(F.col(key).between(low, high))
