"""Results kept up to date: a Parquet table in hash buckets of its key, of which a rerun rewrites only those it touches.

A bucket is a partition folder, so reading what a rerun touches is partition pruning, and writing it
back is a dynamic partition overwrite; files of other buckets stay as they are. Putting the same rows in again
changes nothing, so a rerun that failed midway is simply run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class KeptTable:
    """A table at `path` with one row a key. The folders' name holds the number of buckets, so that a table can't be
    opened with another one. A null key is a key; rows without one lie in a bucket like any other."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.buckets, self.folder = spark, path.rstrip("/"), key, buckets, f"bucket_of_{buckets}"

    def _exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int").alias(self.folder)

    def _write(self, rows: DataFrame) -> None:
        # one task a bucket, as a bucket is a file of its own; keys are unique, so buckets are even
        dealt = rows.repartition(self.buckets, self.folder)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.folder).parquet(self.path)

    def _stored(self) -> DataFrame:
        found = self.spark.read.option("basePath", self.path).parquet(self.path)
        if self.folder not in found.columns:
            raise ValueError(f"{self.path} has another number of buckets than {self.buckets}")
        return found

    def rows(self) -> DataFrame:
        """The table as it is now; read before the next upsert begins, as that replaces files."""
        return self._stored().drop(self.folder)

    def _last(self, rows: DataFrame, order: Sequence[str]) -> DataFrame:
        whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
        latest = F.max_by(whole, F.struct(*[F.col(c) for c in order], F.to_json(whole)))
        return rows.groupBy(F.col(self.key).alias("_key")).agg(latest.alias("_row")).select("_row.*").withColumn(self.folder, self._bucket())

    def upsert(self, rows: DataFrame, order: Sequence[str] = ()) -> list[int]:
        """Puts rows in, in place of those with the same key; of rows that share one the last by `order` counts (of those that
        tie, the last as JSON). Makes the table if there is none. The buckets written, of which nothing else comes to the driver."""
        last = self._last(rows, order)
        if not self._exists():
            self._write(last)
            return list(range(self.buckets))
        touched = sorted(r[0] for r in last.select(self.folder).distinct().collect())
        if touched:
            kept = self._stored().where(F.col(self.folder).isin(touched))
            again = last.select(F.col(self.key).alias("_key"))
            stay = kept.join(again, kept[self.key].eqNullSafe(again["_key"]), "left_anti")
            self._write(stay.unionByName(last, allowMissingColumns=True).select(*kept.columns))
        return touched
