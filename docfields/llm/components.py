"""Connected components of a graph given by edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import materialize

#: A node is a hub if it has more than this share of all rows; so there are at most 1 / HUB_SHARE hubs.
HUB_SHARE = 1 / 200


def with_least(rows: DataFrame) -> DataFrame:
    """rows (a, b) with m, the smallest of a and all its b.

    Nodes with over HUB_SHARE of all rows, of which there can't be more than 1 / HUB_SHARE, come to
    the driver with their m and are broadcast; only the others are shuffled to be joined."""
    n_rows = rows.count()
    least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"), "n")
    hubs = [(r["u"], r["m"]) for r in least.where(F.col("n") > n_rows * HUB_SHARE).collect()]
    plain = lambda some: some.join(least.select("u", "m"), F.col("a") == F.col("u")).select("a", "b", "m")
    if not hubs:
        return plain(rows)
    told = rows.join(F.broadcast(rows.sparkSession.createDataFrame(hubs, "h long, low long")), F.col("a") == F.col("h"), "left")
    return told.where("h IS NOT NULL").select("a", "b", F.col("low").alias("m")).union(plain(told.where("h IS NULL").select("a", "b")))


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (a, root): the smallest node that each other node reaches.

    Nodes that are the smallest of their component, or that have no edge but to themselves,
    have no row. Large-star and small-star rounds alternate until nothing changes, a few
    rounds even for long chains; what each star makes is a written table, so that plans and
    lineage stay short. Nodes with very many edges don't land in one task (see with_least).
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    state = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = materialize(with_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "edges")
        # here m is smaller than a, as every b is
        small = with_least(large).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = materialize(small.distinct(), "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.count_distinct("a")).first())
        if now == state:
            return e.select("a", F.col("b").alias("root"))
        state = now
