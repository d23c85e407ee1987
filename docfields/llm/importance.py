"""Quality classifier by importance resampling.

Two generative models of hashed n-grams (words and word pairs, in a fixed number of
buckets): one of the target, labelled documents of quality that are not toxic, and one of
all raw documents. A document's weight is the ratio of its probabilities under both;
log weight plus Gumbel noise, seeded by doc_id, ranks the documents, and the top k are a
sample without replacement in proportion to the weights. k is the target's share among
the labelled documents times the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docfields.llm import kernel
from docfields.llm.common import materialize

BUCKETS = 1 << 16
TARGET_ROWS = 20_000


def features(texts: Sequence[bytes], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text number) of every word and every pair of words of a text, slice by slice."""
    for a, b in kernel.slices(texts):
        hashes, offsets = kernel.words(texts[a:b])
        owner = np.repeat(np.arange(a, b), np.diff(offsets))
        pairs = kernel.windows(hashes, 2)
        inside = owner[1:] == owner[:-1]
        bins = np.concatenate([hashes, pairs[inside]]) % np.uint64(buckets)
        yield bins.astype(np.int64), np.concatenate([owner, owner[1:][inside]])


def _counter(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, buckets), np.int64)
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(0).to_pylist()]
            target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for bins, owner in features(texts, buckets):
                held[0] += np.bincount(bins, minlength=buckets)
                held[1] += np.bincount(bins[target[owner]], minlength=buckets)
        at = np.flatnonzero(held[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[0][at]), pa.array(held[1][at])], names=["bin", "raw", "target"])

    return count


def log_ratios(docs: DataFrame, labels: DataFrame, *, buckets: int, target_rows: int, seed: int) -> np.ndarray:
    """log10(target / raw) of every bucket, add-one smoothed.

    The raw model counts all rows. The target model counts the documents of at most
    target_rows labelled rows (the first by a hash of doc_id): that bound, a parameter, is
    what makes the broadcast of their ids safe. The driver gets `buckets` rows at most."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    good = good.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(target_rows).withColumn("target", F.lit(True))
    rows = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counts = rows.mapInArrow(_counter(buckets), "bin int, raw long, target long").groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    table = counts.toArrow()
    raw, target = np.ones(buckets), np.ones(buckets)
    raw[table["bin"].to_numpy()] += table["raw"].to_numpy()
    target[table["bin"].to_numpy()] += table["target"].to_numpy()
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def log_weight(spark: SparkSession, ratios: np.ndarray, text: Column) -> Column:
    """Natural log of the ratio of a text's probabilities; 0 for a text without words."""
    sent, buckets = spark.sparkContext.broadcast(ratios), len(ratios)

    @F.arrow_udf(T.DoubleType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.to_pylist()]
            out = np.zeros(len(texts))
            for bins, owner in features(texts, buckets):
                out += np.bincount(owner, sent.value[bins], minlength=len(texts))
            yield pa.array(out)

    return run(text)


def kth_largest(rows: DataFrame, key: str, k: int) -> float | None:
    """The k-th largest value of a double column, exactly: rounds of counting in 4,096 equal
    bins between the lowest and highest value left, until the bin of the k-th holds one value."""
    if k <= 0:
        return None
    low, high = rows.agg(F.min(key), F.max(key)).first()
    while low is not None and low < high:
        step = (high - low) / 4096
        spot = F.least(F.lit(4095), F.floor((F.col(key) - F.lit(low)) / F.lit(step))).cast("int") if step > 0 else (F.col(key) > low).cast("int")
        within = rows.where((F.col(key) >= low) & (F.col(key) <= high)).groupBy(spot.alias("spot"))
        for r in sorted(within.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("a"), F.max(key).alias("b")).collect(), reverse=True):
            if k <= r["n"]:
                low, high = r["a"], r["b"]
                break
            k -= r["n"]
    return low


def importance_sample(
    docs: DataFrame, labels: DataFrame, *, share: float | None = None, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS, seed: int = 11
) -> DataFrame:
    """The sample: doc_id, log_weight and key of the rows of docs with the k largest keys.

    k = share x rows, where share is by default the target's share of the labelled rows (all
    rows if there are no labels). Each row counts by itself; rows that share a doc_id share
    their noise, rows with a null doc_id are ranked by weight and the noise of a null. A null
    or empty text has weight 1; ties of the last key are all taken; an empty table gives an
    empty sample; other columns don't matter.
    """
    if share is None:
        good = F.coalesce((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), F.lit(False))
        share = labels.agg(F.avg(good.cast("double"))).first()[0]
        share = 1.0 if share is None else share
    ratios = log_ratios(docs, labels, buckets=buckets, target_rows=target_rows, seed=seed)
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = docs.select("doc_id", log_weight(docs.sparkSession, ratios, F.col("text")).alias("log_weight"))
    keyed = materialize(keyed.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))), "importance")
    last = kth_largest(keyed, "key", round(share * keyed.count()))
    return keyed.where(F.lit(False) if last is None else F.col("key") >= last)
