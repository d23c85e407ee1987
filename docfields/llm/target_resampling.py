"""Importance resampling towards the distribution of target texts, by an integer dictionary of words.

Features are all runs of one to three consecutive words. Within a run of texts (some MB), every
distinct word gets an integer id, a feature is the tuple of its words' ids, and each distinct tuple's
bytes are hashed once: the checksum of a tuple continues that of the tuple without its last word.
Counts (or gains) per distinct tuple are then joined back to the places where it stands. What leaves a
task is one count per bucket; the gains of all buckets (a fixed number, so a fixed size) go back to the
tasks, and a global order of thin rows, dealt by ranges, gives the ranks of those drawn.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docfields.llm.common import materialize

BUCKETS = 10_000
ORDERS = 3
LEAST_WORDS = 20
SLICE = 2 << 20

#: Words are made of digits, letters a-z (A-Z lower-cased) and all bytes from 0x80 on.
FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def blocks(texts: Sequence[str | None], orders: int, size: int) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """Runs of texts as (row, old, words), about size bytes of them at a time. A longer text is cut between words;
    its next part begins with the last words of the one before (old of them), as features reach back to these."""
    out, held = [], 0
    for row, text in enumerate(texts):
        flat, at, tail = (text or "").encode().translate(FOLD), 0, []
        while at < len(flat):
            stop = flat.find(b" ", at + size) if len(flat) - at > size else -1
            stop = len(flat) if stop < 0 else stop
            own = tail + flat[at:stop].split()
            out.append((row, len(tail), own))
            held, at, tail = held + stop - at, stop, own[-(orders - 1) :] if orders > 1 else []
            if held >= size:
                yield out
                out, held = [], 0
    if out:
        yield out


def tuples(block: list[tuple[int, int, list[bytes]]], orders: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each number of words: (row of each feature, number of its distinct tuple, checksum of each distinct tuple)."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    sizes = [len(words) for _, _, words in block]
    ids = np.fromiter((number[w] for _, _, words in block for w in words), np.int64, sum(sizes))
    if not len(ids):
        return
    part = np.repeat(np.arange(len(block)), sizes)
    row = np.repeat(np.array([r for r, _, _ in block], np.int64), sizes)
    first = np.cumsum(sizes) - sizes
    new = np.arange(len(ids)) - first[part] >= np.array([old for _, old, _ in block])[part]  # not words of the part before
    words = list(number)
    spaced = [b" " + w for w in words]
    place, checksum = ids, np.fromiter(map(zlib.crc32, words), np.int64, len(words))  # place: of each feature by its last word, -1 where there is none
    yield row[new], place[new], checksum
    for n in range(2, orders + 1):
        whole = np.flatnonzero((place[: len(ids) - 1] >= 0) & (part[1:] == part[:-1])) + 1
        code, distinct = pd.factorize(place[whole - 1] * len(words) + ids[whole])
        before, last = np.divmod(distinct, len(words))
        checksum = np.fromiter(map(zlib.crc32, map(spaced.__getitem__, last.tolist()), checksum[before].tolist()), np.int64, len(distinct))
        place = np.full(len(ids), -1, np.int64)
        place[whole] = code
        mine = new & (place >= 0)
        yield row[mine], place[mine], checksum


def _counter(buckets: int, orders: int, size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0).to_pylist(), orders, size):
                for _, place, checksum in tuples(block, orders):
                    # sums of whole numbers far below 2 ** 53, so exact in doubles
                    held += np.bincount(checksum % buckets, np.bincount(place, minlength=len(checksum)), buckets).astype(np.int64)
        at = np.flatnonzero(held)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], names=["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, *, buckets: int = BUCKETS, orders: int = ORDERS, size: int = SLICE) -> DataFrame:
    """(bucket, n): features of all rows' text by bucket; a task sends one row a bucket at most."""
    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counter(buckets, orders, size), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: Iterable, target: Iterable, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln of the ratio of a bucket's smoothed shares in target and raw), by bucket; rows have bucket and n."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, rows in ((s, raw), (t, target)):
        for r in rows:
            counts[r["bucket"]] = r["n"]
    top, low = (t + 1) * (s.sum() + buckets), (s + 1) * (t.sum() + buckets)
    return np.array([math.floor(1000 * math.log(a / b)) for a, b in zip(top.tolist(), low.tolist(), strict=True)], np.int64)


def _weigher(gain: np.ndarray, orders: int, size: int):
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((3, batch.num_rows), np.int64)  # words, features, weight
            for block in blocks(batch.column("text").to_pylist(), orders, size):
                for k, (row, place, checksum) in enumerate(tuples(block, orders)):
                    n = np.bincount(row, minlength=batch.num_rows)
                    found[0] += n * (k == 0)
                    found[1] += n
                    found[2] += np.bincount(row, gain[checksum % buckets][place], batch.num_rows).astype(np.int64)
            kept = [(name, column) for name, column in zip(batch.schema.names, batch.columns, strict=True) if name != "text"]
            names = [name for name, _ in kept] + ["n_words", "n_features", "weight"]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(x, pa.int64()) for x in found], names=names)

    return weigh


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))) in doubles, u from the first 32 bits of sha256 of `seed:doc_id` (a null id is empty)."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    percent: int = 5,
    least_words: int = LEAST_WORDS,
    seed: int = 42,
    buckets: int = BUCKETS,
    orders: int = ORDERS,
    size: int = SLICE,
    carry: bool = False,
) -> DataFrame:
    """Weighs every document by how much likelier target texts hold its features than all documents do, and draws
    floor(percent * N / 100) of the N documents with at least least_words words, without replacement, by the highest
    weight plus Gumbel noise.

    Returns one row per row of docs: doc_id, n_words, n_features, weight, score, rank (1, 2, 3, ... of those drawn, else
    null), and, if carry, `row`, a struct of all columns of docs. Ties go to the smaller doc_id, a null doc_id last, then
    to the row with fewer features and weight; rows that agree in all of that are taken in any order, so each repeated row is
    a document of its own. Null and empty texts have no features and weight 0; an empty table gives an empty result, an
    empty target a uniform one; extra columns don't matter, whatever their names. A text of any length is
    read in parts of `size` bytes, so memory is bounded but for the text itself (and one word).
    """
    raw = bucket_counts(docs, buckets=buckets, orders=orders, size=size).collect()  # at most `buckets` rows each
    gain = gains(raw, bucket_counts(target, buckets=buckets, orders=orders, size=size).collect(), buckets)
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else [])
    )
    out = [f for f in base.schema.fields if f.name != "text"] + [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]
    weighed = base.mapInArrow(_weigher(gain, orders, size), T.StructType(out))
    scored = materialize(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "resample-scores")
    order = [(F.col("n_words") < least_words).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    # the row's own number comes last among the keys, so that repeated rows are dealt to several ranges
    numbered = scored.withColumn("_own", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(*order, F.col("_own").asc()).sortWithinPartitions(*order, F.col("_own").asc())
    placed = materialize(ranged.drop("_own").withColumn("_at", F.monotonically_increasing_id()), "resample-order")
    # the number is the range in the upper bits and the place within it in the lower 33
    placed = placed.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    enough = F.coalesce(F.sum((F.col("n_words") >= least_words).cast("long")), F.lit(0)).alias("enough")
    per_range = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), enough).collect()  # a row for each range of the exchange
    starts, seen = [], 0
    for r in sorted(per_range, key=lambda r: r["_range"]):
        starts.append((r["_range"], seen))
        seen += r["n"]
    drawn = percent * sum(r["enough"] for r in per_range) // 100
    first = F.broadcast(docs.sparkSession.createDataFrame(starts, "_range long, _start long"))
    rank = F.col("_start") + F.col("_at") + 1
    return placed.join(first, "_range").select(
        "doc_id", "n_words", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"), *(["row"] if carry else [])
    )


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs that are drawn, with their own columns."""
    return resample(docs, target, carry=True, **options).where("rank IS NOT NULL").select("row.*")
