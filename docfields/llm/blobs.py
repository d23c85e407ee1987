"""Counting hashes of a whole corpus: chunks of documents, buckets of hashes, packed arrays.

Documents are dealt to chunks by a hash of their rows, hashes to buckets by their value.
A chunk sends each bucket one packed array of its distinct hashes (never more rows than
hashes), so a hash that occurs everywhere reaches its bucket once per chunk; the bucket
answers each chunk in the same order. Numbers of chunks and buckets follow the input's
size, so that either fits a task whatever the size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
HASH_SHIFT = np.uint64(16)  # 48 bits of a hash are counted: enough for 2 ** 40 different ones


def with_chunk(rows: DataFrame, n_chunks: int, *more: Column) -> DataFrame:
    """Adds chunk, by a hash of doc_id and text (null ids are dealt out by their texts)."""
    return rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", *more), F.lit(n_chunks)).cast("int"))


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers of up to 64 bits as byte planes, zstandard."""
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view("<u8").reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def pack_small(values: np.ndarray) -> bytes:
    """Bytes, zstandard."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, np.uint8).tobytes())


def unpack_small(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


def by_bucket(values: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For sorted distinct values: (bucket, places of its values, their sorted quotients)."""
    bucket = values % np.uint64(n_buckets)
    order = np.argsort(bucket.astype(np.uint16) if n_buckets <= 1 << 16 else bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        yield int(bucket[at[0]]), at, values[at] // np.uint64(n_buckets)


def merged(arrays: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, sum of weights of each)."""
    if not arrays:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    every, weight = np.concatenate(arrays), np.concatenate(weights)
    order = np.argsort(every, kind="stable")
    every, weight = every[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    return every[first], np.add.reduceat(weight, first) if len(every) else weight
