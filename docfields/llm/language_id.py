"""Language ID by bit-sliced Bloom filters of byte n-grams.

Training counts every n-gram of letters per language over all training texts and takes as a
language's n-grams those that are frequent in it, relative to the language in which they
are most frequent. All filters have the same size and hash functions and are stored
bit-sliced: a row per position, a bit per language. Each n-gram of a text is looked up in
k rows; their AND has a bit for every language that contains it. Per text and language the
bits are counted and corrected by the filter's rate of false positives; the largest
corrected share decides. The model's size is fixed by its parameters (rows x languages / 8
bytes), never by the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docfields.llm import blobs, kernel
from docfields.llm.common import in_fold, materialize

UNDETERMINED = "und"
SIZES = (3, 4)
MOST_LANGUAGES = 1024
HELD_GRAMS = 1 << 19
PIECE = 1 << 16  # bytes of a text looked up at a time
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_grams", T.LongType())])

#: bytes of letters: a-z and all of multi-byte characters; everything else ends a word
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_FOLD[0xC2] = 32  # lead byte of Latin-1 signs; letters of that block but three have 0xC3


def grams(text: bytes | np.ndarray) -> np.ndarray:
    """Every n-gram of a text as a number, its length and bytes: n bytes of a word with the blank before or
    after it, or with both."""
    data = _FOLD[np.frombuffer(text, np.uint8)] if isinstance(text, bytes) else text
    wide = data.astype(np.uint64)
    blank = data == 32
    out = []
    for n in SIZES:
        m = len(data) - n + 1
        if m <= 0:
            continue
        code = np.full(m, n, np.uint64)
        inner = np.zeros(m, bool)
        for j in range(n):
            code = (code << np.uint64(8)) | wide[j : j + m]
            if 0 < j < n - 1:
                inner |= blank[j : j + m]
        out.append(code[~inner])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def grams_of(text: bytes, size: int = kernel.SLICE) -> Iterator[np.ndarray]:
    """grams of a long text piece by piece, cut at blanks."""
    text, at = b" " + text + b" ", 0
    while at < len(text) - 1:
        end = min(len(text), at + size)
        if end < len(text):
            cut = text.rfind(b" ", at + 1, end)
            end = cut + 1 if cut > at else end
        yield grams(text[at:end])
        at = end - 1 if end < len(text) else end


class Tally:
    """Counts of the n-grams of one language, as sorted arrays that are merged when they get long."""

    def __init__(self) -> None:
        self.values, self.counts, self.more, self.held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, found: np.ndarray) -> None:
        self.more.append(np.unique(found, return_counts=True))
        self.held += len(self.more[-1][0])
        if self.held > HELD_GRAMS:
            self.merge()

    def merge(self) -> None:
        every = [(self.values, self.counts), *self.more]
        self.values, self.counts = blobs.merged([v for v, _ in every], [c for _, c in every])
        self.more, self.held = [], 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a partition; what is held is handed on before it gets large."""
    held: dict[str, Tally] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for lang, tally in held.items():
            tally.merge()
            for part in range(0, len(tally.values), 1 << 16):
                some = slice(part, part + (1 << 16))
                n = len(tally.values[some])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array(tally.values[some].astype(np.int64)), pa.array(tally.counts[some])], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(text.encode())
        for lang, own in by.items():
            for a, b in kernel.slices(own):
                for found in grams_of(b" ".join(own[a:b])):
                    held.setdefault(lang, Tally()).add(found)
        if sum(len(t.values) + t.held for t in held.values()) > 4 * HELD_GRAMS:
            yield from told()
    yield from told()


@dataclass
class Filters:
    """Bit-sliced Bloom filters: rows[h] has a bit for every language whose filter has bit h set."""

    langs: list[str]
    rows: np.ndarray  # (2 ** log_rows, words of 64 languages)
    log_rows: int
    hashes: int
    false_rate: np.ndarray

    @classmethod
    def build(cls, sets: dict[str, np.ndarray], log_rows: int, hashes: int) -> Filters:
        """sets: the n-grams of each language."""
        langs = sorted(sets)
        rows = np.zeros((1 << log_rows, max(1, -(-len(langs) // 64))), np.uint64)
        out = cls(langs, rows, log_rows, hashes, np.zeros(len(langs)))
        for k, lang in enumerate(langs):
            for h in range(hashes):
                rows[out.places(sets[lang], h), k // 64] |= np.uint64(1) << np.uint64(k % 64)
            filled = ((rows[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()
            out.false_rate[k] = filled**hashes
        return out

    def places(self, found: np.ndarray, h: int) -> np.ndarray:
        return (kernel.mix(found + np.uint64(0x51ED27 * (h + 1) << 40)) >> np.uint64(64 - self.log_rows)).astype(np.int64)

    def masks(self, found: np.ndarray) -> np.ndarray:
        """Languages that contain each n-gram, as bits."""
        out = self.rows[self.places(found, 0)]
        for h in range(1, self.hashes):
            out &= self.rows[self.places(found, h)]
        return out

    def hits(self, found: np.ndarray) -> np.ndarray:
        """Number of the n-grams that each language contains."""
        masks = self.masks(found)
        return np.array([np.count_nonzero(masks[:, k // 64] & (np.uint64(1) << np.uint64(k % 64))) for k in range(len(self.langs))], np.int64)


def predict(filters: Filters, texts: Sequence[str | None]) -> list[tuple[str, float, int]]:
    """(language, score, n-grams) of each text; see language_of."""
    out = []
    for text in texts:
        if not text or not filters.langs or not any(map(str.isalpha, text)):
            out.append((UNDETERMINED, 0.0, 0))
            continue
        hits, n = np.zeros(len(filters.langs), np.int64), 0
        for found in grams_of(text.encode(), PIECE):
            n += len(found)
            hits += filters.hits(found)
        share = (hits / max(n, 1) - filters.false_rate) / np.maximum(1 - filters.false_rate, 1e-9)
        best = int(np.argmax(share))
        out.append((filters.langs[best], float(min(1.0, max(0.0, share[best]))), n))
    return out


def train(docs: DataFrame, *, log_rows: int = 21, hashes: int = 3, share: float = 0.5, least: float = 2e-6, most_languages: int = MOST_LANGUAGES) -> Filters:
    """Filters from all rows of docs whose text and lang are there.

    A language has an n-gram if its rate there is at least `least` and at least `share`
    of its highest rate in any language. So the driver gets 1 / least n-grams of each language at
    most; more languages than most_languages are an error, as that bounds the filters too.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    counts = materialize(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram-counts")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    if total.count() > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    rate = counts.join(F.broadcast(total), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("rate"))
    top = rate.groupBy("gram").agg(F.collect_list(F.struct("lang", "rate")).alias("all"), F.max("rate").alias("top"))
    kept = top.select("gram", F.expr(f"transform(filter(all, x -> x.rate >= {share} * top AND x.rate >= {least}D), x -> x.lang)").alias("langs")).where("size(langs) > 0")
    table = kept.toArrow()
    found, langs = table["gram"].to_numpy().astype(np.uint64), table["langs"].combine_chunks()
    flat, each = np.array(langs.flatten().to_pylist(), object), np.diff(langs.offsets.to_numpy())
    owner = np.repeat(found, each)
    return Filters.build({lang: owner[flat == lang] for lang in set(flat.tolist())}, log_rows, hashes)


def language_of(filters: Filters, text: Column) -> Column:
    """struct(lang_pred, score, n_grams) of a text column.

    `und` with score 0 where the text is null or empty or has no letter, or nothing was
    learned; ties go to the language first by name. Score is the corrected share of the
    text's n-grams that the language contains, cut to 0..1. Rows don't affect each other,
    so repeats, null ids, other columns and empty tables need no care.
    """
    model = SparkSession.active().sparkContext.broadcast(filters)

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = model.value
        for batch in batches:
            got = predict(own, batch.to_pylist())
            yield pa.StructArray.from_arrays(
                [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64())],
                names=["lang_pred", "score", "n_grams"],
            )

    return run(text)


def held_out_languages(docs: DataFrame, *, modulus: int = 4, remainder: int = 2, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_grams; learned from the rows outside the fold.

    lang is looked at in training only; a null doc_id is in the fold of the empty string."""
    held = in_fold(F.col("doc_id"), modulus, remainder)
    filters = train(docs.where(~held).select("lang", "text"), **options)
    x = docs.select("doc_id", held.alias("held_out"), language_of(filters, F.col("text")).alias("p"))
    return x.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.n_grams")
