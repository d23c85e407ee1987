"""Language-model scoring with a log-frequency Bloom filter.

Counts of all words and word pairs of the training texts are gathered by hash (see
blobs), quantised to 1 + floor(log_b count), and held in a Bloom filter: an n-gram is
inserted once for every level up to its own, with hash functions of the level. A count
comes back by probing level after level until a probe fails. The filter is made of one
segment per bucket of hashes. While a bound of its size, words x bits, is below
broadcast_bytes, the driver gathers the segments and broadcasts the filter; beyond it
every n-gram of a chunk is probed in the segment of its bucket, where it has been
counted, and the answers go to the chunk. Both ways give the same scores.

P(w | h) = a * min(c(h w), c(h)) / c(h) + (1 - a) * (c(w) + 1) / (N + V + 1), without the
first part where c(h) is 0; 1 - a is the share of word pairs seen once in training, the
Good-Turing estimate of the mass of pairs not seen. The start of a text is a context, its
end a word. base_score is the sum of log10((c(w) + 1) / (N + V + 1)) with exact counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm import blobs, kernel
from docfields.llm.common import in_fold, materialize, pieces, word_count

LOG_BASE = 1.5
HASHES = 5
BITS_PER_ENTRY = 7.2
BROADCAST_BYTES = 64 << 20
END = np.uint64(kernel.mix_int(2))
START = np.uint64(kernel.mix_int(1))
#: kinds of rows from buckets: exact counts of words, levels of words and of pairs, segment, totals
EXACT, WORD_LEVELS, PAIR_LEVELS, SEGMENT, TOTALS = range(5)

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def level_of(counts: np.ndarray) -> np.ndarray:
    """Quantised count: 0 for 0, else 1 + floor(log_b count)."""
    out = np.zeros(len(counts), np.int64)
    some = counts > 0
    out[some] = 1 + np.floor(np.log(counts[some]) / np.log(LOG_BASE) + 1e-9).astype(np.int64)
    return out


def level_means() -> np.ndarray:
    """Mean of the counts that each level stands for."""
    edges = np.ceil(LOG_BASE ** np.arange(100) - 1e-9)
    return np.concatenate([[0.0], (edges[:-1] + np.maximum(edges[1:] - 1, edges[:-1])) / 2])


class Segment:
    """Part of the filter that holds the n-grams of one bucket."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @classmethod
    def build(cls, grams: np.ndarray, levels: np.ndarray) -> Segment:
        n = max(64, int(levels.sum() * BITS_PER_ENTRY))
        out = cls(np.zeros(-(-n // 8), np.uint8))
        for level in range(1, int(levels.max(initial=0)) + 1):
            some = grams[levels >= level]
            for h in range(HASHES):
                at = out._places(some, level, h)
                np.bitwise_or.at(out.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        return out

    def _places(self, grams: np.ndarray, level: int, h: int) -> np.ndarray:
        salt = np.uint64(((level * HASHES + h) * 0x9E3779B97F4A7C15) % (1 << 64))
        return kernel.mix(grams ^ salt) % np.uint64(8 * len(self.bits))

    def probe(self, grams: np.ndarray) -> np.ndarray:
        """Level of each n-gram: probes level 1, 2, ... until one fails."""
        out, left, level = np.zeros(len(grams), np.uint8), np.arange(len(grams)), 0
        while len(left):
            level += 1
            for h in range(HASHES):
                at = self._places(grams[left], level, h)
                left = left[(self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                if not len(left):
                    break
            out[left] = level
        return out


def gram(value: np.ndarray, kind: int) -> np.ndarray:
    """A counted value (all 64 bits of a word's hash, 48 of a pair's) as an n-gram of the filter."""
    return kernel.mix(value ^ np.uint64(0xA0761D6478BD642F if kind == PAIR_LEVELS else 0))


class Chunk:
    """Words and pairs of a chunk's texts and their distinct values."""

    def __init__(self, table: pa.Table) -> None:
        self.ids, self.held = table.column("doc_id").to_pylist(), table.column("held").to_numpy()
        texts = [(t or "").encode() for t in table.column("text").to_pylist()]
        runs, lengths = [], []
        for a, b in kernel.slices(texts):
            hashes, offsets = kernel.words(texts[a:b])
            n = np.diff(offsets)
            run = np.empty(len(hashes) + 2 * len(n), np.uint64)
            starts = offsets[:-1] + 2 * np.arange(len(n))
            inside = np.ones(len(run), bool)
            inside[starts] = inside[starts + n + 1] = False
            run[starts], run[starts + n + 1], run[inside] = START, END, hashes
            runs.append(run)
            lengths.append(n + 2)
        run = np.concatenate(runs) if runs else np.zeros(0, np.uint64)
        self.lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(texts)), self.lengths)
        self.words, self.word = np.unique(run, return_inverse=True)
        self.second = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # places of words and ends, not of starts
        pairs = kernel.mix(run[self.second - 1] * np.uint64(0x9E3779B97F4A7C15) + run[self.second]) >> blobs.HASH_SHIFT
        self.pairs, self.pair = np.unique(pairs, return_inverse=True)
        self.owner = owner[self.second]
        trained = ~self.held[owner].astype(bool)
        self.word_counts = np.bincount(self.word, trained, len(self.words)).astype(np.int64)
        self.pair_counts = np.bincount(self.pair, trained[self.second], len(self.pairs)).astype(np.int64)


def _asker(n_buckets: int):
    def ask(table: pa.Table) -> pa.Table:
        number, own, out = table.column("chunk")[0].as_py(), Chunk(table), []
        for kind, values, counts in ((WORD_LEVELS, own.words, own.word_counts), (PAIR_LEVELS, own.pairs, own.pair_counts)):
            for b, at, q in blobs.by_bucket(values, n_buckets):
                out.append((number, b, kind, blobs.pack_sorted(q), blobs.pack(counts[at])))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["chunk", "bucket", "kind", "hashes", "counts"])

    return ask


ANSWERS = "chunk int, bucket int, kind int, data binary, v long, n long"


def _counter(n_buckets: int, send_segment: bool):
    """A bucket's totals, its segment if that is to be broadcast, and the answers to each chunk:
    exact counts of words, and, unless the segment is sent, levels probed in it."""
    def count(table: pa.Table) -> pa.Table:
        bucket, out = table.column("bucket")[0].as_py(), []
        chunks, kinds = table.column("chunk").to_pylist(), np.array(table.column("kind").to_pylist())
        asked = [blobs.unpack_sorted(b) * np.uint64(n_buckets) + np.uint64(bucket) for b in table.column("hashes").to_pylist()]
        counts = [blobs.unpack(b).astype(np.int64) for b in table.column("counts").to_pylist()]
        every, found = {}, {}
        for kind in (WORD_LEVELS, PAIR_LEVELS):
            some = np.flatnonzero(kinds == kind)
            values, total = every[kind] = blobs.merged([asked[i] for i in some], [counts[i] for i in some])
            found[kind] = values[total > 0], total[total > 0]
        grams = np.concatenate([gram(v, kind) for kind, (v, _) in found.items()])
        segment = Segment.build(grams, np.concatenate([level_of(c) for _, c in found.values()]))
        values, total = found[WORD_LEVELS]
        real = values != START
        out.append((-1, bucket, TOTALS, None, int(real.sum()), int(total[real].sum())))
        once = found[PAIR_LEVELS][1]
        out.append((-2, bucket, TOTALS, None, int((once == 1).sum()), int(once.sum())))
        if send_segment:
            out.append((-1, bucket, SEGMENT, segment.bits.tobytes(), None, None))
        # each n-gram that any chunk asks for is probed once; a chunk's answers are looked up
        levels = {} if send_segment else {kind: segment.probe(gram(v, kind)) for kind, (v, _) in every.items()}
        for i, values in enumerate(asked):
            own, total = every[kinds[i]]
            at = np.searchsorted(own, values)
            if kinds[i] == WORD_LEVELS:
                out.append((chunks[i], bucket, EXACT, blobs.pack(total[at]), None, None))
            if not send_segment:
                out.append((chunks[i], bucket, int(kinds[i]), blobs.pack_small(levels[kinds[i]][at]), None, None))
        types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["chunk", "bucket", "kind", "data", "v", "n"])

    return count


def _scorer(n_buckets: int, v: int, n: int, mass: float, filter_):
    """Scores of a chunk's texts from the buckets' answers (and the broadcast filter, if there is one)."""
    means = level_means()

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = Chunk(table)
        told = {(k, b): d for k, b, d in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "data")), strict=True)}
        exact = np.zeros(len(own.words), np.int64)
        levels = {WORD_LEVELS: np.zeros(len(own.words), np.uint8), PAIR_LEVELS: np.zeros(len(own.pairs), np.uint8)}
        for kind, values in ((WORD_LEVELS, own.words), (PAIR_LEVELS, own.pairs)):
            for b, at, _ in blobs.by_bucket(values, n_buckets):
                if kind == WORD_LEVELS:
                    exact[at] = blobs.unpack(told[EXACT, b]).astype(np.int64)
                if filter_ is not None:
                    levels[kind][at] = filter_.value[b].probe(gram(values[at], kind)) if b in filter_.value else 0
                else:
                    levels[kind][at] = blobs.unpack_small(told[kind, b])
        word, context = own.word[own.second], own.word[own.second - 1]
        count, seen = exact[word], means[levels[WORD_LEVELS]]
        base = np.log10((count + 1) / (n + (v + 1)))
        lower = (seen[word] + 1) / (n + v + 1)
        before = seen[context]
        with np.errstate(invalid="ignore", divide="ignore"):
            higher = np.minimum(means[levels[PAIR_LEVELS]][own.pair], before) / before
        chance = np.where(before > 0, mass * higher + (1 - mass) * lower, lower)
        sums = [np.bincount(own.owner, x, len(own.ids)) for x in (base, np.log10(chance), count > 0)]
        cols = (own.ids, own.held.astype(bool), own.lengths - 1, sums[2].astype(np.int64), np.full(len(own.ids), n), sums[0], sums[1])
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    return score


def score_texts(docs: DataFrame, *, modulus: int = 7, remainder: int = 2, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from the rows whose crc32(doc_id as text) mod modulus isn't remainder (a null id
    counts as the empty string) and scores all. Null and empty texts are an end alone; rows
    that repeat a doc_id are texts of their own; without training rows c, N and V are 0; an
    empty table gives an empty result; other columns don't matter.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size, n_words, n_rows = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(word_count(F.col("text"))), F.lit(0)), F.count(F.lit(1))).first()
    n_buckets = pieces(size, blobs.BUCKET_BYTES)
    # levels of a count never exceed it, so entries don't exceed words, ends, starts and pairs in training
    bound = (2 * n_words + 3 * n_rows) * BITS_PER_ENTRY / 8 + 8 * n_buckets
    sent = bound <= broadcast_bytes
    dealt = blobs.with_chunk(rows.withColumn("held", in_fold(F.col("doc_id"), modulus, remainder)), pieces(size, blobs.CHUNK_BYTES))
    asked = dealt.groupBy("chunk").applyInArrow(_asker(n_buckets), "chunk int, bucket int, kind int, hashes binary, counts binary")
    answers = materialize(asked.groupBy("bucket").applyInArrow(_counter(n_buckets, sent), ANSWERS), "lm-answers")
    totals = {r["chunk"]: r for r in answers.where(F.col("kind") == TOTALS).groupBy("chunk").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()}
    v, n, once, pairs = (totals[c][k] if c in totals else 0 for c, k in ((-1, "v"), (-1, "n"), (-2, "v"), (-2, "n")))
    mass = min(0.95, max(0.05, 1 - once / pairs)) if pairs else 0.05
    filter_ = None
    if sent:
        segments = {r["bucket"]: Segment(np.frombuffer(r["data"], np.uint8)) for r in answers.where(F.col("kind") == SEGMENT).select("bucket", "data").collect()}
        filter_ = docs.sparkSession.sparkContext.broadcast(segments)
    told = answers.where("chunk >= 0").select("chunk", "bucket", "kind", "data")
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_scorer(n_buckets, v, n, mass, filter_), RESULT)
