"""Benchmark decontamination: pigeonhole pieces, exact hits, Myers' bit-parallel distance.

An item of m normalised characters may occur with up to e = floor(rate * m) edits. It is
split into e + 1 pieces; in any such occurrence one piece is untouched, so every
occurrence has an exact hit of a piece. An Aho-Corasick automaton finds all hits of all
pieces in one pass over a text; around each hit Myers' algorithm gives the smallest edit
distance of the whole item, with the blanks around it, to any part of the surroundings. Items are
taken in blocks of bounded size, every block against all rows; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docfields.llm.common import materialize

RATE = 0.08
BLOCK_CHARS = 8 << 20

MATCHES = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType())]))


def normalised(text: Column) -> Column:
    """Lower case; each run of anything but letters and digits becomes one blank, also at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def split_pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(place, piece) of edits + 1 pieces of nearly equal length that make up the item."""
    cuts = [len(item) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Myers:
    """Distance of one pattern to the nearest part of a text, a bit per pattern character."""

    def __init__(self, pattern: str) -> None:
        self.m, self.peq = len(pattern), {}
        for i, c in enumerate(pattern):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def best(self, text: str) -> int:
        mask, top, find = (1 << self.m) - 1, 1 << (self.m - 1), self.peq.get
        up, down, score = mask, 0, self.m
        least = score
        for c in text:
            eq = find(c, 0)
            diagonal = (((eq & up) + up) ^ up) | eq | down
            right, left = (down | ~(diagonal | up)) & mask, up & diagonal
            if right & top:
                score += 1
            elif left & top:
                score -= 1
                least = min(least, score)
            right, left = right << 1, left << 1
            up, down = (left | ~(diagonal | right)) & mask, right & diagonal
        return least


class Matcher:
    """Automaton of all pieces of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float) -> None:
        import ahocorasick

        self.items = [(item_id, text, int(rate * (len(text) - 2))) for item_id, text in items]
        self.verifiers: dict[int, Myers] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, edits) in enumerate(self.items):
            for at, piece in split_pieces(text, edits):
                places.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[dict]:
        """item_id and smallest distance of every item that occurs in a normalised text.

        Hits of an item's pieces give windows in which it may lie; windows that overlap are one stretch, and
        each stretch is measured once, however many pieces hit there."""
        if not self.items:
            return []
        found: dict[int, int] = {}
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for k, at in where:
                if found.get(k) == 0:
                    continue
                _, item, edits = self.items[k]
                start = end + 1 - length - at
                if start >= 0 and text.startswith(item, start):
                    found[k] = 0
                elif edits:
                    windows.setdefault(k, []).append((max(0, start - edits), min(len(text), start + len(item) + edits)))
        for k, own in windows.items():
            if found.get(k) == 0:
                continue
            _, item, edits = self.items[k]
            if k not in self.verifiers:
                self.verifiers[k] = Myers(item)
            for lo, hi in merged(own):
                distance = self.verifiers[k].best(text[lo:hi])
                if distance <= edits:
                    found[k] = min(found.get(k, distance), distance)
        return [{"item_id": self.items[k][0], "distance": d} for k, d in sorted(found.items())]


def merged(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Windows as stretches that don't overlap."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(windows):
        if out and lo < out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


_MATCHERS: dict[int, Matcher] = {}


def _matcher(block: Broadcast, rate: float) -> Matcher:
    """The worker's automaton for a block; built once in each worker."""
    key = hash((rate, *block.value))
    if key not in _MATCHERS:
        _MATCHERS.clear()  # an automaton is as large as a block allows; a task needs one
        _MATCHERS[key] = Matcher(block.value, rate)
    return _MATCHERS[key]


def _scan(block: Broadcast, rate: float):
    """Arrow function: normalised texts to the matches of a block's items."""

    @F.arrow_udf(MATCHES)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = _matcher(block, rate)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))
        for batch in batches:
            yield pa.array([matcher.find(t.as_py()) for t in batch], kind)

    return run


def item_blocks(benchmark: DataFrame, block_chars: int, nameless: bool) -> Iterator[list[tuple[int | None, str]]]:
    """Normalised items in blocks of at most block_chars characters (a longer item is a block by itself)."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), normalised(F.col("text")).alias("text"))
    rows = rows.where((F.length("text") > 2) & (F.col("item_id").isNotNull() | F.lit(nameless)))
    block, held = [], 0
    for item_id, text in rows.toLocalIterator():
        if block and held + len(text) > block_chars:
            yield block
            block, held = [], 0
        block.append((item_id, text))
        held += len(text)
    if block:
        yield block


def matches_of(spark: SparkSession, benchmark: DataFrame, text: Column, *, rate: float = RATE, block_chars: int = BLOCK_CHARS, nameless: bool = False) -> Iterator[Column]:
    """For each block of items: array<struct<item_id, distance>> of those that occur in a text; empty if none does.

    Null and empty texts match nothing. An item of m normalised characters, between blanks, may have floor(rate * m)
    edits, whatever m is (none below 1 / rate characters); items with a null id are looked for only if nameless, those
    without a letter or digit never; items with the same text are all
    reported, rows with the same item_id once each. An empty benchmark matches nothing. Rows
    don't affect each other, so repeats, null doc_ids and other columns need no care. The driver
    holds one block at a time.
    """
    for block in item_blocks(benchmark, block_chars, nameless):
        yield _scan(spark.sparkContext.broadcast(block), rate)(normalised(text))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, distance: a row for each row of docs and item that occurs in it. Blocks of
    items are scanned for one after the other."""
    own, out = docs.select("doc_id", "text"), None
    for matches in matches_of(docs.sparkSession, benchmark, F.col("text"), **options):
        found = own.select("doc_id", F.explode(matches).alias("m")).select("doc_id", "m.item_id", "m.distance")
        out = found if out is None else out.union(found)
    return out if out is not None else own.where("false").select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("distance"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs in which no item occurs, with an id or without, with their columns. After each
    block of items but the last, the rows left are a written table."""
    left = None
    for matches in matches_of(docs.sparkSession, benchmark, F.col("text"), nameless=True, **options):
        left = (docs if left is None else materialize(left, "decontaminated")).where(F.size(matches) == 0)
    return docs if left is None else left
