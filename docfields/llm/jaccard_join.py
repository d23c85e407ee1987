"""N-gram Jaccard join: T-occurrence search with DivideSkip over inverted lists.

1. Every document becomes its set of hashed shingles. Equal sets are one class.
2. Document frequencies of all shingles are counted over the corpus. A set of n shingles
   shares at least T = ceil(0.75 n) of them with any partner, so a set with fewer than T
   shingles that occur elsewhere has none.
3. Of the rest, partners share one of their n - T + 1 rarest shingles. Components of that
   relation are blocks: no link crosses two of them.
4. In a block, each set searches the inverted lists for sets that occur in T of its lists:
   short lists are merged by a heap, long ones probed for the candidates by binary search. Every link
   counts for both its sets, as often as the other has rows; a forest of links is kept for the
   components. A block of many sets is cut into sub-blocks: each is searched in itself, and
   each two of them one against the other, so that every pair of sets is met once.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm import blobs, kernel
from docfields.llm.common import materialize, pieces, total_bytes
from docfields.llm.components import components

WORDS = 5
PERCENT = 75
SUB_BLOCK = 1500
PROBES = 8  # long lists probed at a time

#: h: hash of the text as it is
SETS = "doc_id long, h long, n long, d1 long, d2 long, shared binary, prefix int"


def needed(n: int) -> int:
    """Overlap that any partner of a set of n has at least."""
    return (PERCENT * n + 99) // 100


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit sums over each set's hashes."""
    lengths = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), 2), np.uint64)
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    some = lengths > 0
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[some] if len(sets) else []
    for k, salt in enumerate((0x8F5C28F5C28F5C29, 0x3C6EF372FE94F82B)):
        if len(every):
            out[some, k] = np.add.reduceat(kernel.mix(every ^ np.uint64(salt)), starts)
    return out


def _sets_of(table: pa.Table) -> tuple[list[int | None], list[np.ndarray], np.ndarray, list[int]]:
    """(ids, sets, digests, place of the first row of each different set) of a chunk, smallest id first.

    table: in the order of doc_id."""
    ids = table.column("doc_id").to_pylist()
    sets = kernel.word_sets([(t or "").encode() for t in table.column("text").to_pylist()], WORDS)
    digests = _digests(sets)
    firsts: dict[tuple[int, int, int], int] = {}
    for i, s in enumerate(sets):
        firsts.setdefault((len(s), int(digests[i, 0]), int(digests[i, 1])), i)
    return ids, sets, digests, sorted(firsts.values())


def _asker(n_buckets: int):
    """A chunk's distinct shingles, and whether two or more of its different sets have them."""

    def ask(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        _, sets, _, firsts = _sets_of(table.sort_by("doc_id"))
        every = np.concatenate([sets[i] >> blobs.HASH_SHIFT for i in firsts])
        values, counts = np.unique(every, return_counts=True)
        out = [(chunk, b, blobs.pack_sorted(q), np.packbits(counts[at] > 1).tobytes()) for b, at, q in blobs.by_bucket(values, n_buckets)]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["chunk", "bucket", "hashes", "twice"])

    return ask


def _answer(table: pa.Table) -> pa.Table:
    """Document frequency (255: that or more; within a chunk two or more count as two) for each chunk, in its order."""
    asked = [blobs.unpack_sorted(b) for b in table.column("hashes").to_pylist()]
    twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(a)).astype(np.int64) + 1 for a, t in zip(asked, table.column("twice").to_pylist(), strict=True)]
    values, counts = blobs.merged(asked, twice)
    counts = np.minimum(counts, 255).astype(np.uint8)
    answers = [blobs.pack_small(counts[np.searchsorted(values, a)]) for a in asked]
    return pa.table([table.column("chunk"), table.column("bucket"), pa.array(answers, pa.binary())], names=["chunk", "bucket", "df"])


def _candidates(n_buckets: int):
    """Rows of SETS of a chunk; `shared`, of one row per different set that can have partners,
    holds its shingles that occur elsewhere, rarest first, and prefix how many of them decide."""

    def settle(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        ids, sets, digests, firsts = _sets_of(table)
        values = np.unique(np.concatenate([sets[i] >> blobs.HASH_SHIFT for i in firsts])) if firsts else np.zeros(0, np.uint64)
        df = np.zeros(len(values), np.uint8)
        told = dict(zip(answers.column("bucket").to_pylist(), answers.column("df").to_pylist(), strict=True))
        for b, at, _ in blobs.by_bucket(values, n_buckets):
            df[at] = blobs.unpack_small(told[b])
        shared, prefix = [None] * len(ids), [0] * len(ids)
        for i in firsts:
            own = df[np.searchsorted(values, sets[i] >> blobs.HASH_SHIFT)]
            some = own > 1
            spare = int(some.sum()) - needed(len(sets[i]))
            if len(sets[i]) and spare >= 0:
                hashes = sets[i][some]
                shared[i] = hashes[np.argsort(own[some], kind="stable")].tobytes()
                prefix[i] = spare + 1
        signed = digests.view(np.int64)
        cols = (ids, table.column("h"), [len(s) for s in sets], signed[:, 0], signed[:, 1], shared, prefix)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "h", "n", "d1", "d2", "shared", "prefix"])

    return settle


def shingle_sets(docs: DataFrame) -> DataFrame:
    """SETS of all rows of docs (steps 1 and 2), as a written table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    size = total_bytes(rows)
    n_buckets = pieces(size, blobs.BUCKET_BYTES)
    dealt = blobs.with_chunk(rows, pieces(size, blobs.CHUNK_BYTES))
    asked = dealt.groupBy("chunk").applyInArrow(_asker(n_buckets), "chunk int, bucket int, hashes binary, twice binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer, "chunk int, bucket int, df binary")
    return materialize(dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_candidates(n_buckets), SETS), "shingle-sets")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(s, np.int64)[:p] for s, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        if sets:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(sets)), pa.array(np.repeat(batch.column(0).to_numpy(), [len(s) for s in sets]))], names=["h", "k"]
            )


class Forest:
    """Union-find over places 0 .. n - 1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


class InvertedLists:
    """Lists of the sets, by place, that hold each shingle; one sorted array of (shingle, place)."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.n = len(sets)
        self.values, rank = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(self.n), [len(s) for s in sets])
        self.keys = np.sort(rank.astype(np.int64) * self.n + owner)
        self.begin = np.searchsorted(self.keys, np.arange(len(self.values) + 1) * self.n)
        self.owner = self.keys % self.n

    def _merged(self, begin: np.ndarray, length: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, number of lists) of the places in `least` or more of the lists, by a heap of the lists' heads.

        Where too few lists have the smallest head, the least - 1 smallest heads are popped: only their lists hold
        a place before the head that is left, so they skip to it by binary search."""
        k, end = len(length), np.cumsum(length)
        at, end = (end - length).tolist(), end.tolist()
        spots = np.repeat(begin - np.array(at, np.int64), length) + np.arange(end[-1])
        # place * k + list, so that a head names its list; eight bytes each
        heads = array("q", (self.owner[spots] * k + np.repeat(np.arange(k), length)).tobytes())
        heap = [heads[i] for i in at]
        heapify(heap)
        found, counts = [], []
        while len(heap) >= least:
            place, n = heap[0] // k, 0
            stop = (place + 1) * k
            while heap and heap[0] < stop:
                i = heap[0] % k
                at[i] += 1
                if at[i] < end[i]:
                    heapreplace(heap, heads[at[i]])
                else:
                    heappop(heap)
                n += 1
            if n >= least:
                found.append(place)
                counts.append(n)
            elif len(heap) >= least:
                out = [heappop(heap) % k for _ in range(least - 1)]
                goal = heap[0] - heap[0] % k
                for i in out:
                    at[i] = bisect_left(heads, goal, at[i], end[i])
                    if at[i] < end[i]:
                        heappush(heap, heads[at[i]])
        return np.array(found, np.int64), np.array(counts, np.int64)

    def occurring(self, query: np.ndarray, least: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, number of the query's lists each is in) of the sets before limit that are in
        `least` lists or more (T-occurrence, DivideSkip). Short lists are merged by a heap; a set in too few of
        them can't reach `least` with all long ones; for the others the long lists are probed by
        binary search, longest last, and a set is given up once the lists left can't bring it there."""
        none = np.zeros(0, np.int64)
        rank = np.searchsorted(self.values, query)
        rank = np.sort(rank[(rank < len(self.values)) & (self.values[np.minimum(rank, len(self.values) - 1)] == query)])
        begin = self.begin[rank]
        end = self.begin[rank + 1] if limit >= self.n else np.searchsorted(self.keys, rank * self.n + limit)
        length = end - begin
        rank, begin, length = rank[length > 0], begin[length > 0], length[length > 0]
        if len(rank) < least:
            return none, none
        order = np.argsort(length, kind="stable")
        n_long = min(least - 1, int(least / (0.01 * np.log2(max(2, int(length.max()))) + 1)))
        short, long = order[: len(order) - n_long], order[len(order) - n_long :]
        places, total = self._merged(begin[short], length[short], least - n_long)
        if not len(places):
            return none, none
        open_ = np.arange(len(places))
        for at in range(0, n_long, PROBES):
            lists = rank[long[at : at + PROBES]]
            probes = lists[:, None] * self.n + places[open_][None, :]
            spots = np.minimum(np.searchsorted(self.keys, probes), len(self.keys) - 1)
            total[open_] += (self.keys[spots] == probes).sum(axis=0)
            open_ = open_[total[open_] + n_long - at - len(lists) >= least]
            if not len(open_):
                break
        enough = total >= least
        return places[enough], total[enough]


def links(sizes: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, asked: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(a forest of links that spans the components of all links, rows linked to each place).

    sizes, sets, copies: of each place, in ascending size, with its number of rows; asked: whether
    a place is searched for among those that aren't; without, all are, each among those before it."""
    forest, out, linked = Forest(len(sets)), [], np.zeros(len(sets), np.int64)
    held = np.arange(len(sets)) if asked is None else np.flatnonzero(~asked)
    queries = held if asked is None else np.flatnonzero(asked)
    if not len(held) or not len(queries):
        return out, linked
    index = InvertedLists([sets[i] for i in held])
    for q in queries.tolist():
        places, both = index.occurring(sets[q], needed(int(sizes[q])), q if asked is None else index.n)
        found = held[places]
        found = found[100 * both >= PERCENT * (int(sizes[q]) + sizes[found] - both)]
        linked[q] += copies[found].sum()
        linked[found] += copies[q]
        out += [(c, q) for c in found.tolist() if forest.join(c, q)]
    return out, linked


#: links of the forest (n 0), and rows that the links of a set a reach (b null)
LINKS = "a long, b long, n long"


def _search(table: pa.Table) -> pa.Table:
    """LINKS of every block of a task. Rows: block, k, n, shared, copies, role (0 only looked for in, 1 searched
    for among those, 2 all among each other)."""
    out: list[tuple[int, int | None, int]] = []
    blocks = table.column("block").to_numpy()
    order = np.lexsort((table.column("k").to_numpy(), table.column("n").to_numpy(), blocks))
    table = table.take(pa.array(order))
    blocks, sizes, ks = blocks[order], table.column("n").to_numpy(), table.column("k").to_numpy()
    roles, copies = table.column("role").to_numpy(), table.column("copies").to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in table.column("shared").to_pylist()]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]])
    for a, b in zip(cuts, cuts[1:], strict=False):
        found, linked = links(sizes[a:b], sets[a:b], copies[a:b], roles[a:b] == 1 if roles[a] < 2 else None)
        out += [(int(ks[a + c]), int(ks[a + q]), 0) for c, q in found]
        out += [(int(ks[a + i]), None, int(linked[i])) for i in np.flatnonzero(linked)]
    return pa.table([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["a", "b", "n"])


def set_links(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """LINKS between different sets, by their d1 (steps 3 and 4); classes: e1, e2, m, copies of each set."""
    some = sets.where("shared IS NOT NULL").dropDuplicates(["d1", "d2", "n"])
    some = some.join(classes, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n") == F.col("m")))
    some = materialize(some.select(F.col("d1").alias("k"), "n", "shared", "prefix", "copies"), "candidates")
    postings = some.select("k", "shared", "prefix").mapInArrow(_postings, "h long, k long")
    lists = postings.groupBy("h").agg(F.min("k").alias("m"), F.max("k").alias("x")).where("m != x").select(F.col("h").alias("g"), "m")
    edges = postings.join(lists, F.col("h") == F.col("g")).select(F.col("k").alias("a"), F.col("m").alias("b"))
    roots = components(edges)
    tops = roots.select(F.col("root").alias("a"), "root").distinct()
    roots = materialize(roots.union(tops), "blocks")
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.select(F.col("root").alias("block"), F.ceil(F.col("size") / SUB_BLOCK).cast("int").alias("n_sub"))
    rows = some.join(roots, F.col("k") == F.col("a")).join(sizes, F.col("root") == F.col("block"))
    rows = rows.select("block", "k", "n", "shared", "copies", "n_sub", F.pmod(F.xxhash64("k"), F.col("n_sub").cast("long")).cast("int").alias("sub"))
    rows = materialize(rows, "block-rows")
    n_tasks = pieces(rows.count(), SUB_BLOCK, 12)

    columns = ["task", "block", "k", "n", "shared", "copies", "role"]
    whole = rows.where("n_sub = 1").withColumn("task", F.pmod(F.xxhash64("block"), F.lit(n_tasks))).withColumn("role", F.lit(2))
    cut = rows.where("n_sub > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_sub") - 1)))
    cut = cut.withColumn("task", F.xxhash64("block", F.least("sub", "other"), F.greatest("sub", "other")))
    cut = cut.withColumn("role", F.when(F.col("sub") == F.col("other"), 2).otherwise((F.col("sub") > F.col("other")).cast("int")))
    tasks = whole.select(columns).union(cut.select(columns))
    return materialize(tasks.groupBy("task").applyInArrow(_search, LINKS), "links")


def jaccard_rows(docs: DataFrame) -> DataFrame:
    """Columns of jaccard_links, h, the xxhash64 of the row's text, and root, which tells components apart
    even where ids repeat (null: no link)."""
    sets = shingle_sets(docs)
    classes = sets.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("n").alias("m"), "low", "copies"), "set-classes")
    found = set_links(sets, classes.select("e1", "e2", "m", "copies"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    linked = found.where("b IS NULL").groupBy(F.col("a").alias("l")).agg(F.sum("n").alias("linked"))
    placed = classes.join(roots, F.col("e1") == F.col("a"), "left").withColumn("root", F.coalesce("root", "e1"))
    named = placed.groupBy("root").agg(F.min("low").alias("component"), F.sum("copies").alias("members")).where("members > 1")
    # written, so that the join's sides are plain exchanges, of which Spark splits those with a hot root
    named = materialize(named, "named")
    named = placed.join(named.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).join(linked, F.col("e1") == F.col("l"), "left")
    named = named.select("e1", "e2", "m", "root", "component", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("links"))
    out = sets.join(named, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n") == F.col("m")), "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        "h", "root",
    )


def jaccard_links(docs: DataFrame) -> DataFrame:
    """jaccard_components(docs) and n_links: the number of other rows that a row links to, copies included."""
    return jaccard_rows(docs).drop("h", "root")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach, itself included.

    A link joins two documents whose sets of 5-word shingles (A-Z in lower case; of fewer
    words, the whole sequence) have a Jaccard similarity of 0.75 or more. Null, empty and
    blank texts have an empty set and no link. One row per input row: rows that repeat a doc_id
    are documents of their own; a row with a null doc_id links as others do but never names a
    component (without any id in it, component_id is null). An empty table gives an empty
    result; other columns don't matter.
    """
    return jaccard_links(docs).drop("n_links")
