"""Suffix-array dedup: removes bytes covered by 400-byte strings that occur elsewhere.

Every 400-byte window has one anchor, its leftmost smallest 64-byte gram by hash; equal
windows have equal anchors in equal places, so each anchor's windows can be settled by
themselves. Grams are counted over the corpus; where an anchor's gram occurs more than
once, the bytes that its windows cover go to the task of that gram. There the suffixes
that begin at anchors are sorted into a sparse suffix array with longest common prefixes
and, for the bytes before the anchors, longest common suffixes. A stack scan walks the
common-prefix interval tree; in each interval of prefix r the occurrences whose left
extension agrees with another's over l >= 400 - r bytes form its repeats: each occurrence is
covered from l bytes before its anchor to r bytes after it, whichever other it repeats, not
just its neighbour in the array.

A gram that occurs very often is cut into blocks of occurrences. Each block is scanned by
itself; its windows that aren't repeated within it, and one of each that is, are then
matched between blocks by hash, a hash that a block has once or often counting once.

Texts with a short period are thinned before they are cut out (see periodic), and long ones come in parts, so what a chunk
holds doesn't depend on what its texts hold.

Passages are found in the same pass: the anchor of a 400-byte window is that of every
200-byte window around it, so the anchors of 200-byte windows include those of 400-byte ones.
Runs of bytes covered by repeated 200-byte strings that hold over 50 words are passages; they
are reported, not removed, as removal goes by 400 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm import blobs, kernel
from docfields.llm.common import materialize, pieces, total_bytes

GRAM = 64
BLOCK = 1024

SHORT = 200
PASSAGE_WORDS = 50

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long"
PARTS = "task int, chunk int, meta binary, data binary, spans binary"
FOUND = "chunk int, bucket int, spans binary, hashes binary"


def anchors(data: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(gram hash, anchor, first window, last window, text number) of every run of windows with
    one anchor, for texts at data[begin:end]; windows don't leave their text."""
    n = len(data) - GRAM + 1
    span = width - GRAM + 1
    if n < span:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    prefix = kernel.prefix_hash(data)
    inverse = kernel.powers(kernel.BASE_INVERSE, len(data))[:n]
    hashes = kernel.mix((prefix[GRAM:] - prefix[:n]) * inverse)
    keys = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, np.uint64)
    keys[:n] = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    rows = keys.reshape(-1, span)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n_windows = n - span + 1
    least = np.minimum(behind[:n_windows], ahead[span - 1 : span - 1 + n_windows])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    some = np.flatnonzero(end - begin >= width)
    counts = (end - begin - width + 1)[some]
    starts = np.repeat(begin[some] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(int(counts.sum()))
    text = np.repeat(some, counts)
    own = at[starts]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])])) if len(own) else np.zeros(0, np.int64)
    last = np.concatenate([first[1:] - 1, [len(own) - 1]]) if len(first) else first
    return hashes[own[first]], own[first], starts[first], starts[last], text[first]


def periodic(data: np.ndarray, found: tuple[np.ndarray, ...], short: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of the anchors() of short windows are needed, spans (text number, begin, end) of bytes that repeat where they are).

    Where a text repeats itself every d <= short - GRAM bytes, the same gram is an anchor every d bytes, so that each byte would be
    cut out width / d times. All windows of an anchor in such a run begin between the one before and it; if they end within
    the run, they are those of every other such anchor. So one of these anchors stands for all of them, and if there are
    two or more, all their windows occur elsewhere: what they cover is a span."""
    gram, anchor, _, _, text = found
    needed = np.ones(len(anchor), bool)
    step = np.diff(anchor)
    like = (gram[1:] == gram[:-1]) & (text[1:] == text[:-1]) & (step <= short - GRAM)
    spans = []
    if like.any():
        new = np.flatnonzero(np.concatenate([[True], (like[1:] != like[:-1]) | (step[1:] != step[:-1])]))
        stop = np.append(new[1:], len(like))
        long = like[new] & (anchor[stop] + GRAM - anchor[new] >= width + 2 * step[new])  # hardly any: two windows' anchors at least
        for a, b in zip(new[long].tolist(), stop[long].tolist(), strict=True):  # anchors a .. b are d apart
            d, begin, end = int(step[a]), int(anchor[a]), int(anchor[b]) + GRAM
            inner = int(np.searchsorted(anchor[a + 1 : b + 1], end - width, "right"))  # of a + 1, ..., those whose windows end in time
            if inner > 1 and np.array_equal(data[begin : end - d], data[begin + d : end]):
                needed[a + 2 : a + 1 + inner] = False
                spans.append((int(text[a]), begin + 1, int(anchor[a + inner]) + width))
    return needed, np.array(spans, np.int64).reshape(-1, 3)


class Chunk:
    """A chunk's texts in a fixed order; equal texts of it are scanned once."""

    def __init__(self, table: pa.Table, short: int, width: int) -> None:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = table.column("doc_id").to_pylist()
        self.texts = [(t or "").encode() for t in table.column("text").to_pylist()]
        self.short, self.width = short, width
        copies: dict[bytes, list[int]] = {}
        for i, t in enumerate(self.texts):
            if len(t) >= short:
                copies.setdefault(t, []).append(i)
        self.firsts = [c[0] for c in copies.values()]
        self.copied = {i for c in copies.values() if len(c) > 1 for i in c}

    def pieces(self) -> Iterator[tuple[list[int], list[bytes], int, int, int]]:
        """(places of texts, their bytes, place of the first byte in its text, anchors from, to) about kernel.SLICE bytes at a
        time. A long text comes in parts that overlap by the widest window on both sides, so that all windows of an anchor
        lie in the part that has the anchor."""
        own = [self.texts[i] for i in self.firsts]
        for a, b in kernel.slices(own):
            if b - a > 1 or len(own[a]) <= 2 * kernel.SLICE:
                yield self.firsts[a:b], own[a:b], 0, 0, 1 << 62
                continue
            for at in range(0, len(own[a]), kernel.SLICE):
                low = max(0, at - self.width)
                yield [self.firsts[a]], [own[a][low : at + kernel.SLICE + self.width]], low, at - low, at - low + kernel.SLICE

    def runs(self) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]]:
        """(bytes, anchors() of short windows that are needed, places in the chunk of the texts, where each begins and its length,
        place of the first byte in its text, spans of periodic()) of each of pieces()."""
        for places, texts, base, low, high in self.pieces():
            data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
            lengths = np.array([len(t) for t in texts])
            begin = np.cumsum(lengths + 1) - lengths - 1
            found = anchors(data, begin, begin + lengths, self.short)
            mine = (found[1] >= low) & (found[1] < high)
            found = found if mine.all() else tuple(x[mine] for x in found)
            needed, spans = periodic(data, found, self.short, self.width)
            found = found if needed.all() else tuple(x[needed] for x in found)
            yield data, found, np.array(places), begin, lengths, base, spans


def gram_counts(runs: Iterable[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 48-bit gram values, how often each is an anchor) of Chunk.runs()."""
    every = [run[1][0] >> blobs.HASH_SHIFT for run in runs]
    return np.unique(np.concatenate(every), return_counts=True) if every else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _asker(n_buckets: int, short: int, width: int):
    def ask(table: pa.Table) -> pa.Table:
        values, counts = gram_counts(Chunk(table, short, width).runs())
        out = [(b, blobs.pack_sorted(q), blobs.pack(counts[at].astype(np.uint64))) for b, at, q in blobs.by_bucket(values, n_buckets)]
        number = table.column("chunk")[0].as_py()
        cols = ([number] * len(out), [r[0] for r in out], [r[1] for r in out], [r[2] for r in out])
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["chunk", "bucket", "hashes", "counts"])

    return ask


def _answer(table: pa.Table) -> pa.Table:
    """ceil(log2) of each gram's count, for each chunk in its order."""
    asked = [blobs.unpack_sorted(b) for b in table.column("hashes").to_pylist()]
    values, counts = blobs.merged(asked, [blobs.unpack(c).astype(np.int64) for c in table.column("counts").to_pylist()])
    levels = np.ceil(np.log2(counts)).astype(np.uint8)
    told = [blobs.pack_small(levels[np.searchsorted(values, a)]) for a in asked]
    return pa.table([table.column("chunk"), table.column("bucket"), pa.array(told, pa.binary())], names=["chunk", "bucket", "levels"])


def _cutter(n_buckets: int, n_tasks: int, short: int, width: int):
    """PARTS of a chunk: the bytes under all windows, short and wide, whose anchor's gram occurs elsewhere, by
    task. meta has, of each, gram value, block + 1 if the gram is in blocks, place of the text in the
    chunk, place of the first byte in the text, bytes before the anchor, length; first byte of and
    number of short windows, and the same of wide ones (none where they have other anchors). spans: those of periodic()."""

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        number, chunk = table.column("chunk")[0].as_py(), Chunk(table, short, width)
        runs = list(chunk.runs())  # the chunk's bytes once more and its anchors, some of them in a hundred bytes
        values, _ = gram_counts(runs)
        levels = np.zeros(len(values), np.uint8)
        told = dict(zip(answers.column("bucket").to_pylist(), answers.column("levels").to_pylist(), strict=True))
        for b, at, _ in blobs.by_bucket(values, n_buckets):
            levels[at] = blobs.unpack_small(told[b])
        metas, datas, local = [], [], []
        for data, (grams, anchor, first, last, text), places, origin, lengths, base, spans in runs:
            local.append(np.stack([places[spans[:, 0]], spans[:, 1] - origin[spans[:, 0]] + base, spans[:, 2] - origin[spans[:, 0]] + base, np.ones(len(spans), np.int64)], axis=1))
            value = grams >> blobs.HASH_SHIFT
            level = levels[np.searchsorted(values, value)].astype(np.int64) if len(values) else np.zeros(0, np.int64)
            some = level > 0
            value, level, anchor, first, last, text = (x[some] for x in (value, level, anchor, first, last, text))
            n_short, n_wide, first_wide = last - first + 1, np.zeros(len(first), np.int64), first.copy()
            _, wide_anchor, wide_first, wide_last, _ = anchors(data, origin, origin + lengths, width)
            if len(wide_anchor) and len(anchor):  # both in ascending order, an anchor once each
                at = np.minimum(np.searchsorted(wide_anchor, anchor), len(wide_anchor) - 1)
                has = wide_anchor[at] == anchor
                first_wide[has], n_wide[has] = wide_first[at][has], (wide_last - wide_first + 1)[at][has]
            begin = np.minimum(first, first_wide)
            end = np.maximum(last + short, np.where(n_wide > 0, first_wide + n_wide - 1 + width, 0))
            spread = kernel.mix(first.astype(np.uint64) * np.uint64(1_000_003) + places[text].astype(np.uint64) + np.uint64(number << 40))
            n_blocks = np.uint64(1) << np.maximum(level - int(np.log2(BLOCK)), 0).astype(np.uint64)
            block = np.where(n_blocks > 1, (spread % n_blocks).astype(np.int64) + 1, 0)
            place = begin - origin[text] + base
            metas.append(np.stack([value.astype(np.int64), block, places[text], place, anchor - begin, end - begin, first - begin, n_short, first_wide - begin, n_wide], axis=1))
            raw = data.tobytes()
            datas += [raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        out = []
        if datas:
            meta = np.concatenate(metas)
            task = (kernel.mix(meta[:, 0].astype(np.uint64) * np.uint64(31) + meta[:, 1].astype(np.uint64)) % np.uint64(n_tasks)).astype(np.int64)
            order = np.argsort(task, kind="stable")
            pack = zstandard.ZstdCompressor(level=3)
            for at in np.split(order, np.flatnonzero(np.diff(task[order])) + 1):
                out.append((int(task[at[0]]), number, pack.compress(meta[at].tobytes()), pack.compress(b"".join(datas[i] for i in at)), None))
        here = np.concatenate(local) if local else np.zeros((0, 4), np.int64)
        if len(here):
            out.append((number % n_tasks, number, zstandard.compress(b""), zstandard.compress(b""), zstandard.compress(here.tobytes())))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["task", "chunk", "meta", "data", "spans"])

    return cut


def _padded(data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows of bytes from start on (step 1) or before it backwards (step -1), padded with zeros."""
    spots = start[:, None] + (np.arange(width) if step > 0 else -1 - np.arange(width))
    rows = data[np.clip(spots, 0, len(data) - 1)]
    rows[np.arange(width) >= length[:, None]] = 0
    return rows


def _sorted_common(rows: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by group and row, bytes in common of each with the next in that order; -1 across groups)."""
    order = np.argsort(length, kind="stable")
    order = order[np.argsort(rows[order].view(f"S{rows.shape[1]}").reshape(-1), kind="stable")]
    order = order[np.argsort(group[order], kind="stable")]
    a, b = order[:-1], order[1:]
    differ = rows[a] != rows[b]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    common = np.minimum(common, np.minimum(length[a], length[b]))
    return order, np.where(group[a] == group[b], common, -1)


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first, last, r) of every common-prefix interval of a suffix array, inner ones first, by a
    stack scan: the longest runs in which neighbours have at least r bytes in common, r reached."""
    stack: list[tuple[int, int]] = []
    for i, r in enumerate([*common, -1]):
        first = i
        while stack and stack[-1][1] > r:
            first, height = stack.pop()
            yield first, i, height
        if not stack or stack[-1][1] < r:
            stack.append((first, r))


def repeats(data: np.ndarray, group: np.ndarray, start: np.ndarray, before: np.ndarray, length: np.ndarray, width: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(occurrences, l of each, r) of each repeat group of anchored strings.

    String i is data[start[i] : start[i] + length[i]] with its anchor at before[i]; only
    strings of one group are compared. An occurrence in a result shares l bytes before
    and r bytes after the anchor with another occurrence in it, l + r >= width."""
    anchor, after = start + before, length - before
    right, common = _sorted_common(_padded(data, anchor, after, width, 1), after, group)
    left, shared = _sorted_common(_padded(data, anchor, before, width - GRAM + 1, -1), before, group)
    rank = np.empty(len(left), np.int64)
    rank[left] = np.arange(len(left))
    common[common < GRAM] = -1
    edges = np.flatnonzero(common < 0)
    begins, ends = np.concatenate([[0], edges + 1]), np.concatenate([edges, [len(right) - 1]])
    sizes = ends - begins + 1
    two = begins[sizes == 2]
    if len(two):
        low = np.minimum(rank[right[two]], rank[right[two + 1]])
        high = np.maximum(rank[right[two]], rank[right[two + 1]])
        l_two, r_two = np.zeros(len(two), np.int64), common[two]
        beside = high - low == 1
        l_two[beside] = shared[low[beside]]
        for i in np.flatnonzero(~beside):
            l_two[i] = shared[low[i] : high[i]].min()
        for i in np.flatnonzero(l_two + r_two >= least):
            yield right[two[i] : two[i] + 2], np.array([l_two[i]] * 2), int(r_two[i])
    for b, e in zip(begins[sizes > 2], ends[sizes > 2], strict=True):
        for first, last, r in intervals(common[b:e].tolist()):
            own = right[b + first : b + last + 1]
            ranks = np.sort(rank[own])
            agree = np.minimum.reduceat(shared[: ranks[-1]], ranks[:-1])
            # left extension: bytes that an occurrence shares with the one before or after it in left order
            best = np.maximum(np.concatenate([[-1], agree]), np.concatenate([agree, [-1]]))
            some = best + r >= least
            if some.any():
                yield left[ranks[some]], best[some], r


def _hot_windows(hot: np.ndarray, group: np.ndarray, start: np.ndarray, shift: np.ndarray, count: np.ndarray, prefix: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(hash, owner, place in its string, whether its block has it once only) of the different windows of
    `size` bytes in the strings named by hot: those that begin at shift, count of them."""
    counts = count[hot]
    owner = np.repeat(hot, counts)
    at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + shift[owner]
    hashes = kernel.span_hash(prefix, start[owner] + at, start[owner] + at + size)
    key = np.stack([group[owner].astype(np.uint64), hashes], axis=1)
    order = np.lexsort((key[:, 1], key[:, 0]))
    new = np.flatnonzero(np.concatenate([[True], (key[order][1:] != key[order][:-1]).any(axis=1)])) if len(order) else np.zeros(0, np.int64)
    often = np.diff(np.concatenate([new, [len(order)]])) > 1
    one = order[new]
    return hashes[one], owner[one], at[one], ~often


def found_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names=["chunk", "bucket", "spans", "hashes"])


def _finder(n_hashes: int, short: int, width: int):
    """FOUND of a task: spans (place, begin, end, whether width bytes or more) by chunk; for grams in blocks,
    window hashes by bucket: (hash, chunk or -1 if the block has it often, place, begin, size)."""

    def find(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        metas = [np.frombuffer(unpack.decompress(m), np.int64).reshape(-1, 10) for m in table.column("meta").to_pylist()]
        data = np.frombuffer(b"".join(unpack.decompress(d) for d in table.column("data").to_pylist()), np.uint8)
        chunk = np.repeat(np.array(table.column("chunk").to_pylist()), [len(m) for m in metas])
        value, block, place, first, before, length, at_short, n_short, at_wide, n_wide = np.concatenate(metas).T
        if not len(value):
            rows = [(c, None, s, None) for c, s in zip(table.column("chunk").to_pylist(), table.column("spans").to_pylist(), strict=True) if s is not None]
            return found_table(rows)
        start = np.cumsum(length) - length
        _, group = np.unique(np.stack([value, block], axis=1), axis=0, return_inverse=True)
        group = group.reshape(-1)
        rows = []
        for own, l, r in repeats(data, group, start, before, length, width, short):
            at = first[own] + before[own]
            rows.append(np.stack([chunk[own], place[own], at - l, at + r, l + r >= width], axis=1))
        spans = np.concatenate(rows) if rows else np.zeros((0, 5), np.int64)
        spans = np.unique(spans, axis=0)
        out = [(int(c), None, zstandard.compress(np.ascontiguousarray(spans[spans[:, 0] == c, 1:]).tobytes()), None) for c in np.unique(spans[:, 0])]
        out += [(c, None, s, None) for c, s in zip(table.column("chunk").to_pylist(), table.column("spans").to_pylist(), strict=True) if s is not None]
        hot = np.flatnonzero(block > 0)
        if len(hot):
            prefix = kernel.prefix_hash(data)
            told = []
            for size, shift, count in ((short, at_short, n_short), (width, at_wide, n_wide)):
                hashes, owner, at, once = _hot_windows(hot, group, start, shift, count, prefix, size)
                told.append(np.stack([hashes.astype(np.int64), np.where(once, chunk[owner], -1), place[owner], first[owner] + at, np.full(len(at), size)], axis=1))
            every = np.concatenate(told)
            bucket = (every[:, 0].astype(np.uint64) % np.uint64(n_hashes)).astype(np.int64)
            for b in np.unique(bucket):
                out.append((None, int(b), None, zstandard.compress(np.ascontiguousarray(every[bucket == b]).tobytes())))
        return found_table(out)

    return find


def _matcher(width: int):
    """Spans, by chunk, of windows whose hash more than one block has (a hash tells its window's size too)."""

    def match(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        told = np.concatenate([np.frombuffer(unpack.decompress(h), np.int64).reshape(-1, 5) for h in table.column("hashes").to_pylist()])
        _, inverse, counts = np.unique(told[:, 0], return_inverse=True, return_counts=True)
        told = told[(counts[inverse.reshape(-1)] > 1) & (told[:, 1] >= 0)]
        out = []
        for c in np.unique(told[:, 1]):
            own = told[told[:, 1] == c]
            out.append((int(c), zstandard.compress(np.stack([own[:, 2], own[:, 3], own[:, 3] + own[:, 4], own[:, 4] >= width], axis=1).tobytes())))
        return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["chunk", "spans"])

    return match


def covered(lengths: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each byte of the texts, one after the other with a gap, is in a span; where texts begin)."""
    begin = np.cumsum(lengths + 1) - lengths - 1
    depth = np.zeros(int(lengths.sum()) + len(lengths) + 1, np.int32)
    np.add.at(depth, begin[spans[:, 0]] + spans[:, 1], 1)
    np.add.at(depth, begin[spans[:, 0]] + spans[:, 2], -1)
    return np.cumsum(depth) > 0, begin


def n_words(text: bytes) -> int:
    """Words between white space, without a list of them."""
    space = kernel.is_space(np.frombuffer(text, np.uint8))
    return int(np.count_nonzero(space[:-1] & ~space[1:])) + int(len(space) > 0 and not space[0])


def passage_bytes(text: bytes, repeated: np.ndarray, words: int = PASSAGE_WORDS) -> int:
    """Bytes in runs of repeated ones that hold over `words` whole words."""
    edges = np.flatnonzero(np.diff(repeated.astype(np.int8), prepend=0, append=0))
    runs = [(a, b) for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True)]
    total = 0
    for a, b in runs:
        whole = n_words(text[a:b])
        whole -= a > 0 and not text[a - 1 : a].isspace() and not text[a : a + 1].isspace()
        whole -= b < len(text) and not text[b - 1 : b].isspace() and not text[b : b + 1].isspace()
        total += b - a if whole > words else 0
    return total


def _remover(short: int, width: int):
    def remove(table: pa.Table, found: pa.Table) -> pa.Table:
        own, unpack = Chunk(table, short, width), zstandard.ZstdDecompressor()
        spans = [np.frombuffer(unpack.decompress(s), np.int64).reshape(-1, 4) for s in found.column("spans").to_pylist()]
        spans.append(np.array([(i, 0, len(own.texts[i]), len(own.texts[i]) >= width) for i in own.copied], np.int64).reshape(-1, 4))
        every, lengths = np.concatenate(spans), np.array([len(t) for t in own.texts], np.int64)
        gone, begin = covered(lengths, every[every[:, 3] > 0])
        repeated, _ = covered(lengths, every)
        out = []
        for doc_id, text, at in zip(own.ids, own.texts, begin.tolist(), strict=True):
            mask = gone[at : at + len(text)]
            n = int(mask.sum())
            kept = np.frombuffer(text, np.uint8)[~mask].tobytes() if n else text
            n_spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if n else 0
            again = repeated[at : at + len(text)]
            out.append((doc_id, len(text), n, n_spans, hashlib.sha256(kept).hexdigest(), passage_bytes(text, again) if again.any() else 0))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in RESULT.split(", ")])

    return remove


def remove_repeats(docs: DataFrame, *, width: int = 400, short: int = SHORT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and n_passage_bytes of every row.

    A byte goes if a string of width bytes that covers it starts anywhere else too, in the same
    text or another; all strings are those of the input. Null counts as an empty text; rows that
    repeat a doc_id, or have none, are texts of their own (so both of two equal rows go); texts
    shorter than width keep everything; an empty table gives an empty result; other columns
    don't matter. n_passage_bytes counts the bytes of passages: runs covered by strings of `short`
    bytes that start anywhere else too, with over 50 whole words. short is at least 2 * GRAM,
    width at least short.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = total_bytes(rows)
    n_buckets = pieces(size, blobs.BUCKET_BYTES)
    n_tasks = pieces(size, blobs.BUCKET_BYTES // 2, 12)
    dealt = blobs.with_chunk(rows, pieces(size, blobs.CHUNK_BYTES))
    asked = dealt.groupBy("chunk").applyInArrow(_asker(n_buckets, short, width), "chunk int, bucket int, hashes binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer, "chunk int, bucket int, levels binary")
    parts = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_cutter(n_buckets, n_tasks, short, width), PARTS)
    found = materialize(parts.groupBy("task").applyInArrow(_finder(n_tasks, short, width), FOUND), "repeats")
    between = found.where("hashes IS NOT NULL").select("bucket", "hashes").groupBy("bucket").applyInArrow(_matcher(width), "chunk int, spans binary")
    spans = found.where("spans IS NOT NULL").select("chunk", "spans").union(between)
    return dealt.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(_remover(short, width), RESULT)
