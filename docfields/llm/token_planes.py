"""Token-ID output: bit-plane blocks of ids, each plane compressed with zstandard, and an index.

A file is MAGIC, blocks, index, and its length in 8 bytes. A block holds up to
block_ids ids: plane p has bit p (or byte p) of every id, and planes above the largest
id's are left out. The index (JSON, zstandard) lists each block's place, number of ids
and plane lengths, and each document's id and number of ids, so a reader can fetch
any block by itself. Files are in ascending order of doc_id, one for each range of ids;
where a file begins in the whole stream follows from the counts that tasks reported.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docfields.llm import kernel
from docfields.llm.common import materialize, pieces, shared_path, total_bytes

MAGIC = b"DFPLANE1"
FILES = "part int, path string, n_docs long, n_ids long"
TOKENS = "doc_id long, start long, n_tokens long, ids_crc32 long"
CACHE = 2_500_000
AT_ONCE = 2_000

#: Characters for which classes of bytes tell letters, digits and marks apart.
SAFE = re.compile(r"[\x00-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-ſ]*")
SPACE, LETTER, DIGIT, MARK, END = range(5)
_CLASS = np.full(256, MARK, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = LETTER
_CLASS[128:] = LETTER  # parts of letters, in SAFE texts
_CLASS[255] = END  # in no UTF-8 text; after each text here


def cut(data: np.ndarray) -> np.ndarray:
    """Starts of the pieces of the byte-level pre-tokenizer in SAFE texts, each followed by 0xFF
    (which is a piece too): runs of letters, digits or marks, each with a blank before it; other
    white space up to the last before something else; contractions after an apostrophe."""
    kind = _CLASS[data]
    start = np.ones(len(data), bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == END
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < END) & (kind[1:] != SPACE))
    start[last] = True
    start[last[data[last] == 32] + 1] = False
    for at in np.flatnonzero((data == 39) & start):
        if kind[at + 1] == LETTER:
            two = data[at + 1 : at + 3].tobytes()
            n = 1 if two[:1] in (b"s", b"d", b"m", b"t") else 2 if two in (b"ll", b"ve", b"re") else 0
            if n:
                start[at + 1] = False
                if kind[at + 1 + n] == LETTER:
                    start[at + 1 + n] = True
    return np.flatnonzero(start)


class PieceTable:
    """Ids of pieces by hash, in sorted arrays: a large one and one of what came since."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys = [np.zeros(0, np.uint64)] * 2
        self.places = [np.zeros(0, np.int64)] * 2
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.n = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 for those not yet held."""
        out = np.full(len(keys), -1, np.int64)
        for own, places in zip(self.keys, self.places, strict=True):
            if len(own):
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                np.copyto(out, places[at], where=own[at] == keys)
        return out

    def add(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        """keys: sorted, none of them held."""
        sizes = np.array([len(i) for i in ids], np.int32)
        flat = np.fromiter((x for i in ids for x in i), np.uint32, int(sizes.sum()))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(keys) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        own = slice(self.n, self.n + len(keys))
        self.flat[self.used : self.used + len(flat)] = flat
        self.size[own] = sizes
        self.begin[own] = self.used + np.cumsum(sizes) - sizes
        k, at = np.concatenate([self.keys[1], keys]), np.concatenate([self.places[1], np.arange(own.start, own.stop)])
        if len(k) > 100_000 + len(self.keys[0]) // 4:
            k, at = np.concatenate([self.keys[0], k]), np.concatenate([self.places[0], at])
            order = np.argsort(k, kind="stable")
            self.keys, self.places = [k[order], np.zeros(0, np.uint64)], [at[order], np.zeros(0, np.int64)]
        else:
            order = np.argsort(k, kind="stable")
            self.keys[1], self.places[1] = k[order], at[order]
        self.used += len(flat)
        self.n += len(keys)


class Encoder:
    """Ids by the tokenizers library. The pre-tokenizer's pieces of a text are encoded once each and
    held by hash (at most about CACHE of them); a text with characters outside SAFE, or with the
    string of a special token, is encoded whole."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        spec = json.loads(self.own.to_str())
        step = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            spec.get("normalizer") is None and spec["model"].get("type") == "BPE"
            and step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space")
        )
        self.table = PieceTable()

    def _plain(self, text: str) -> bool:
        return self.by_piece and SAFE.fullmatch(text) is not None and not any(s in text for s in self.special)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        plain = [self._plain(t) for t in texts]
        pieced = iter(self._by_pieces([t.encode() for t, ok in zip(texts, plain, strict=True) if ok]))
        return [next(pieced) if ok else np.array(self.own.encode(t, add_special_tokens=False).ids, np.uint32) for t, ok in zip(texts, plain, strict=True)]

    def _by_pieces(self, texts: list[bytes]) -> list[np.ndarray]:
        if not texts:
            return []
        raw = b"\xff".join([*texts, b""])
        data = np.frombuffer(raw, np.uint8)
        begin = cut(data)
        end = np.append(begin[1:], len(data))
        real = data[begin] != 255
        text = np.cumsum(~real)[real]  # number of texts that ended before each piece
        begin, end = begin[real], end[real]
        keys, first, inverse = np.unique(kernel.span_hash(kernel.prefix_hash(data), begin, end), return_index=True, return_inverse=True)
        if self.table.n + len(keys) > CACHE:
            self.table.clear()
        place = self.table.find(keys)
        new = np.flatnonzero(place < 0)
        if len(new):
            strings = [raw[a:b].decode() for a, b in zip(begin[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
            ids: list[list[int]] = []
            for at in range(0, len(strings), AT_ONCE):  # what the library returns takes about 1 KB a piece
                ids += [e.ids for e in self.own.encode_batch_fast(strings[at : at + AT_ONCE], add_special_tokens=False)]
            place[new] = np.arange(self.table.n, self.table.n + len(new))
            self.table.add(keys[new], ids)
        size, start = self.table.size[place][inverse], self.table.begin[place][inverse]
        stop = np.cumsum(size, dtype=np.int64)
        spots = np.repeat(start - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)
        of_text = np.bincount(text, size, len(texts)).astype(np.int64)
        return np.split(self.table.flat[spots], np.cumsum(of_text)[:-1])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; workers are used again for later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def to_planes(ids: np.ndarray, bits: bool = True) -> list[bytes]:
    """The planes of a block, lowest first, up to that of the largest id."""
    width = int(ids.max()).bit_length() if len(ids) else 0
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, p].tobytes() for p in range(-(-width // 8))]
    spread = np.unpackbits(raw[:, : -(-width // 8)], axis=1, bitorder="little")
    return [np.packbits(spread[:, p], bitorder="little").tobytes() for p in range(width)]


def from_planes(planes: list[bytes], n: int, bits: bool = True) -> np.ndarray:
    """The ids of a block; undoes to_planes."""
    if not bits:
        raw = np.zeros((n, 4), np.uint8)
        for p, data in enumerate(planes):
            raw[:, p] = np.frombuffer(data, np.uint8)
        return raw.reshape(-1).view("<u4")
    spread = np.zeros((n, 32), np.uint8)
    for p, data in enumerate(planes):
        spread[:, p] = np.unpackbits(np.frombuffer(data, np.uint8), count=n, bitorder="little")
    return np.packbits(spread, axis=1, bitorder="little").reshape(-1).view("<u4")


class PlaneWriter:
    """Streams ids of documents into one file; holds one block."""

    def __init__(self, out, block_ids: int, bits: bool, level: int) -> None:
        self.out, self.block_ids, self.bits, self.pack = out, block_ids, bits, zstandard.ZstdCompressor(level=level)
        self.held, self.n_held, self.at = [], 0, len(MAGIC)
        self.blocks, self.doc_ids, self.lengths = [], [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        for at in range(0, len(ids), self.block_ids):
            self.held.append(ids[at : at + self.block_ids])
            self.n_held += len(self.held[-1])
            while self.n_held >= self.block_ids:
                self._flush()

    def _flush(self) -> None:
        whole = np.concatenate(self.held)
        block, rest = whole[: self.block_ids], whole[self.block_ids :]
        packed = [self.pack.compress(p) for p in to_planes(block, self.bits)]
        self.blocks.append([self.at, len(block), [len(p) for p in packed]])
        for p in packed:
            self.out.write(p)
            self.at += len(p)
        self.held, self.n_held = [rest], len(rest)

    def close(self) -> None:
        if self.n_held:
            self._flush()
        index = self.pack.compress(json.dumps({"bits": self.bits, "blocks": self.blocks, "doc_ids": self.doc_ids, "lengths": self.lengths}).encode())
        self.out.write(index + struct.pack("<Q", len(index)))
        self.out.close()


class PlaneFile:
    """Reads a file by its index: all blocks in turn, or one."""

    def __init__(self, store: fs.FileSystem, path: str) -> None:
        self.file = store.open_input_file(path)
        size = self.file.size()
        (length,) = struct.unpack("<Q", self.file.read_at(8, size - 8))
        if self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is no plane file")
        self.unpack = zstandard.ZstdDecompressor()
        index = json.loads(self.unpack.decompress(self.file.read_at(length, size - 8 - length)))
        self.bits, self.blocks, self.doc_ids, self.lengths = (index[k] for k in ("bits", "blocks", "doc_ids", "lengths"))

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.blocks[k]
        data, planes = self.file.read_at(sum(sizes), at), []
        for size in sizes:
            planes.append(self.unpack.decompress(data[:size]))
            data = data[size:]
        return from_planes(planes, n, self.bits)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """(doc_id, number of ids, crc32 of the ids), holding one block at a time."""
        have, k = np.zeros(0, "<u4"), 0
        for doc_id, length in zip(self.doc_ids, self.lengths, strict=True):
            crc, left = 0, length
            while left:
                if not len(have):
                    have, k = self.block(k), k + 1
                crc = zlib.crc32(have[:left].tobytes(), crc)
                take = min(left, len(have))
                have, left = have[take:], left - take
            yield doc_id, length, crc


def _writer(folder: str, tokenizer: str, end_id: int, block_ids: int, bits: bool, level: int, slice_bytes: int = 1 << 20):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name, writer = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.planes", None
        encode, end = encoder(tokenizer), np.array([end_id], np.uint32)
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            if writer is None:
                store.create_dir(base, recursive=True)
                writer = PlaneWriter(store.open_output_stream(f"{base}/{name}", compression=None), block_ids, bits, level)
            ids, texts, size = [], [], 0
            for i in range(batch.num_rows):
                ids.append(batch.column(0)[i].as_py())
                texts.append(batch.column(1)[i].as_py() or "")
                size += len(texts[-1])
                if size >= slice_bytes or i == batch.num_rows - 1:
                    for doc_id, own in zip(ids, encode(texts), strict=True):
                        writer.add(doc_id, np.concatenate([own, end]))
                    ids, texts, size = [], [], 0
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{folder}/{name}", "n_docs": len(writer.lengths), "n_ids": sum(writer.lengths)}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return write


def write_tokens(
    docs: DataFrame, tokenizer: str, *, end_id: int = 2, folder: str | None = None, file_bytes: int = 32 << 20, block_ids: int = 1 << 16, bits: bool = True, level: int = 3
) -> DataFrame:
    """Writes the ids of every whole text in ascending doc_id order; the table of the files.

    Null text counts as empty (its end id only); null doc_ids come first; rows that share a
    doc_id are documents of their own, in the order of a hash of their texts; an empty table
    gives no files; other columns don't matter. tokenizer: path of a tokenizers JSON file,
    present on every worker. A file covers about file_bytes of text, found by range
    sampling on doc_id and that hash, so that rows of one doc_id may lie in several files.
    """
    folder = folder or shared_path(docs.sparkSession, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = pieces(total_bytes(rows), file_bytes)
    tie = F.xxhash64("text")
    rows = rows.withColumn("tie", tie).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return materialize(rows.mapInArrow(_writer(folder, tokenizer, end_id, block_ids, bits, level), FILES), "token-files")


def _reader(rows: int = 5000):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                out = []
                for doc_id, n, crc in PlaneFile(store, name).documents():
                    out.append((doc_id, start, n, crc))
                    start += n
                    if len(out) >= rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return read


def read_tokens(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    return placed.repartition(max(1, files.count())).mapInArrow(_reader(), TOKENS)
