"""Byte-level BPE by backtracking over longest matches; decoding by an offset table.

A piece of text (of the pre-tokenizer) is read from the left by its longest tokens, found by an
Aho-Corasick automaton. Two neighbouring tokens can stand in an encoding only if merging their bytes
gives just these two; whether they do is kept in a table of pairs. Where no token fits the one before,
the place is given up for good and the token before is shortened, so a piece takes a number of steps
linear in its length and gives the ids that merging by rank gives. Pieces that occur again are looked up.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The pieces of the byte-level pre-tokenizer.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most pieces, pairs of tokens and characters of a piece that a worker keeps.
HELD_PIECES, HELD_PAIRS, HELD_CHARS = 400_000, 2_000_000, 64
WINDOW = 1 << 18
BLOCK_IDS = 1 << 16


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabularies of byte-level BPE: printable ones for themselves, the
    others, in turn, for the letters from U+0100 on."""
    out, other = {}, 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            out[chr(byte)] = byte
        else:
            out[chr(256 + other)] = byte
            other += 1
    return out


class Pieces(dict):
    """Ids of pieces as little-endian bytes; one that isn't held is encoded, and held unless it is long."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encode(piece.encode()), "<u4").tobytes()
        if len(piece) <= HELD_CHARS:
            if len(self) >= HELD_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class BytePairs:
    """Encoder and decoder of a vocabulary file (JSON of the tokenizers library, byte-level BPE)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, step = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model.get("type", "BPE") != "BPE" or not plain or spec.get("normalizer") or step.get("type") != "ByteLevel" or step.get("add_prefix_space") or not step.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        letters = byte_letters()
        raw = {i: bytes(letters[c] for c in token) for token, i in model["vocab"].items()}
        number = {token: i for i, token in raw.items()}
        if any(bytes([b]) not in number for b in range(256)):
            raise ValueError(f"{path} has no token for some bytes")
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}  # of each merged token
        for rank, pair in enumerate(model["merges"]):
            left, right = (number[bytes(letters[c] for c in half)] for half in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank[left, right] = rank
            self.halves.setdefault(number[raw[left] + raw[right]], (left, right))
        self.length = {i: len(token) for i, token in raw.items()}
        self.reach = max(self.length.values())
        self.automaton = ahocorasick.Automaton()
        for i, token in raw.items():
            if len(token) == 1 or i in self.halves:  # others can't come of merges
                self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        usable = {token for i, token in raw.items() if len(token) == 1 or i in self.halves}
        self.shorter = {number[t]: next((number[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in usable), -1) for t in usable}
        self.fits: dict[tuple[int, int], bool] = {}
        self.held = Pieces(self.piece)
        self.pattern = regex.compile(PIECE)
        added = {t["content"]: t for t in spec.get("added_tokens", [])}
        if any(t[k] for t in added.values() for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has added tokens with rules of their own")
        self.added = {content: np.array([t["id"]], "<u4").tobytes() for content, t in added.items()}
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        every = raw | {t["id"]: content.encode() for content, t in added.items()}
        self.offset = np.zeros(max(every) + 2, np.int64)
        np.cumsum([len(every.get(i, b"")) for i in range(max(every) + 1)], out=self.offset[1:])
        self.letters = np.frombuffer(b"".join(every.get(i, b"") for i in range(max(every) + 1)), np.uint8)

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at a token's left (0) or right (1) end while it is merged, each with the rank of the merge that ends it."""
        out = [(token, np.inf)]
        while token in self.halves:
            pair = self.halves[token]
            token = pair[side]
            out.append((token, self.rank[pair]))
        return out

    def pair_fits(self, left: int, right: int) -> bool:
        """Whether left and right stay apart: no two tokens that meet at their border are merged before either has gone
        into a larger one. Of two equal merges the left one comes first, so one within left goes before one across."""
        found = self.fits.get((left, right))
        if found is None:
            ends = self.edge(right, 0)
            found = not any(self.rank.get((a, b), np.inf) < till and self.rank[a, b] <= until for a, till in self.edge(left, 1) for b, until in ends)
            if len(self.fits) >= HELD_PAIRS:
                self.fits.clear()
            self.fits[left, right] = found
        return found

    def longest_at(self, text: str, at: int) -> int:
        """The longest token that begins at a place; the automaton reads no further than a token can reach."""
        return next(self.automaton.iter_long(text[at : at + self.reach]))[1]

    def piece(self, data: bytes) -> list[int]:
        """Ids of a piece."""
        text, at, out = data.decode("latin-1"), 0, []
        given_up = bytearray(len(data) + 1)
        token = self.longest_at(text, 0) if data else -1
        while at < len(data):
            while token >= 0 and (given_up[at + self.length[token]] or out and not self.pair_fits(out[-1], token)):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += self.length[token]
                token = self.longest_at(text, at) if at < len(data) else -1
            else:  # the text up to here has no other encoding than out, so no encoding of the whole has a border here
                given_up[at] = 1
                token = out.pop()
                at -= self.length[token]
        return out

    def pieces(self, text: str, window: int = WINDOW) -> Iterator[list[str]]:
        """Pieces of a text, some at a time; the last two of a window may depend on what follows."""
        at, n = 0, len(text)
        while at < n:
            stop = min(n, at + window)
            found = self.pattern.findall(text, at, stop)
            while stop < n and len(found) < 3:
                stop = min(n, 2 * stop - at)
                found = self.pattern.findall(text, at, stop)
            if stop < n:
                found = found[:-2]
            yield found
            at += sum(map(len, found))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; added tokens in it are taken as such."""
        parts = self.apart.split(text) if self.apart and self.apart.search(text) else [text]
        held, added = self.held.__getitem__, self.added
        return b"".join(added[p] if p in added else b"".join(b"".join(map(held, found)) for found in self.pieces(p)) for p in parts)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, ids of no token nothing."""
        numbers, read, out = np.frombuffer(ids, "<u4"), codecs.getincrementaldecoder("utf-8")("replace"), []
        for at in range(0, len(numbers), BLOCK_IDS):
            own = numbers[at : at + BLOCK_IDS].astype(np.int64)
            own = own[own < len(self.offset) - 1]
            size = self.offset[own + 1] - self.offset[own]
            stop = np.cumsum(size)
            spots = np.repeat(self.offset[own] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)
            out.append(read.decode(self.letters[spots].tobytes()))
        return "".join(out) + read.decode(b"", True)


_HELD: dict[str, BytePairs] = {}


def byte_pairs(path: str) -> BytePairs:
    """The worker's tables of a vocabulary file; workers are used again for later tasks."""
    if path not in _HELD:
        _HELD[path] = BytePairs(path)
    return _HELD[path]


def _mapped(df: DataFrame, column: str, made: T.StructField, path: str, call: str, empty, out_bytes: int = 8 << 20) -> DataFrame:
    """df with column replaced by `made`, which BytePairs.call makes of each value (null: empty), some MB a batch."""
    others = [c for c in df.columns if c != column]
    rest = df.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(column))
    schema = T.StructType([rest.schema["row"], made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = getattr(byte_pairs(path), call)
        for batch in batches:
            at, held, size = 0, [], 0
            for i in range(batch.num_rows):
                value = batch.column(1)[i].as_py()
                held.append(make(empty if value is None else value))
                size += len(held[-1])
                if size >= out_bytes or i == batch.num_rows - 1:
                    kind = pa.binary() if isinstance(made.dataType, T.BinaryType) else pa.string()
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), pa.array(held, kind)], names=["row", made.name])
                    at, held, size = i + 1, [], 0

    told = rest.mapInArrow(run, schema)
    return told.select(*[F.col("row").getField(c).alias(c) for c in others], F.col(made.name))


def encode_texts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs with `text` replaced by `ids`: the ids of every whole text as the tokenizers library gives them without
    special tokens of its own, truncation or padding; binary, little-endian unsigned 32-bit integers.

    A null text counts as empty and has no ids. The string of an added token in a text is that token. Rows stand for
    themselves, repeated ones too; an empty table stays empty; other columns go along, one named ids is replaced.
    Texts of any length are cut into pieces a window at a time. tokenizer: path of a tokenizers JSON file (byte-level BPE),
    present on every worker.
    """
    named = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "ids")], F.col("text").cast("string").alias("text"))
    return _mapped(named, "text", T.StructField("ids", T.BinaryType()), tokenizer, "encode", "")


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """encoded with a column `text` made of `ids`, special tokens included; undoes encode_texts. Null ids give an empty
    text, ids outside the vocabulary nothing, bytes that are no UTF-8 U+FFFD; a column named text is replaced."""
    named = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c not in ("text", "ids")], F.col("ids"), F.col("ids").alias("text"))
    return _mapped(named, "text", T.StructField("text", T.StringType()), tokenizer, "decode", b"")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, sha256 of the ids and of the text decoded from them; cases as in encode_texts."""
    told = decode_ids(encode_texts(docs.select("doc_id", "text"), tokenizer), tokenizer)
    return told.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
