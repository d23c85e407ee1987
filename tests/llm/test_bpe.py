"""The backtracking encoder and the decoder against the tokenizers library."""

import hashlib
import random
import time

import numpy as np
import pytest
from tokenizers import Tokenizer

from docfields.llm import bpe, queries


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(queries.tokenizer_path())
    own.no_truncation()
    own.no_padding()
    return own


def ids_of(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_random_texts(library):
    own, rng = bpe.byte_pairs(queries.tokenizer_path()), random.Random(1)
    bits = ["a", "b", "e", " ", "  ", "\n", "the", "ing", "'re", "'s", "'ll", "1", "23", "\t", "<|endoftext|>", "<|end", "é", "xx", "==", " ", "日本", "😀", "'", "r", "\x85", " ", "\x00"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        ids = ids_of(library, text)
        assert own.encode(text) == ids, repr(text)
        assert own.decode(ids) == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False) == text
    for _ in range(4000):
        text = "".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(1, 60)))
        assert own.encode(text) == ids_of(library, text), text


def test_windows_of_a_text_give_the_same_pieces():
    own, rng = bpe.byte_pairs(queries.tokenizer_path()), random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["ab", " ", "  ", "'re", "'", "r", "1", "\n", ".", "é"]) for _ in range(60))
        whole = own.pattern.findall(text)
        assert [p for found in own.pieces(text, rng.randrange(1, 12)) for p in found] == whole


def test_time_is_linear_in_a_piece(library):
    """Pieces of a text without any border, as long as the text."""
    own = bpe.byte_pairs(queries.tokenizer_path())
    for unit in ("x", "ab", "é", " ", "\n", "abcabd", "<|endoftext|"):
        texts = [unit * (n // len(unit)) for n in (20_000, 160_000)]
        took = []
        for text in texts:
            began = time.process_time()
            assert own.encode(text) == ids_of(library, text)
            took.append(time.process_time() - began)
        assert took[1] < 20 * max(took[0], 0.05)


def test_bad_ids_and_files(tmp_path):
    own = bpe.byte_pairs(queries.tokenizer_path())
    assert own.decode(np.array([10**6, 4_000_000_000], "<u4").tobytes()) == ""
    half = own.encode("é")
    assert own.decode(np.array([b for b in range(256) if own.letters[own.offset[b]] == 0xC3][:1], "<u4").tobytes()) == "�" and own.decode(half) == "é"
    (tmp_path / "other.json").write_text('{"model": {"type": "BPE", "vocab": {}, "merges": []}, "normalizer": {"type": "NFC"}, "pre_tokenizer": {"type": "ByteLevel"}}')
    with pytest.raises(ValueError, match="plain byte-level"):
        bpe.BytePairs(str(tmp_path / "other.json"))


def test_documents(spark, library):
    """Null and empty texts, a very long one, repeated rows, clashing columns, an empty table."""
    texts = [None, "", " ", "Hello, world's end", "Hello, world's end", "z" * 300_000 + " a b c" * 50_000, "\x00\n"]
    docs = spark.createDataFrame([(i if i else None, t, b"old", "r", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids binary, row string, made int").repartition(2)
    encoded = bpe.encode_texts(docs, queries.tokenizer_path())
    assert sorted(encoded.columns) == sorted(docs.drop("text").columns)
    got = {r.doc_id: r for r in encoded.collect()}
    assert all(bytes(got[i or None].ids) == ids_of(library, t or "") and got[i or None].row == "r" for i, t in enumerate(texts))
    back = {r.doc_id: r.text for r in bpe.decode_ids(encoded, queries.tokenizer_path()).collect()}
    assert back == {i or None: t or "" for i, t in enumerate(texts)}
    assert bpe.round_trip(docs.limit(0), queries.tokenizer_path()).collect() == []


def test_query_over_whole_table(spark, library):
    at = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{at}/documents.parquet").collect():
        ids = ids_of(library, r.text or "")
        back = library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        want.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = queries.op11_bpe(spark, at)
    assert dict(got.dtypes)["n_tokens"] == "bigint" and sorted(map(tuple, got.collect())) == sorted(want)
