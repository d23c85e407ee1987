"""Suffix-array dedup of texts that repeat themselves, and of long ones, against all windows."""

import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
import zstandard

from docfields.llm import kernel, suffix_dedup
from tests.llm import brute


def whole_job(rows, n_chunks=2, n_tasks=3):
    """(rows of the result, bytes that were cut out), all steps in this process."""
    own = [rows[c::n_chunks] for c in range(n_chunks)]
    tables = [pa.table({"doc_id": pa.array([i for i, _ in r], pa.int64()), "text": pa.array([t for _, t in r], pa.string()), "chunk": pa.array([c] * len(r), pa.int32())}) for c, r in enumerate(own)]
    of = lambda table, name, value: table.filter(pc.equal(table[name], value))
    answers = suffix_dedup._answer(pa.concat_tables([suffix_dedup._asker(1, 200, 400)(t) for t in tables]))
    cut = suffix_dedup._cutter(1, n_tasks, 200, 400)
    parts = pa.concat_tables([cut(t, of(answers, "chunk", c)) for c, t in enumerate(tables)])
    tasks = sorted(set(parts["task"].to_pylist()))
    found = pa.concat_tables([suffix_dedup.found_table([]), *[suffix_dedup._finder(n_tasks, 200, 400)(of(parts, "task", k)) for k in tasks]])
    hashes = found.filter(pc.is_valid(found["hashes"]))
    between = [suffix_dedup._matcher(400)(of(hashes, "bucket", b)) for b in sorted(set(hashes["bucket"].to_pylist()))]
    spans = pa.concat_tables([found.filter(pc.is_valid(found["spans"])).select(["chunk", "spans"]), *between])
    out = []
    for c, t in enumerate(tables):
        told = suffix_dedup._remover(200, 400)(t, of(spans, "chunk", c))
        out += list(zip(*[told[x].to_pylist() for x in told.column_names], strict=True))
    return out, sum(len(zstandard.decompress(d)) for d in parts["data"].to_pylist())


@pytest.mark.parametrize("size", [700, 1 << 20])
def test_periods_against_all_windows(monkeypatch, size):
    """Periods from 1 to 150 bytes, runs just under and over a window, copies, and texts longer than a part."""
    monkeypatch.setattr(kernel, "SLICE", size)
    monkeypatch.setattr(kernel.slices, "__defaults__", (size,))
    rng = random.Random(size)

    def piece():
        if rng.random() < 0.5:
            unit = "".join(rng.choice("abc ") for _ in range(rng.choice([1, 1, 2, 3, 7, 20, 63, 64, 65, 100, 136, 137, 150])))
            return (unit * 3000)[: rng.choice([100, 199, 200, 263, 399, 400, 401, 402, 407, 420, 464, 500, 800, 1500, 3000])]
        return "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([3, 50, 300, 900])))

    for _ in range(12):
        rows = [(i, "".join(piece() for _ in range(rng.randrange(1, 5)))) for i in range(8)]
        rows += [(100, rows[0][1]), (101, rows[1][1][5:]), (102, rows[2][1][:-3] + "zz"), (None, None), (None, "")]
        key = lambda r: str(r)
        assert sorted((r[:5] for r in whole_job(rows)[0]), key=key) == sorted(brute.repeats(rows), key=key)


@pytest.mark.parametrize("unit", ["x", "abc def", "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eius tempor incid "])
def test_long_periodic_texts_stay_small(unit):
    """What is cut out of a text that is all one period is a small part of it, and no step sees more than a part of it."""
    text = (unit * (6_000_000 // len(unit) + 1))[:6_000_000]
    got, cut = whole_job([(1, text)], n_chunks=1)
    assert got[0][:4] == (1, len(text), len(text), 1) and cut < len(text) / 5
    table = pa.table({"doc_id": pa.array([1], pa.int64()), "text": pa.array([text])})
    assert max(len(run[0]) for run in suffix_dedup.Chunk(table, 200, 400).runs()) < 2 * kernel.SLICE


def test_long_texts_that_share_a_passage():
    """A passage across the border of two parts of a long text, and its copy in another."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    long = " ".join(word() for _ in range(400_000))
    at = kernel.SLICE - 700
    other = " ".join(word() for _ in range(200)) + long[at : at + 1500] + " ".join(word() for _ in range(200))
    got = {r[0]: r for r in whole_job([(1, long), (2, other)])[0]}
    assert got[1][2] == got[2][2] >= 1500 and got[1][3] == got[2][3] == 1


def test_words_are_those_of_split():
    for text in (b"", b" ", b"a", b" a b\t\nc ", b"\x0b\x0cx", "é à".encode()):
        assert suffix_dedup.n_words(text) == len(text.split())
