"""The corpus operators against plain versions, with nulls, empty and long texts, ties, repeats, other columns."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfields.llm import decontamination, importance, jaccard_join, kernel, language_id, mixing, ngram_lm, quality_rules, suffix_dedup, token_planes, warc
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, size long, chunk string, row int"


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgéñ") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = make(120), make(110)
    texts = [make(rng.randint(1, 200)) for _ in range(25)]
    texts += [base, base, base + " tail", " ".join(["Other", *base.split()[1:]]), base.upper()]
    texts += [f"{make(60)} {passage} {make(30)}" for _ in range(4)] + [passage]
    texts += [None, None, "", "   \n\t ", "one", "one", "One", "two words", "###", "a\nb\nb\n\nb", "x" * 1500, "it's 12's ½ <|endoftext|> 日本", make(8000)]
    rows = [(i, t, ("en", "fr", None)[i % 3], (None, "s1", "s2", "é")[i % 4], 1, "c", 2) for i, t in enumerate(texts)]
    rows += [rows[3], rows[26], (None, base, None, None, 1, "c", 2), (None, None, None, None, 1, "c", 2)]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by(rows):
    return sorted(map(tuple, rows), key=str)


def test_mixing(docs, empty):
    got = mixing.mix_sources(docs).collect()
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len(brute.words(r[1]))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(brute.words(r[1]))) for r in ROWS)
    taken, want = Counter(), brute.targets(sizes)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
    for s, t in want.items():
        assert abs(taken[s] - t) <= 40
    assert by(got) == by(mixing.mix_sources(docs.repartition(5)).collect())
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_sainte_lague(spark):
    rng = random.Random(2)
    for n in (1, 2, 7, 30):
        ideals = [rng.uniform(0, 40) for _ in range(n)]
        caps, total = [10_000] * n, int(sum(ideals))
        rows = [(i, v, c, total) for i, (v, c) in enumerate(zip(ideals, caps, strict=True))]
        got = mixing.sainte_lague(spark.createDataFrame(rows, "k int, ideal double, cap long, total long"), [], ["k"])
        assert [r.seats for r in got.orderBy("k").collect()] == brute.sainte_lague(ideals, caps, total)


def test_warc(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "u", big), (5, None, big), (5, "v", big), (3, "a b\n", "small"), (4, "u", "small"), (6, "u", None), (None, "u", big), (7, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = by(warc.page_records(pages).collect())
    import hashlib

    want = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        again = html == big and page_id != 5
        want.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 5 if again else None))
    assert got == by(want)
    assert warc.page_records(pages.limit(0)).count() == 0
    content = warc.record("response", "urn:page:1", "u", b"abc", hashlib.sha1(b"abc").digest(), 3, None)
    import io

    ((_, plain),) = warc.members(io.BytesIO(content), 7)
    assert warc.examine(plain)["problem"] is None
    assert warc.examine(plain.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))["problem"] == "block digest"
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(content[:-9])))


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_language_model(docs, empty, limit):
    counts, tokens = Counter(), []
    for r in ROWS:
        own = [*brute.words(r[1], True), "\n"]
        tokens.append((r[0], brute.fold(r[0], 7, 2), own))
        if not tokens[-1][1]:
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    want = [(d, h, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in t), 4)) for d, h, t in tokens]
    got = ngram_lm.score_texts(docs, broadcast_bytes=limit).collect()
    assert by((*r[:5], round(r.base_score, 4)) for r in got) == by(want)
    assert all(r.score <= 0 for r in got)
    assert ngram_lm.score_texts(empty).count() == 0


def test_filter_levels():
    counts = np.arange(1, 300)
    grams = kernel.mix(np.arange(1, 300, dtype=np.uint64))
    levels = ngram_lm.level_of(counts)
    found = ngram_lm.Segment.build(grams, levels).probe(grams)
    assert (found >= levels).all() and (found == levels).mean() > 0.9
    assert (ngram_lm.Segment.build(grams, levels).probe(kernel.mix(np.arange(10_000, 20_000, dtype=np.uint64))) > 0).mean() < 0.08


def test_language_id(spark, empty):
    rng = random.Random(3)
    of = {"en": ["the", "of", "thing", "with", "hers"], "fr": ["les", "eau", "être", "queue", "pour"], "de": ["und", "schön", "über", "der", "ich"]}
    rows = [(i, " ".join(rng.choice(of[k]) for _ in range(30)), k) for i in range(120) for k in [list(of)[i % 3]]]
    rows += [(500, None, "en"), (501, "123 !?", "fr"), (502, "", None), (None, "the thing of the", None), (3, "x", None)]
    got = language_id.held_out_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    wrong = [r for r in got if r.doc_id is not None and 3 < r.doc_id < 120 and r.lang_pred != list(of)[r.doc_id % 3]]
    assert not wrong and all(0 <= r.score <= 1 and r.held_out == brute.fold(r.doc_id, 4, 2) for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (500, 501, 502)} == {"und"}
    assert language_id.held_out_languages(empty).count() == 0


def test_quality_rules(docs, empty):
    want = []
    for r in ROWS:
        text = r[1] or ""
        w = brute.words(text)
        triples = Counter(zip(w, w[1:], w[2:], strict=False))
        at = {j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if brute.words(x)]
        failed = len(w) < 50 or 100 * len(at) > 50 * len(w)
        want.append((r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(at), failed))
    got = quality_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert by(r[:7] for r in got) == by(want)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.quality_rules(empty).count() == 0


@pytest.mark.parametrize("block", [1024, 2])
def test_suffix_dedup(docs, empty, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    got = suffix_dedup.remove_repeats(docs).collect()
    rows = [(r[0], r[1]) for r in ROWS]
    assert by(got) == by((*r, n) for r, n in zip(brute.repeats(rows), brute.passages(rows), strict=True))
    assert any(r.n_passage_bytes for r in got) and any(r.n_removed and not r.n_passage_bytes for r in got)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_intervals():
    assert sorted(suffix_dedup.intervals([3, 5, 0, 2])) == [(0, 2, 3), (0, 4, 0), (1, 2, 5), (3, 4, 2)]


def test_importance(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (3, 0, 0), (4, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = importance.importance_sample(docs, labels)
    assert got.count() == round(0.6 * len(ROWS))
    every = sorted((r.key for r in importance.importance_sample(docs, labels, share=1.0).collect()), reverse=True)
    assert len(every) == len(ROWS)
    assert sorted((r.key for r in got.collect()), reverse=True) == every[: round(0.6 * len(ROWS))]
    assert importance.importance_sample(empty, labels).count() == 0
    assert importance.importance_sample(docs, labels.limit(0)).count() == len(ROWS)


def test_kth_largest(spark):
    values = [1.5, -2.0, 1.5, 1e300, -1e-300, 0.0, 7.25]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    assert [importance.kth_largest(rows, "x", k) for k in range(1, 8)] == sorted(values, reverse=True)


def test_decontamination(spark, docs):
    rng = random.Random(9)
    for _ in range(100):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 70))) for _ in range(2))
        assert decontamination.Myers(p).best(t) == brute.distance(p, t)
    item = "What, then, is the answer to question number seven of the long list?"
    near = item.replace("seven", "sevem").replace("long", "lang").upper()
    texts = [(1, f"x y {item} z"), (2, f"pre {near} post"), (3, "what then is the answer"), (4, None), (5, ""), (None, item), (1, f"x y {item} z")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    b = spark.createDataFrame([(7, item), (8, "short"), (9, None), (None, item)], "item_id long, text string")
    got = by(decontamination.contaminated(d, b).collect())
    assert got == by([(1, 7, 0), (1, 7, 0), (2, 7, 2), (None, 7, 0)])
    assert by(decontamination.contaminated(d, b, block_chars=1).collect()) == got
    assert sorted(r.doc_id for r in decontamination.decontaminated(d, b).collect()) == [3, 4, 5]
    assert decontamination.contaminated(d, b.limit(0)).count() == 0 and decontamination.decontaminated(docs, b).columns == docs.columns


@pytest.mark.parametrize("bits", [True, False])
def test_planes(bits):
    ids = np.random.default_rng(1).integers(0, 70_000, 1001, dtype=np.uint32)
    assert (token_planes.from_planes(token_planes.to_planes(ids, bits), len(ids), bits) == ids).all()
    assert len(token_planes.from_planes(token_planes.to_planes(ids[:0], bits), 0, bits)) == 0


def test_token_planes(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    files = token_planes.write_tokens(docs, path, file_bytes=20_000, block_ids=1000)
    assert files.count() > 1
    got = sorted(map(tuple, token_planes.read_tokens(files).collect()), key=lambda r: r[1])
    own, start = Tokenizer.from_file(path), 0
    ids_of = lambda t: np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    assert [r[0] for r in got] == sorted((r[0] for r in ROWS), key=lambda d: (d is not None, d))
    crcs = Counter((r[0], len(ids_of(r[1])), zlib.crc32(ids_of(r[1]).tobytes())) for r in ROWS)
    assert Counter((d, n, c) for d, _, n, c in got) == crcs
    for _, at, n, _ in got:
        assert at == start
        start += n
    assert token_planes.read_tokens(token_planes.write_tokens(empty, path)).count() == 0


def test_encoder_pieces():
    import public_tokenizers

    encode = token_planes.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    parts = [*"ab's' tdmlvre\n\t  ..12_éß'", "'ll", "'re", " 's", "\r", "don't", "\xa0", "½", "<|endoftext|>", "\x1c", "日"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    want = [e.ids for e in encode.own.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encode(texts)] == want


@pytest.mark.parametrize("sub_block", [1500, 2])
def test_jaccard_join(docs, empty, monkeypatch, sub_block):
    monkeypatch.setattr(jaccard_join, "SUB_BLOCK", sub_block)
    got = jaccard_join.jaccard_components(docs).collect()
    want = []
    for d, n, c in brute.components([(r[0], r[1]) for r in ROWS]):
        want.append((d, n, c if c is not None else d))
    assert by(got) == by(want)
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_heap_merge():
    rng = np.random.default_rng(5)
    for _ in range(300):
        sets = [np.unique(rng.integers(0, 12, rng.integers(1, 9))).astype(np.uint64) for _ in range(int(rng.integers(1, 15)))]
        index = jaccard_join.InvertedLists(sets)
        length = np.diff(index.begin)
        for least in (1, 2, 3, 6):
            places, counts = index._merged(index.begin[:-1], length, least)
            assert list(zip(places.tolist(), counts.tolist(), strict=True)) == [(i, len(s)) for i, s in enumerate(sets) if len(s) >= least]
