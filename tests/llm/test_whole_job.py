"""Cases in which operators once did less than the whole job."""

import math
import random
from collections import Counter

import corpus_pipeline
import pytest

from docfields.llm import decontamination, importance, jaccard_join, language_id, ngram_lm
from tests.llm import brute


def test_base_score_is_add_one_smoothed(spark):
    """Shares of N + V + 1: those of the V words and of one unseen sum to 1."""
    train = next(i for i in range(100) if not brute.fold(i, 7, 2))
    held = next(i for i in range(100) if brute.fold(i, 7, 2))
    rows = spark.createDataFrame([(train, "a a b"), (held, "c"), (held, "b a"), (held, "")], "doc_id long, text string")
    got = ngram_lm.score_texts(rows).collect()
    n, v = 4, 3
    want = [(2, 2, 1, 1), (0, 1), (1, 2, 1), (1,)]
    assert sorted(round(r.base_score, 9) for r in got) == sorted(round(sum(math.log10((c + 1) / (n + v + 1)) for c in cs), 9) for cs in want)


@pytest.mark.parametrize("sub_block", [1500, 3])
def test_every_link_counts(spark, monkeypatch, sub_block):
    """A group whose texts all link, chains of links, copies, and rows without an id."""
    monkeypatch.setattr(jaccard_join, "SUB_BLOCK", sub_block)
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(100)]
    texts = [" ".join([*base[:-1], f"end{i}"]) for i in range(12)]
    texts += [" ".join(base[4 * i :] + base[: 4 * i]) for i in range(10)]
    texts += [" ".join(base[: 60 + 5 * i]) for i in range(9)] + [texts[0], texts[0], texts[15], "one two", "One two", "a", None, "", " "]
    rows = [(None if i % 9 == 5 else i, t) for i, t in enumerate(texts)]
    sets = [brute.shingles(t) for _, t in rows]
    near = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)
    links = [sum(near(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    want = [(d, n, c if c is not None else d, m) for (d, n, c), m in zip(brute.components(rows), links, strict=True)]
    got = jaccard_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(links) > 2 * len(rows)


def test_near_duplicates_by_row(spark):
    """Ids that repeat with other texts, and copies without ids."""
    rng = random.Random(6)
    a, b, t, u, v = (" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60)) for _ in range(5))
    rows = [(3, a), (5, a), (5, b), (7, t), (7, t + " more"), (None, u), (None, u), (None, v), (9, v), (None, None), (None, None), (8, ""), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    seven = [r for r in got if r[0] == 7]
    assert len(seven) == 1 and seven[0][1] in (t, t + " more")
    assert sorted(map(str, got)) == sorted(map(str, [(3, a), (5, b), *seven, (None, u), (9, v), (None, None), (None, None), (8, "")]))


def test_near_duplicates_by_a_total_order(spark):
    """Of rows equal in id and text the one whose other columns come first as JSON stays, however rows are dealt."""
    rows = [(1, "a b c d e f", "fr", "web"), (1, "a b c d e f", "de", "web"), (1, "a b c d e f", "de", "news"), (2, "x y z u v w", None, "web"), (2, "x y z u v w", "en", None)]
    for n in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(n)
        got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, "").collect()))
        assert got == [(1, "a b c d e f", "de", "news"), (2, "x y z u v w", "en", None)]


def test_short_and_nameless_items(spark):
    docs = spark.createDataFrame([(1, "so: What is A+B? yes"), (2, "what is a c"), (3, "somewhat is a b"), (4, "It held the nameless item of this benchmark."), (5, None), (6, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "What is a b?"), (None, "the nameless item of this benchmark"), (8, ""), (9, "?"), (None, None)], "item_id long, text string")
    assert [tuple(r) for r in decontamination.contaminated(docs, items).collect()] == [(1, 7, 0)]
    assert sorted(r.doc_id for r in decontamination.decontaminated(docs, items).collect()) == [2, 3, 5, 6]


def test_language_of_single_letters(spark):
    rows = [(i, t, k) for i in range(40) for t, k in [("a thing i had", "en"), ("y la casa o", "es")]]
    rows += [(None, "A.", None), (None, "y, O!", None), (None, "7 !", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language_id.train(docs.select("lang", "text"))
    assert [(p, n) for p, s, n in language_id.predict(filters, ["A.", "y, O!", "7 !"]) if s > 0.9 or not n] == [("en", 1), ("es", 2), ("und", 0)]
    assert all(len(language_id.grams(f" {c} ".encode())) for c in "azé")


def test_scores_of_the_language_model(spark):
    """Both ways of probing give one score; it is that of quantised counts, but for the filter's false positives."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary[: 5 + i % 56]) for _ in range(rng.randint(0, 60)))) for i in range(120)] + [(None, None), (3, "w1 unseen w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wide, narrow = (sorted(map(tuple, ngram_lm.score_texts(docs, broadcast_bytes=b).collect()), key=str) for b in (1 << 26, 0))
    assert wide == narrow

    texts = [[0, *brute.words(t, True), 1] for _, t in rows]
    train = [x for (d, _), x in zip(rows, texts, strict=True) if not brute.fold(d, 7, 2)]
    ones, twos = Counter(w for x in train for w in x), Counter(p for x in train for p in zip(x, x[1:], strict=False))
    n, v = sum(ones.values()) - ones[0], len(ones) - 1
    mass = min(0.95, max(0.05, 1 - sum(c == 1 for c in twos.values()) / sum(twos.values())))
    edges = [math.ceil(1.5**k - 1e-9) for k in range(40)]
    mean = lambda c: next((edges[k] + max(edges[k + 1] - 1, edges[k])) / 2 for k in range(39) if c < 1.5 ** (k + 1) - 1e-9) if c else 0.0

    def score(x):
        total = 0.0
        for a, b in zip(x, x[1:], strict=False):
            low = (mean(ones[b]) + 1) / (n + v + 1)
            total += math.log10(mass * min(mean(twos[a, b]), mean(ones[a])) / mean(ones[a]) + (1 - mass) * low if ones[a] else low)
        return total

    got = {(r[0], r[2], round(r[5], 6)): r[6] for r in wide}
    off = []
    for (d, _), x in zip(rows, texts, strict=True):
        base = round(sum(math.log10((ones[w] + 1) / (n + v + 1)) for w in x[1:]), 6)
        off.append(abs(got[d, len(x) - 1, base] - score(x)) / (1 + abs(score(x))))
    assert sum(off) / len(off) < 0.01 and max(off) < 0.1


def test_languages_by_exact_sets(spark):
    """Predictions with exact sets of n-grams in the filters' place; very long texts, ties, repeated rows, other columns."""
    rng = random.Random(13)
    of = {"aa": ["ba", "bab", "abba"], "bb": ["cede", "edec", "dec"], "cc": ["fog", "gof", "ogof"]}
    rows = [(i, " ".join(rng.choice(of[k]) for _ in range(30)), k) for i in range(90) for k in [list(of)[i % 3]]]
    texts = [" ".join(rng.choice(of[k]) for _ in range(50_000)) for k in of] + ["zzz", "bab cede", "É", rows[0][1], rows[0][1], "fog 1 gof"]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, gram string, langs string")
    filters = language_id.train(docs.select("lang", "text"))
    whole = lambda t: [bytes(g) for w in "".join(c if c.isalpha() else " " for c in t.lower()).encode().split() for n in (3, 4) for p in [b" " + w + b" "] for g in (p[i : i + n] for i in range(len(p) - n + 1))]
    counts = {k: Counter(g for _, t, lang in rows if lang == k for g in whole(t)) for k in of}
    rate = lambda g, k: counts[k][g] / sum(counts[k].values())
    has = {k: {g for g in counts[k] if rate(g, k) >= 2e-6 and rate(g, k) >= 0.5 * max(rate(g, o) for o in of)} for k in of}
    for text, (lang, share, n) in zip(texts, language_id.predict(filters, texts), strict=True):
        found = whole(text)
        shares = {k: sum(g in has[k] for g in found) / max(1, len(found)) for k in of}
        assert n == len(found) and abs(share - max(shares.values())) < 0.02
        assert lang == max(sorted(of), key=lambda k: shares[k]) or share < 0.02
    got = language_id.held_out_languages(docs)
    assert got.count() == len(rows) and got.columns == ["doc_id", "held_out", "lang_pred", "score", "n_grams"]


def test_matches_against_every_distance(spark):
    """Documents x items by full edit distance; a common piece many times in a long text, repeated items."""
    rng = random.Random(14)
    words = [f"{rng.choice('abc')}{rng.choice('de')}{rng.choice('fg')}" for _ in range(8)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, make(12)) for i in range(6)] + [(7, "Same as before, same as ever, once again."), (7, "Same as before, same as ever, once again."), (8, "tiny")]
    spoil = lambda t, k: "".join(c if rng.random() > k else rng.choice("abcdefg") for c in t)
    texts = [f"{make(rng.randint(0, 20))} {spoil(rng.choice(items[:6])[1], 0.08)} {make(rng.randint(0, 20))}" for _ in range(40)]
    texts += [(words[0] + " ") * 3000 + items[0][1], items[7][1].upper(), "a tiny one", "atiny", None, ""]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, m string, item_id int")
    got = sorted(map(tuple, decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()))
    plain = lambda t: f" {' '.join(''.join(c if c.isalnum() else ' ' for c in (t or '').lower()).split())} "
    want = []
    for i, t in enumerate(texts):
        for k, item in items:
            p = plain(item)
            edits = int(0.08 * (len(p) - 2))
            d = 0 if p in plain(t) else brute.distance(p, plain(t)) if edits and len(t or "") < 5000 else 99
            if d <= edits:
                want.append((i, k, d))
    assert got == sorted(want) and {d for _, _, d in want} >= {0, 1, 2}


def test_short_items_may_have_their_share_of_edits(spark):
    """Items of 12, 13 and 24 characters: floor(0.08 m) edits at every length."""
    docs = spark.createDataFrame([(1, "say abcd efgh ijk now"), (2, "say abcd efgh xjk now"), (3, "say abcd efgh ijkl now"), (4, "say abcd xfgh ijkl now"), (5, "one abcd efgh ijkl mnop qrsx two")], "doc_id long, text string")
    items = spark.createDataFrame([(12, "abcd efgh ij"), (13, "abcd efgh ijk"), (24, "abcd efgh ijkl mnop qrst")], "item_id long, text string")
    assert sorted(map(tuple, decontamination.contaminated(docs, items).collect())) == [(1, 13, 0), (2, 13, 1), (3, 13, 1), (5, 13, 1), (5, 24, 1)]


def test_weights_of_importance(spark):
    """Log ratios by word and pair with the operator's buckets, and Gumbel keys; ties of the last key."""
    rows = [(i, t) for i, t in enumerate(["good text here", "good words", "bad bad text", "", None, "bad words here", "good good"])] + [(0, "good text here")]
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    buckets = 1 << 12

    def bins(text):
        return [b for found, _ in importance.features([(text or "").encode()], buckets) for b in found.tolist()]

    raw, target = Counter(b for _, t in rows for b in bins(t)), Counter(b for d, t in rows if d in (0, 1) for b in bins(t))
    ratio = lambda b: math.log((target[b] + 1) / (sum(target.values()) + buckets)) - math.log((raw[b] + 1) / (sum(raw.values()) + buckets))
    got = importance.importance_sample(docs, labels, share=1.0, buckets=buckets).collect()
    want = Counter((d, round(sum(map(ratio, bins(t))), 8)) for d, t in rows)
    assert Counter((r.doc_id, round(r.log_weight, 8)) for r in got) == want
    noise = {}
    for r in got:
        noise.setdefault(r.doc_id, set()).add(round(r.key - r.log_weight, 8))
    assert all(len(x) == 1 for x in noise.values()) and len({min(x) for x in noise.values()}) == len(noise)
    keys = sorted((r.key for r in got), reverse=True)
    for share in (0.25, 0.5):
        last = keys[round(share * len(rows)) - 1]
        assert sorted(r.key for r in importance.importance_sample(docs, labels, share=share, buckets=buckets).collect()) == sorted(k for k in keys if k >= last)
