"""The draw by importance against a plain version of its contract."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from docfields.llm import queries, target_resampling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall((text or "").translate(LOW))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def noise(doc_id):
    h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def plain(docs, target):
    """(doc_id, n_features, weight, score, rank) of each of (doc_id, text)."""
    told = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in told for b in f), Counter(b for text in target for b in features(text)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in s}
    rows = [(i, n, len(f), w := sum(gain[b] for b in f), w + noise(i)) for i, n, f in told]
    order = sorted((k for k, r in enumerate(rows) if r[1] >= 20), key=lambda k: (-rows[k][4], rows[k][0] is None, rows[k][0] or 0, *rows[k][2:4]))
    rank = {k: r for r, k in enumerate(order[: 5 * len(order) // 100], 1)}
    return sorted(map(str, ((i, f, w, score, rank.get(k)) for k, (i, _, f, w, score) in enumerate(rows))))


@pytest.mark.parametrize("size", [target_resampling.SLICE, 300])
def test_against_plain(spark, size):
    """Null, blank and very long texts, letters beyond ASCII, a very long word, repeated rows and ids, null ids, ties."""
    rng = random.Random(8)
    vocabulary = ["a", "B", "ça", "日本", "x1", "9", "Σ", "😀", "the", "THE"] + [f"w{i}" for i in range(40)]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", ", ", "-", "\x7f", "_", " "]) for _ in range(n))
    rows = [(i, text(rng.randrange(60))) for i in range(300)] + [(3, text(30)), (None, text(25)), (None, None), (300, None), (301, ""), (302, " .,\t")]
    rows += [(303, text(20_000)), (304, "y" * 50_000), (305, "Ab-aB_ab" * 30)] + [(306, "one two three " * 10)] * 50
    docs = spark.createDataFrame([(i, t, "other") for i, t in rows], "doc_id long, text string, row string").repartition(3)
    target = ["the w1 w2 the w1", "ça 日本 x1", None, ""]
    got = target_resampling.resample(docs, spark.createDataFrame([(1, t) for t in target], "n_words int, text string"), size=size).collect()
    assert sorted(str((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in got) == plain(rows, target)
    assert max(r["rank"] or 0 for r in got) > 10


def test_drawn_rows_and_empty_tables(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(25)), f"s{i}", i, None) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, score long, rank int")
    target = spark.createDataFrame([("a b c",)], "text string")
    got = target_resampling.resampled(docs, target)
    ranked = {r.doc_id for r in target_resampling.resample(docs, target).where("rank IS NOT NULL").collect()}
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[0] in ranked) and len(ranked) == 5
    assert target_resampling.resample(docs.limit(0), target).collect() == []
    level = target_resampling.resample(docs.limit(20), target.limit(0)).collect()
    assert len(level) == 20 and all(r.n_features == 72 for r in level)


def test_query_over_whole_table(spark):
    at = "/root/testdata/sf0.001"
    read = lambda n: spark.read.parquet(f"{at}/{n}.parquet").collect()
    got = queries.op13_resampling(spark, at)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(str(tuple(r)) for r in got.collect()) == plain([(r.doc_id, r.text) for r in read("documents")], [r.text for r in read("benchmark")])
