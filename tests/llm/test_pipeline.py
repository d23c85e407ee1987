"""Every stage of the pipeline on its own input, against plain versions."""

import random
from collections import Counter

import corpus_pipeline
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    of = {"en": ["the", "of", "thing", "with", "hers", "when"], "fr": ["les", "eau", "être", "queue", "pour", "leur"]}
    make = lambda k, n: " ".join(rng.choice(of[k]) + rng.choice("abcde") for _ in range(n))
    item = make("en", 14)
    rows = [(i, make(k, 40 + i), k, f"s{i % 4}", 0) for i in range(60) for k in [("en", "fr")[i % 2]]]
    rows += [(100 + i, rows[i][1], rows[i][2], "s1", 0) for i in range(6)]
    rows += [(200 + i, rows[i][1] + " more", rows[i][2], None, 0) for i in range(3)]
    rows += [(300, f"{make('en', 30)} {item.upper()} {make('en', 30)}", "en", "s2", 0), (301, None, "en", "s1", 0), (302, "12 34 !", "fr", "s1", 0), (303, "", None, "s1", 0)]
    rows += [rows[5]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = [tuple(r) for r in docs.collect()]
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "tokens":
            assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert Counter(seen["near_duplicates"]) == Counter(r for r in rows if r[1] and any(map(str.isalpha, r[1])))
    groups = brute.components([r[:2] for r in seen["near_duplicates"]])
    assert Counter(r[0] for r in seen["decontaminate"]) == Counter({d for d, _, c in groups if d == c})
    assert {r[0] for r in seen["decontaminate"]} - {r[0] for r in seen["mix"]} == {300}
    sizes, words = Counter(), Counter()
    for r in seen["mix"]:
        sizes[r[3]] += len(brute.words(r[1]))
    for r in seen["tokens"]:
        words[r[3]] += len(brute.words(r[1]))
    longest = max(len(brute.words(r[1])) for r in seen["mix"])
    for source, target in brute.targets(sizes).items():
        assert abs(words[source] - target) <= 20 + longest
    assert max(Counter(seen["tokens"]).values()) <= 3
    out = sorted(map(tuple, docs.collect()), key=lambda r: r[1])
    assert [r[0] for r in out] == sorted(r[0] for r in seen["tokens"])
    assert all(a[1] + a[2] == b[1] for a, b in zip(out, out[1:], strict=False))


def test_run_against_a_plain_version(spark, tmp_path):
    """run() over a corpus with null and repeated ids, a very long text, ties and columns with the stages' own names."""
    import zlib

    import tokenizers

    from docfields.llm.queries import tokenizer_path

    rng = random.Random(21)
    of = {"en": ["the", "of", "thing", "with", "hers", "when"], "fr": ["les", "eau", "être", "queue", "pour", "leur"]}
    make = lambda k, n: " ".join(rng.choice(of[k]) + rng.choice("abcde") for _ in range(n))
    item, copy = make("en", 14), make("fr", 70)
    rows = [(i, make(k, 40 + i), k, f"s{i % 3}") for i in range(40) for k in [("en", "fr")[i % 2]]]
    rows += [(50 + i, copy, "fr", "s0") for i in range(5)] + [(50, make("en", 44), "en", "s1"), (60, make("en", 30_000), "en", "s2")]
    rows += [(70, f"{make('en', 30)} {item.upper()} {make('en', 30)}", "en", "s2"), (71, None, "en", "s1"), (72, "12 34 !", "fr", "s1"), (None, make("en", 61), "en", None), (None, copy, None, "s1")]
    names = ["doc_id", "text", "lang", "source", "row", "told", "t", "d", "x", "h", "root", "__language", "_copy", "size", "taken"]
    kinds = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in names[4:])
    docs = spark.createDataFrame([(*r, *names[4:]) for r in rows], kinds)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=lambda r: r[1])

    kept = [r for r in rows if r[1] and any(map(str.isalpha, r[1])) and item not in r[1].lower() and (r[1] != copy or r[0] == 50)]
    tokenizer = tokenizers.Tokenizer.from_file(tokenizer_path())
    coded = {}
    for d, text, _, source in kept:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        coded[d, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))] = source, len(brute.words(text))
    assert len(coded) == len(kept)
    copies = Counter((r[0], r[2], r[3]) for r in got)
    assert set(copies) <= set(coded) and max(copies.values()) <= 3
    assert [r[0] for r in got] == sorted((r[0] for r in got), key=lambda d: (d is not None, d or 0))
    assert [r[1] for r in got] == [sum(r[2] for r in got[:i]) for i in range(len(got))]
    sizes, taken = Counter(), Counter()
    for k, (source, n) in coded.items():
        sizes[source] += n
        taken[source] += n * copies[k]
    longest = {s: max(n for source, n in coded.values() if source == s) for s in sizes}
    for source, target in brute.targets(sizes).items():
        assert abs(taken[source] - target) <= 20 + longest[source]
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, str(tmp_path)).columns == names, name
        assert not stage(spark, docs.where("false"), str(tmp_path)).count(), name
