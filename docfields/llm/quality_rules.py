"""Quality rules: a table of thresholds compiled into one Spark projection (native).

Every measure is a built-in expression over the row's own text; the rules are rows
of a table, (measure, lowest, highest), compiled into one boolean column. No shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import LOWER, SPACES, UPPER, WORD, words_of

#: Frequent function words of the languages of the corpus.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "that", "is", "with", "be", "for",
    "le", "la", "les", "et", "des", "un", "une", "est", "que", "pour",
    "der", "die", "das", "und", "ist", "von", "mit", "zu", "den", "ein",
    "el", "los", "las", "y", "de", "en", "se", "por", "con", "no",
)

#: measure, lowest allowed, highest allowed (None: open); words as in the base rule.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 50, None),
    ("mean_word_length", 2.0, 15.0),
    ("symbol_ratio", None, 0.10),
    ("stop_word_ratio", 0.02, None),
    ("duplicate_line_ratio", None, 0.30),
    ("repeat_word_ratio", None, 0.50),
    ("bullet_line_ratio", None, 0.90),
    ("ellipsis_line_ratio", None, 0.30),
)


def verdict(rules: Iterable[tuple[str, float | None, float | None]]) -> Column:
    """The rules as one column: true where every measure lies within its bounds."""
    out = F.lit(True)
    for measure, low, high in rules:
        if low is not None:
            out = out & (F.col(measure) >= F.lit(low))
        if high is not None:
            out = out & (F.col(measure) <= F.lit(high))
    return out


def quality_measures(docs: DataFrame) -> DataFrame:
    """doc_id and all measures of the row's whole text.

    Null and empty texts have no words, no lines and ratios of 0; each row, repeated or
    with a null doc_id, is measured by itself; an empty table gives an empty result; other
    columns are not looked at. Words repeated in windows are found by sorting the row's
    64-bit window hashes with their places, so a long text costs n log n.
    """
    x = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("body"))
    x = x.select(
        "doc_id",
        words_of(F.col("body")).alias("words"),
        F.length(F.translate("body", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("body", "\n"), lambda s: s.rlike(WORD)).alias("lines"),
    )
    # one row in, one row out; the generator keeps the arrays above from being worked out again in every use below
    x = x.select("doc_id", F.explode(F.array(F.struct("words", "word_chars", "n_symbols", "lines"))).alias("m")).select("doc_id", "m.*")
    n = F.size("words").cast("long")
    windows = F.zip_with(
        F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        F.slice("words", 3, F.greatest(F.size("words"), F.lit(1))),
        lambda ab, c: F.when(c.isNotNull(), F.xxhash64(ab["a"], ab["b"], c)),
    )
    placed = F.sort_array(F.filter(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda s: s["h"].isNotNull()))
    stopped = F.size(F.filter(F.transform("words", lambda w: F.translate(w, UPPER, LOWER)), lambda w: w.isin(*STOP_WORDS))).cast("long")
    bullets = F.size(F.filter("lines", lambda s: s.rlike(r"^\s*[-*•]"))).cast("long")
    dots = F.size(F.filter("lines", lambda s: s.rlike("(?:\\.\\.\\.|…)\\s*$"))).cast("long")
    x = x.select(
        "doc_id", n.alias("n_words"), "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        stopped.alias("n_stop_words"), bullets.alias("n_bullets"), dots.alias("n_ellipses"),
        F.explode(F.array(placed)).alias("placed"),
    )
    # starts of windows that occur twice or more: those equal to the sorted neighbour before or after
    beside = F.zip_with(
        F.zip_with("placed", F.slice("placed", 2, F.greatest(F.size("placed"), F.lit(1))), lambda a, b: F.struct(a.alias("a"), (a["h"] == b["h"]).alias("next"))),
        F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice("placed", 1, F.greatest(F.size("placed") - 1, F.lit(0)))),
        lambda ab, p: F.when(ab["next"] | (ab["a"]["h"] == p["h"]), ab["a"]["i"]),
    )
    starts = F.sort_array(F.array_compact(beside))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(i - s["last"], F.lit(3))).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    x = x.select(*[c for c in x.columns if c != "placed"], covered.alias("n_repeat_words"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return x.select(
        "*",
        share("word_chars", "n_words").alias("mean_word_length"),
        share("n_symbols", "word_chars").alias("symbol_ratio"),
        share("n_stop_words", "n_words").alias("stop_word_ratio"),
        share("n_dup_lines", "n_lines").alias("duplicate_line_ratio"),
        share("n_repeat_words", "n_words").alias("repeat_word_ratio"),
        share("n_bullets", "n_lines").alias("bullet_line_ratio"),
        share("n_ellipses", "n_lines").alias("ellipsis_line_ratio"),
    )


def quality_rules(docs: DataFrame, rules: Iterable[tuple[str, float | None, float | None]] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed and kept; null handling as in quality_measures.

    base_failed: fewer than 50 words, or more than half of the words in repeated windows.
    kept: not base_failed and within every bound of the table."""
    x = quality_measures(docs)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return x.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))
