"""The queries opN_<name>, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docfields.llm import bpe, decontamination, importance, jaccard_join, language_id, leaderboard, mixing, ngram_lm, quality_rules, suffix_dedup, target_resampling, token_planes, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file that op9 and the pipeline use; it lies outside the repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taken per document of a mix by weights 1, 2, 3; see mixing.mix_sources."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back; see warc.page_records."""
    return warc.page_records(table(spark, sf_dir, "pages"))


def op3_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base score and model score per document; see ngram_lm.score_texts."""
    return ngram_lm.score_texts(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language per document; see language_id.held_out_languages."""
    return language_id.held_out_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 400-byte strings removed from each document; see suffix_dedup.remove_repeats."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op7_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of documents by importance; see importance.importance_sample."""
    sample = importance.importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return sample.select("doc_id", "log_weight", "key")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs, and which; see decontamination.contaminated."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written in plane files and read back; see token_planes."""
    return token_planes.read_tokens(token_planes.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path()))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict per document; see quality_rules.quality_rules."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that link, and the number of links of each; see jaccard_join.jaccard_links."""
    return jaccard_join.jaccard_links(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them; see bpe.round_trip."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op12_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each nation's ten best items by day of arrival; see leaderboard.changes."""
    return leaderboard.changes(table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "vendors"), table(spark, sf_dir, "items"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of each document in a draw towards the benchmark; see target_resampling.resample."""
    drawn = target_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_warc": op2_warc,
    "op3_ngram_lm": op3_ngram_lm,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_importance": op7_importance,
    "op8_decontamination": op8_decontamination,
    "op9_token_planes": op9_token_planes,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_bpe": op11_bpe,
    "op12_leaderboard": op12_leaderboard,
    "op13_resampling": op13_resampling,
}

_WARC_SQL = """
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN keep END AS refers_to
FROM (SELECT *, strlen(body) >= 1000 AND copies > 1 AND page_id <> keep AS again
  FROM (SELECT page_id, body, max(page_id) OVER (PARTITION BY body) AS keep, count(*) OVER (PARTITION BY body) AS copies
    FROM (SELECT page_id, coalesce(html, '') AS body FROM pages)))
"""

_STOPS = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
_RULES_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
m AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(list_filter(words, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({_STOPS}))) AS n_stop,
    len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_bullets, len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_dots FROM d),
g AS (SELECT doc_id, i, words[i:i + 2] AS w FROM d, LATERAL (SELECT unnest(range(1, len(words) - 1)) AS i)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS c FROM g) WHERE c > 1) GROUP BY 1),
x AS (SELECT m.*, coalesce(r.n, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(r.n, 0) > 50 * n_words AS base_failed FROM m LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / word_chars <= 0.1 AND n_stop / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.3
    AND n_bullets / n_lines <= 0.9 AND n_dots / n_lines <= 0.3 AS kept FROM x
"""

#: SQL of those queries that it can express; the others are held against plain versions in tests.
ORACLE_SQL: dict[str, str] = {"op2_warc": _WARC_SQL, "op5_quality_rules": _RULES_SQL}
