"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Every stage takes what its predecessor kept, whole, and all but the last return the
columns of documents. The stages, in order: language ID, n-gram Jaccard join, benchmark
decontamination, mixing of sources to target weights, token-ID output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.llm.common import WORD, dropping, materialize, shared_path
from docfields.llm.decontamination import decontaminated
from docfields.llm.jaccard_join import jaccard_rows
from docfields.llm.language_id import UNDETERMINED, language_of, train
from docfields.llm.mixing import mixed_documents
from docfields.llm.queries import tokenizer_path
from docfields.llm.token_planes import read_tokens, write_tokens

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document whose best language contains a smaller share of its n-grams than this is in none of them.
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty texts too) or in none of the languages
    learned from all rows that name one; rows don't affect each other otherwise."""
    filters = train(docs.select("lang", "text"))
    told = docs.select(F.struct("*").alias("row"), language_of(filters, F.col("text")).alias("told"))
    sure = (F.col("told.lang_pred") != UNDETERMINED) & (F.col("told.score") >= LEAST_SCORE)
    return told.where(sure).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each component of linked documents, one row: the one with the smallest doc_id,
    of those that share it the one with the smallest hash of its text; one without a doc_id only
    where none has any.

    Rows are told apart by doc_id and text; those that repeat both are one document, of which the row
    whose other columns come first as JSON stays, except that texts without a word link to nothing, so
    all of them that have no doc_id stay."""
    key = lambda d, h: [F.coalesce(d, F.lit(0)).alias("d"), d.isNull().alias("x"), h.alias("h")]
    rows = materialize(jaccard_rows(docs).where("root IS NOT NULL").select("root", *key(F.col("doc_id"), F.col("h"))).distinct(), "linked-rows")
    least = rows.groupBy("root").agg(F.min(F.struct("x", "d", "h")).alias("least")).select("least.*")
    # a row's id and text decide its component, so rows meet the least ones by these, never by a root that may hold a third of them
    lost = rows.join(least, ["d", "x", "h"], "left_anti").select("d", "x", "h")
    bare = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    others = [c for c in docs.columns if c != "text"]
    told = docs.where(~bare).select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col("text").alias("t"), *key(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))))
    # the join's keys are among those of the grouping, so documents are shuffled once
    kept = told.join(lost, ["d", "x", "h"], "left_anti").groupBy("d", "x", "h", "t").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.select(*[F.col("t").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]).union(docs.where(bare))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item occurs. Null and empty texts hold none and stay, rows that repeat
    are judged alike, an empty benchmark drops nothing; other columns don't matter."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to target weights: each document as often as the mix takes it. Null and empty texts are never
    taken; a null source is one of its own, a null doc_id an ordinary one; rows equal in id and text are documents of their own."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents and reads, per document, its place, length and checksum, in ascending
    doc_id, nulls first. Null and empty texts are an end alone; rows that repeat an id each have their place."""
    return read_tokens(write_tokens(docs, tokenizer_path()))


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; the last stage's rows, read from its table. What a stage wrote on its way is
    deleted once its own table is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        with dropping(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
