"""What the corpus operators share: the shared folder, written tables, text columns."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words (bytes 0x20 and 0x09-0x0D).
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where the session names none, in local mode as in tests, a temporary folder is
    made and set as the checkpoint folder; on a cluster that is an error, as executors don't see it.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docfields-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; each call names another one."""
    path = f"{shared_dir(spark)}/docfields/{kind}-{uuid.uuid4().hex}"
    for held in _HELD:
        held.append(path)
    return path


_HELD: list[list[str]] = []


@contextlib.contextmanager
def dropping(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, the tables and files that shared_path named in between. For callers that
    have written what they read from them: a DataFrame that still reads one can't run afterwards."""
    paths: list[str] = []
    _HELD.append(paths)
    try:
        yield
    finally:
        _HELD.remove(paths)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def materialize(df: DataFrame, kind: str) -> DataFrame:
    """Write df once as a table in the shared folder and read it back: lineage ends
    here, and an executor lost later costs no recomputation."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session with another value of a setting for a while; the one it had, or none, comes back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0), without building an array of them."""
    marks = F.regexp_replace(text, WORD, "x")
    return F.coalesce(F.length(F.translate(marks, SPACES, "")), F.lit(0)).cast("long")


def words_of(text: Column) -> Column:
    """Array of the words of a text (null: empty)."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.array_remove(F.split(flat, " "), "")


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) mod modulus is remainder; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def total_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts; sizes numbers of chunks and buckets."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def pieces(total: int, each: int, least: int = 1) -> int:
    return max(least, -(-total // each))
