"""Texts as people order and look them up: letter case and accents don't tell them apart.

Columns keep their spelling; what is compared, grouped or sorted is the same text under one of Spark's collations, so
joins and sorts stay ordinary ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: root language order, without case and accents.
READING = "UNICODE_CI_AI"


def read(text: Column) -> Column:
    """The text under READING: equal to others that differ in case or accents only, and in the order of an alphabet."""
    return F.collate(text, READING)


def by_reading(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows sorted by texts as read, those that read alike by their spelling (null first); sorted by ranges, not in one task."""
    return rows.orderBy(*[c for name in columns for c in (read(F.col(name)), F.col(name))])


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with what a table (key, ...) holds for a key that reads alike: all its other columns, null where it has none. Of
    entries that read alike the one spelled first counts."""
    others = [c for c in table.columns if c != key]
    whole = F.struct(*[F.col(f"`{c}`") for c in others])
    first = table.where(F.col(key).isNotNull()).groupBy(read(F.col(key)).alias("_read")).agg(F.min_by(whole, F.struct(F.col(key), F.to_json(whole))).alias("_found"))
    joined = rows.join(first, read(rows[key]) == F.col("_read"), "left")
    return joined.select(*[rows[c] for c in rows.columns], *[F.col("_found").getField(c).alias(c) for c in others])
