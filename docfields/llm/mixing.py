"""Mixing sources to target weights by Sainte-Lague apportionment (native DataFrame code).

Every source is cut into shards (by a seeded hash of the document), every shard
into blocks of equal numbers of words. Blocks are apportioned to sources by the
highest quotients target / (2k + 1), then within each source to its shards, which
gives an integer quota per shard. A shard's documents are laid out in a seeded
order; its quota is read as whole passes over its blocks and a run of blocks from
a seeded start. Nothing but sums per source and per shard is gathered; a hot
source has many shards, so no window holds more than one shard's thin rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docfields.llm.common import materialize, word_count


def water_fill(sources: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """Adds rank, weight and target to one row per source (source, source_size).

    Sources by code point, null last, get the weights in turn. All sizes together
    are shared out by weight; a target stops at max_repeats times its source's size
    and the excess is shared by weight among the others: target = min(cap, level * weight),
    where the level follows from the first source, by cap per weight, that isn't capped.
    The windows are over one thin row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    )
    ranked = ranked.withColumn("cap", F.col("source_size") * float(max_repeats)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ranked.withColumn(
        "level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    )
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(everything)
    return levels.withColumn("target", F.least(F.col("cap"), F.coalesce(first["level"], F.lit(0.0)) * F.col("weight"))).drop("ratio", "level", "cap")


def sainte_lague(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds `seats`: in each group, `total` seats go to its rows by the highest quotients
    ideal / (2k + 1), k = 0, 1, ..., no row above its `cap`; ties go to the row first in `order`.

    rows: group columns, order columns, ideal (double), cap (long), total (long, one value a group).
    Only quotients around the rounded share can decide, about eight a row: those below are
    seats for certain, so the work doesn't grow with the number of seats.
    """
    g = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    x = rows.withColumn("_sum", F.sum("ideal").over(g)).withColumn("_n", F.count(F.lit(1)).over(g))
    x = x.withColumn("_v", F.when(F.col("_sum") > 0, F.col("ideal") * F.col("total") / F.col("_sum")).otherwise(F.lit(0.0)))
    x = x.withColumn("_a", F.least(F.col("cap"), F.floor(F.col("_v") + 0.5)))
    x = x.withColumn("_open", F.when(F.col("_a") < F.col("cap"), F.col("_v")).otherwise(F.lit(0.0))).withColumn("_opens", F.sum("_open").over(g))
    x = x.withColumn("_w", (F.ceil(F.when(F.col("_opens") > 0, F.col("_n") * 2 * F.col("_open") / F.col("_opens")).otherwise(F.lit(0.0))) + 2).cast("long"))
    x = x.withColumn("_low", F.greatest(F.lit(0), F.col("_a") - F.col("_w"))).withColumn("_high", F.least(F.col("cap"), F.col("_a") + F.col("_w")))
    x = x.withColumn("_left", F.col("total") - F.sum("_low").over(g))
    tried = F.when((F.col("_high") > F.col("_low")) & (F.col("_v") > 0), F.sequence("_low", F.col("_high") - 1))
    x = x.withColumn("_k", F.explode_outer(tried)).withColumn("_q", F.col("_v") / (F.col("_k") * 2 + 1))
    first = g.orderBy(F.col("_q").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in order], "_k")
    x = x.withColumn("_won", (F.col("_q").isNotNull() & (F.row_number().over(first) <= F.col("_left"))).cast("long"))
    keep = [c for c in rows.columns if c not in (*group, *order)]
    return x.groupBy(*group, *order).agg(*[F.first(c).alias(c) for c in keep], (F.first("_low") + F.sum("_won")).alias("seats"))


def mix_sources(
    docs: DataFrame,
    *,
    weights: Sequence[int] = (1, 2, 3),
    max_repeats: int = 3,
    block_words: int = 16,
    shard_words: int = 1 << 20,
    seed: int = 17,
    carry: bool = False,
) -> DataFrame:
    """How many words of each document a mix of sources by weight takes.

    Returns doc_id, source, size, source_size, target, taken (and `row`, a struct of all
    columns of docs, if carry). One result row per input row: repeated rows count as
    documents of their own, a null doc_id is an ordinary one, null source is a source of
    its own (the last), null and empty texts have size 0 and nothing taken, an empty table
    gives an empty result; other columns don't matter. A shard's quota never exceeds
    max_repeats passes, so no document does. Reruns agree: everything follows from the
    seed and the rows.
    """
    base = docs.select(
        F.col("doc_id"),
        F.col("source"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64("text").alias("_h"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    )
    thin = materialize(base.drop("row"), "mix-sizes")
    sources = thin.groupBy("source").agg(F.sum("size").alias("source_size"))
    shards_of = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("int")
    sources = materialize(water_fill(sources, weights, max_repeats).withColumn("n_shards", shards_of), "mix-sources")

    def keyed(rows: DataFrame) -> DataFrame:
        """Adds the source's figures and the row's shard; the key stands for a null source too."""
        named = sources.select(F.struct("source").alias("_source"), "rank", "source_size", "target", "n_shards")
        out = rows.join(named, F.struct("source") == F.col("_source"), "inner").drop("_source")
        spot = F.xxhash64(F.lit(seed), "doc_id", "_h")
        return out.withColumn("shard", F.pmod(spot, F.col("n_shards").cast("long")))

    shards = keyed(thin).groupBy("rank", "shard").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    shards = shards.withColumn("blocks", F.ceil(F.col("words") / block_words))
    per_source = shards.groupBy("rank").agg(F.sum("blocks").alias("blocks"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    ideal = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(F.lit(0.0))
    per_source = per_source.select("rank", ideal.alias("ideal"), (F.col("blocks") * max_repeats).alias("cap"))
    everything = Window.partitionBy(F.lit(0))
    seats = sainte_lague(per_source.withColumn("total", F.floor(F.sum("ideal").over(everything) + 0.5)), [], ["rank"])
    quotas = shards.join(seats.select("rank", F.col("seats").alias("total")), "rank").select(
        "rank", "shard", "words", "blocks", F.col("blocks").cast("double").alias("ideal"), (F.col("blocks") * max_repeats).alias("cap"), "total"
    )
    quotas = materialize(sainte_lague(quotas, ["rank"], ["shard"]), "mix-quotas").select(
        F.col("rank").alias("_rank"), F.col("shard").alias("_shard"), "words", "blocks", "seats"
    )

    out = keyed(base if carry else thin)
    out = out.join(quotas, (F.col("rank") == F.col("_rank")) & (F.col("shard") == F.col("_shard")), "inner")
    line = Window.partitionBy("rank", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "_h"), "doc_id", "_h").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_end", F.sum("size").over(line)).withColumn("_at", F.col("_end") - F.col("size"))
    full = F.expr("CASE WHEN blocks > 0 THEN seats DIV blocks ELSE 0 END")
    more = F.expr("CASE WHEN blocks > 0 THEN seats % blocks ELSE 0 END")
    start = F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "rank", "shard"), F.col("blocks"))).otherwise(F.lit(0))
    out = out.withColumn("_full", full).withColumn("_from", start).withColumn("_to", F.col("_from") + more)
    edge = "CASE WHEN blocks > 0 THEN ({} * words) DIV blocks ELSE 0 END"
    low = F.expr(edge.format("_from"))
    high = F.expr(edge.format("least(_to, blocks)"))
    wrapped = F.expr(edge.format("greatest(_to - blocks, 0)"))
    overlap = F.greatest(F.lit(0), F.least("_end", high) - F.greatest("_at", low)) + F.greatest(F.lit(0), F.least("_end", wrapped) - F.col("_at"))
    return out.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("_full") * F.col("size") + overlap).cast("long").alias("taken"), *(["row"] if carry else [])
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it, to the nearest whole
    number of copies (a run of blocks cuts at most two documents of a shard). Columns are those of docs."""
    taken = mix_sources(docs, carry=True, **options)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0)).cast("int")
    repeated = taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies)))
    return repeated.select("row.*")
