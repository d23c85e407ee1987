"""Candidates of labels by place, for documents of any length: a range join by buckets, or an array for short ones.

A label's candidates stand to its right in its row, in the four rows below, or, where none of those is there, in the four rows
above. In a long document labels and lines meet by buckets that are as wide as the reach: of x within a row, and of rows;
a label looks into two neighbouring ones, and every pair meets in one of them only. So a document is spread over tasks
by its buckets, and nothing holds all its lines.

Documents that are gathered already (layout.documents) need no join: a long one is cut into bands of rows, each with the rows in
reach of it, so that what a label looks into is small and no line is exchanged or written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions import geometry as g
from docfields.functions import lexicon as lx

#: Documents with more lines than this are joined by buckets.
LONG_LINES = 2_000
RIGHT, BELOW, ABOVE = 1, 2, 3
REACH = lx.LOOKAHEAD_ROWS
#: Rows of a band that a long gathered document is cut into.
BAND_ROWS = 4 * REACH
OUT = ("invoice_id", "anchor", "pos", "phase", "score")


def _gap(a: Column, c: Column) -> Column:
    return c["x1"] - a["x2"]


def _is_right(a: Column, c: Column, same: Column) -> Column:
    return ~same & (_gap(a, c) >= 0) & (_gap(a, c) <= lx.LARGEST_HORIZONTAL_GAP)


def _is_close(a: Column, c: Column) -> Column:
    return g.vertical_gap(a, c) <= lx.LARGEST_VERTICAL_GAP


def _by_buckets(lines: DataFrame) -> DataFrame:
    a = lines.where("is_anchor").select("invoice_id", F.col("pos").alias("anchor"), F.col("row_idx").alias("r"), F.col("box").alias("a"))
    c = lines.where("fits").select(F.col("invoice_id").alias("d"), "pos", F.col("row_idx").alias("s"), F.col("box").alias("c"), "confidence")
    wide = lambda x: F.floor(x / lx.LARGEST_HORIZONTAL_GAP)
    band = lambda x: F.floor(x / REACH)
    doc = F.col("invoice_id") == F.col("d")

    def joined(anchors: DataFrame, buckets: list[Column], own: Column, near: Column, phase: int, score: Column) -> DataFrame:
        left = anchors.withColumn("k", F.explode(F.array(*buckets)))
        pairs = left.join(c.withColumn("l", own), doc & (F.col("k") == F.col("l")) & near)
        return pairs.select("invoice_id", "anchor", "pos", F.lit(phase).alias("phase"), score.alias("score"))

    box, other = F.col("a"), F.col("c")
    beside, over = g.score_right(box, other, F.col("confidence")), g.score_below(box, other, F.col("confidence"))
    by_x = wide(box["x2"])
    right = joined(a, [by_x, by_x + 1], wide(other["x1"]), (F.col("r") == F.col("s")) & _is_right(box, other, F.col("anchor") == F.col("pos")), RIGHT, beside)
    steps = F.col("s") - F.col("r")
    below = joined(a, [band(F.col("r")), band(F.col("r")) + 1], band(F.col("s")), steps.between(1, REACH) & _is_close(box, other), BELOW, over)
    found = right.union(below)
    lone = a.join(found.select(F.col("invoice_id").alias("_d"), F.col("anchor").alias("_a")).distinct(), (F.col("invoice_id") == F.col("_d")) & (F.col("anchor") == F.col("_a")), "left_anti")
    above = joined(lone, [band(F.col("r")) - 1, band(F.col("r"))], band(F.col("s")), steps.between(-REACH, -1) & _is_close(box, other), ABOVE, over)
    return found.union(above)


def _by_array(lines: DataFrame) -> DataFrame:
    item = F.struct("pos", "row_idx", "box", "confidence", "is_anchor", "fits")
    docs = lines.groupBy("invoice_id").agg(F.collect_list(item).alias("own"))
    steps = lambda a, c: c["row_idx"] - a["row_idx"]

    def of(a: Column, own: Column) -> Column:
        fits = F.filter(own, lambda c: c["fits"])
        phase = lambda c: (
            F.when((steps(a, c) == 0) & _is_right(a["box"], c["box"], a["pos"] == c["pos"]), RIGHT).when(steps(a, c).between(1, REACH) & _is_close(a["box"], c["box"]), BELOW).when(steps(a, c).between(-REACH, -1) & _is_close(a["box"], c["box"]), ABOVE)
        )
        score = lambda c: F.when(steps(a, c) == 0, g.score_right(a["box"], c["box"], c["confidence"])).otherwise(g.score_below(a["box"], c["box"], c["confidence"]))
        told = F.filter(F.transform(fits, lambda c: F.struct(a["pos"].alias("anchor"), c["pos"].alias("pos"), phase(c).alias("phase"), score(c).alias("score"))), lambda p: p["phase"].isNotNull())
        near = F.filter(told, lambda p: p["phase"] < ABOVE)
        return F.when(F.size(near) > 0, near).otherwise(told)

    anchors = F.filter("own", lambda x: x["is_anchor"])
    every = docs.select("invoice_id", F.explode(F.flatten(F.transform(anchors, lambda a: of(a, F.col("own"))))).alias("p"))
    return every.select("invoice_id", "p.anchor", "p.pos", "p.phase", "p.score")


def candidates(lines: DataFrame, long_lines: int = LONG_LINES) -> DataFrame:
    """Pairs (invoice_id, anchor, pos, phase, score) of lines (invoice_id, pos, row_idx, box, confidence, is_anchor, fits): an
    anchor and each line that fits to its right (phase 1) or below (2) or, only where there is neither, above (3).

    Documents of over long_lines lines are joined by buckets, others gathered as arrays; both give the same. Null flags count as
    false; lines without a box or row have no pairs; a document without anchors has none."""
    whole = F.col("box.x1").isNotNull() & F.col("box.x2").isNotNull() & F.col("box.y1").isNotNull() & F.col("box.y2").isNotNull() & F.col("row_idx").isNotNull()
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    x = lines.where(whole).select("invoice_id", "pos", "row_idx", "box", "confidence", flag("is_anchor"), flag("fits"))
    sizes = x.groupBy("invoice_id").agg((F.count(F.lit(1)) > long_lines).alias("_long"))
    long = x.join(sizes.where("_long").select("invoice_id"), "invoice_id", "left_semi")
    short = x.join(sizes.where("NOT _long").select("invoice_id"), "invoice_id", "left_semi")
    return _by_buckets(long).unionByName(_by_array(short)).select(*OUT)


def candidates_of(docs: DataFrame, long_lines: int = LONG_LINES) -> DataFrame:
    """candidates() of layout.documents with is_anchor and fits among the columns of a line.

    Documents of over long_lines lines are cut into bands of rows, others looked at as they are; both give the same. A label is a row
    with the rows in its reach, and its pairs are rows too, so that their conditions and scores are compiled."""
    size = F.aggregate("rows", F.lit(0), lambda n, row: n + F.size(row))
    last = F.floor((F.size("rows") - 1) / BAND_ROWS).cast("int")
    # a band: its first row, how many rows are its own, and the rows from REACH above to REACH below these
    cut = lambda b: F.struct((b * BAND_ROWS).alias("at"), F.lit(BAND_ROWS).alias("n"), F.greatest(b * BAND_ROWS - REACH, F.lit(0)).alias("top"), F.slice("rows", F.greatest(b * BAND_ROWS - REACH, F.lit(0)) + 1, F.lit(BAND_ROWS + 2 * REACH)).alias("rows"))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.size("rows").alias("n"), F.lit(0).alias("top"), F.col("rows")))
    bands = docs.where(F.size("rows") > 0).select("invoice_id", F.explode(F.when(size > long_lines, F.transform(F.sequence(F.lit(0), last), cut)).otherwise(whole)).alias("b"))
    bands = bands.select("invoice_id", "b.top", "b.rows", F.slice("b.rows", F.col("b.at") - F.col("b.top") + 1, F.col("b.n")).alias("own"))
    boxed = lambda x: x["box"]["x1"].isNotNull() & x["box"]["x2"].isNotNull() & x["box"]["y1"].isNotNull() & x["box"]["y2"].isNotNull()
    fitting = F.transform("rows", lambda row: F.filter(row, lambda x: x["fits"] & boxed(x)))
    labels = bands.select("invoice_id", "top", fitting.alias("rows"), F.explode(F.filter(F.flatten("own"), lambda x: x["is_anchor"] & boxed(x))).alias("a"))
    at = F.col("a.row_idx") - F.col("top")
    near = labels.select(
        "invoice_id", F.col("a.pos").alias("anchor"), F.col("a.row_idx").alias("r"), F.col("a.box").alias("a"),
        F.flatten(F.slice("rows", at + 1, F.lit(REACH + 1))).alias("onward"), F.flatten(F.slice("rows", F.greatest(at - REACH, F.lit(0)) + 1, F.least(at, F.lit(REACH)))).alias("before"),
    )
    a = F.col("a")
    met = F.exists("onward", lambda c: F.when(c["row_idx"] == F.col("r"), _is_right(a, c["box"], F.col("anchor") == c["pos"])).otherwise(_is_close(a, c["box"])))
    pairs = near.select("invoice_id", "anchor", "r", "a", F.explode(F.when(met, F.col("onward")).otherwise(F.col("before"))).alias("c"))
    c, steps = F.col("c.box"), F.col("c.row_idx") - F.col("r")
    phase = F.when(steps == 0, F.when(_is_right(a, c, F.col("anchor") == F.col("c.pos")), RIGHT)).when(_is_close(a, c), F.when(steps > 0, BELOW).otherwise(ABOVE))
    score = F.when(steps == 0, g.score_right(a, c, F.col("c.confidence"))).otherwise(g.score_below(a, c, F.col("c.confidence")))
    return pairs.select("invoice_id", "anchor", F.col("c.pos").alias("pos"), phase.alias("phase"), score.alias("score")).where("phase IS NOT NULL").select(*OUT)
