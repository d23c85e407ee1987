"""Boxes: struct<x1, y1, x2, y2> of doubles, and the scores that rank candidates by place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))])


def envelope(polygon: Column) -> Column:
    """Smallest box around an array of [x, y] points; null if there is none."""
    xs, ys = F.transform(polygon, lambda p: p[0].cast("double")), F.transform(polygon, lambda p: p[1].cast("double"))
    return F.when(F.size(polygon) > 0, F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")))


def width(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def center_x(b: Column) -> Column:
    return (b["x1"] + b["x2"]) / 2.0


def center_y(b: Column) -> Column:
    return (b["y1"] + b["y2"]) / 2.0


def vertical_overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))


def horizontal_overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))


def vertical_gap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.greatest(a["y1"], b["y1"]) - F.least(a["y2"], b["y2"]))


def horizontal_gap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.greatest(a["x1"], b["x1"]) - F.least(a["x2"], b["x2"]))


def is_same_row(a: Column, b: Column) -> Column:
    """Overlap of more than half of the shorter height; never without height."""
    shorter = F.least(height(a), height(b))
    return F.when(shorter > 0, vertical_overlap(a, b) / shorter > 0.5).otherwise(F.lit(False))


def score_same_line(confidence: Column) -> Column:
    return F.lit(1000.0) + confidence * 100.0


def score_right(anchor: Column, value: Column, confidence: Column) -> Column:
    gap = F.greatest(F.lit(0.0), value["x1"] - anchor["x2"])
    return F.lit(1000.0) - gap * 5.0 - F.abs(center_y(value) - center_y(anchor)) * 5.0 + confidence * 100.0


def score_below(anchor: Column, value: Column, confidence: Column) -> Column:
    return F.lit(800.0) - vertical_gap(anchor, value) * 8.0 - horizontal_gap(anchor, value) * 3.0 + confidence * 100.0


def score_general(anchor: Column, value: Column, confidence: Column, same_line: bool) -> Column:
    """The general score of a value for a label: in one line by gap and height, else by gap and distance of centres."""
    if same_line:
        gap = F.greatest(F.lit(0.0), value["x1"] - anchor["x2"])
        return F.lit(1000.0) - gap * 10.0 - F.abs(center_y(value) - center_y(anchor)) * 5.0 + confidence * 100.0
    return F.lit(800.0) - vertical_gap(anchor, value) * 10.0 - F.abs(center_x(value) - center_x(anchor)) * 2.0 + confidence * 100.0
