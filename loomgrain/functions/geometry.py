"""Geometry of recognised lines: boxes are arrays of four (x, y) points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def real_boxes(boxes: Column) -> Column:
    """Boxes with exactly four points of two coordinates; an empty array for null."""
    ok = lambda b: (F.size(b) == 4) & F.forall(b, lambda p: (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull())
    return F.filter(F.coalesce(boxes, F.array().cast("array<array<array<int>>>")), lambda b: b.isNotNull() & ok(b))


def height(box: Column) -> Column:
    """X17."""
    y = F.transform(box, lambda p: p[1])
    return F.array_max(y) - F.array_min(y)


def bounds(box: Column) -> Column:
    """Struct x0, y0, x1, y1."""
    x, y = F.transform(box, lambda p: p[0]), F.transform(box, lambda p: p[1])
    return F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))


def angle(box: Column) -> Column:
    """Degrees of the line through the two topmost points (by y, then x)."""
    top = F.array_sort(F.transform(box, lambda p: F.struct(p[1].alias("y"), p[0].alias("x"))))
    return F.degrees(F.atan2((top[1]["y"] - top[0]["y"]).cast("double"), top[1]["x"] - top[0]["x"] + F.lit(1e-6)))


def mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return total / F.nullif(F.size(values), F.lit(0))


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), 0)


def std(values: Column) -> Column:
    """Population standard deviation of an array, in one pass; null for an empty one."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(s: Column, v: Column) -> Column:
        n = s["n"] + 1
        mid = s["mean"] + (v - s["mean"]) / n
        return F.struct(n.alias("n"), mid.alias("mean"), (s["m2"] + (v - s["mean"]) * (v - mid)).alias("m2"))

    return F.aggregate(values, start, step, lambda s: F.sqrt(s["m2"] / F.nullif(s["n"], F.lit(0.0))))


def char_stats(boxes: Column) -> Column:
    """Mean height, coefficient of variation, number; without boxes (0, 1, 0)."""
    heights = F.transform(real_boxes(boxes), lambda b: height(b).cast("double"))
    return let(
        heights,
        lambda h: F.struct(
            F.coalesce(mean(h), F.lit(0.0)).alias("char_h_mean"),
            F.coalesce(std(h) / (mean(h) + 1e-6), F.lit(1.0)).alias("char_h_cv"),
            F.size(h).cast("bigint").alias("n_boxes"),
        ),
    )


def line_stats(boxes: Column, gap: float = 0.8) -> Column:
    """Number of lines and deviation of their angles; without boxes (0, 999).

    Box centres in order of height on the page; a gap of more than ``gap`` mean
    heights to the one before starts a line.
    """

    def lines(b: Column) -> Column:
        far = mean(F.transform(b, lambda x: height(x).cast("double"))) * gap
        centres = F.array_sort(F.transform(b, lambda x: mean(F.transform(x, lambda p: p[1].cast("double")))))
        start = lambda limit: F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("last"), limit.alias("far"))
        step = lambda s, y: F.struct((s["n"] + F.when(s["last"].isNull() | (y - s["last"] > s["far"]), 1).otherwise(0)).alias("n"), y.alias("last"), s["far"].alias("far"))
        return F.aggregate(centres, start(far), step, lambda s: s["n"].cast("bigint"))

    return let(
        real_boxes(boxes),
        lambda b: F.struct(lines(b).alias("line_count"), F.coalesce(std(F.transform(b, angle)), F.lit(999.0)).alias("line_angle_std")),
    )


def densities(words: Column, chars: Column, width: Column, height_px: Column) -> Column:
    """Words and characters per megapixel."""
    mp = width.cast("double") * height_px / 1e6 + 1e-6
    return F.struct((words / mp).alias("text_density"), (chars / mp).alias("char_density"))


def sides(width: Column, height_px: Column) -> Column:
    """X19."""
    return F.struct((width / (height_px + F.lit(1e-6))).alias("aspect_ratio"), F.least(width, height_px).alias("min_side_val"), F.greatest(width, height_px).alias("max_side_val"))
