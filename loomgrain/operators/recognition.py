"""Projections over recognised text: lines, confidences and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.functions.geometry import height
from loomgrain.functions.text import strip


def confidence(c: Column) -> Column:
    """Percent as a fraction."""
    return F.when(c > 1, c / 100).otherwise(c)


def line_table(texts: Column, confs: Column, boxes: Column | None = None) -> Column:
    """The lines as structs (pos, text, conf, box); a missing confidence or box is null."""
    pos = F.sequence(F.lit(0), F.size(texts) - 1)
    make = lambda i: F.struct(i.alias("pos"), F.get(texts, i).alias("text"), confidence(F.get(confs, i)).alias("conf"), (F.get(boxes, i) if boxes is not None else F.lit(None).cast("array<array<int>>")).alias("box"))
    return F.when(F.size(texts) > 0, F.transform(pos, make)).otherwise(F.array().cast("array<struct<pos:int,text:string,conf:double,box:array<array<int>>>>"))


def ocr_stats(texts: Column, confs: Column) -> Column:
    """Mean confidence of the non-blank lines (0 without any), their number, and legibility.

    Legibility is the mean of the confidences that are there: 0 for no confidences, NaN if all are null.
    """
    lines = F.filter(line_table(texts, confs), lambda x: strip(x["text"]) != "")
    c = F.transform(lines, lambda x: F.coalesce(x["conf"], F.lit(0.0)))
    avg = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(a), F.lit(0))
    there = F.filter(F.transform(confs, confidence), lambda v: v.isNotNull())
    legible = F.when(F.coalesce(F.size(confs), F.lit(0)) <= 0, 0.0).otherwise(F.coalesce(avg(there), F.lit(float("nan"))))
    return F.struct(F.coalesce(avg(c), F.lit(0.0)).alias("avg_conf"), F.size(lines).cast("bigint").alias("n_lines"), legible.alias("legibility"))


def best_lines(texts: Column, confs: Column, k: int = 10) -> Column:
    """T4: the ``k`` lines of greatest confidence (none: 0), equal ones in order."""
    order = F.transform(line_table(texts, confs), lambda x: F.struct((-F.coalesce(x["conf"], F.lit(0.0))).alias("c"), x["pos"].alias("pos"), x["text"].alias("text")))
    return F.transform(F.slice(F.array_sort(order), 1, k), lambda x: x["text"])


def important_lines(texts: Column, boxes: Column, k: int = 15) -> Column:
    """T5: non-blank lines, tallest box first, each once by its first 30 characters without case, quoted.

    A line without a proper box counts as 20 pixels high.
    """
    tall = lambda b: F.coalesce(F.when(F.size(b) >= 4, F.abs(F.get(F.get(b, F.lit(3)), F.lit(1)) - F.get(F.get(b, F.lit(0)), F.lit(1)))), F.lit(20))
    n = F.least(F.size(texts), F.size(boxes))
    make = lambda i: F.struct((-tall(F.get(boxes, i))).alias("h"), i.alias("pos"), strip(F.get(texts, i)).alias("text"))
    lines = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(F.array().cast("array<struct<h:int,pos:int,text:string>>"))
    lines = F.array_sort(F.filter(lines, lambda x: x["text"] != ""))
    keys = F.transform(lines, lambda x: F.left(F.lower(x["text"]), F.lit(30)))
    first = F.filter(lines, lambda x, i: F.array_position(keys, F.left(F.lower(x["text"]), F.lit(30))) == i + 1)
    return F.transform(F.slice(first, 1, k), lambda x: F.concat(F.lit('"'), x["text"], F.lit('"')))


def lines_with(texts: Column, keys: list[str], k: int = 12) -> Column:
    """The first ``k`` lines that hold one of ``keys`` without case; none for no keys."""
    if not keys:
        return F.array().cast("array<string>")
    has = lambda t: F.lower(t).rlike("|".join(r"\Q" + x.lower().replace(r"\E", "") + r"\E" for x in keys))
    return F.transform(F.slice(F.filter(texts, has), 1, k), strip)


def mean_height(boxes: Column) -> Column:
    return F.aggregate(F.transform(boxes, lambda b: height(b).cast("double")), F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(boxes), F.lit(0))


def matched(tasks: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks with their result, results without a task, results without a job_id)."""
    ok = results.where(F.col("job_id").isNotNull())
    return tasks.join(ok, "job_id"), ok.join(tasks.select("job_id"), "job_id", "left_anti"), results.where(F.col("job_id").isNull())
