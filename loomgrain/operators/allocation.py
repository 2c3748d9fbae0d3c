"""Distribution of a gap over categories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrain.runtime import grouped

# All tables here have one row per category (topic, subtopic): the configured
# pairs, not the samples. Their windows are over that dimension.
KEY = ["topic", "subtopic"]
def _all():
    return W.partitionBy(F.lit(0))


def gap(counts: DataFrame, target: int) -> DataFrame:
    """current_total and what is missing to ``target``."""
    total = F.coalesce(F.sum("image_count"), F.lit(0))
    return counts.agg(total.alias("current_total")).withColumn("gap", F.greatest(F.lit(0), F.lit(target) - F.col("current_total")))


def pair_counts(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Accepted rows of every configured pair, 0 where there are none."""
    n = items.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    return pairs.select(*KEY).distinct().join(n, KEY, "left").select(*KEY, F.coalesce("n", F.lit(0)).alias("image_count"))


def uniform(counts: DataFrame, amount: int) -> DataFrame:
    """The same for all, the rest one each to the first by name."""
    pos, n = F.row_number().over(_all().orderBy(*KEY)), F.count(F.lit(1)).over(_all())
    x = counts.withColumn("pos", pos).withColumn("n", n)
    need = F.expr(f"{int(amount)} div n") + (F.col("pos") <= F.expr(f"{int(amount)} % n")).cast("int")
    return x.select(*KEY, F.greatest(F.lit(0), need).cast("bigint").alias("need"))


def inverse(counts: DataFrame, amount: int) -> DataFrame:
    """Weights 1, 1/2, 1/3 ... by ascending count (ties by name), rounded down, the rest one each in that order."""
    pos = F.row_number().over(_all().orderBy("image_count", *KEY))
    x = counts.withColumn("pos", pos).withColumn("w", F.lit(1.0) / F.col("pos"))
    ordered = _all().orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = x.withColumn("base", F.floor(F.lit(float(amount)) * (F.col("w") / F.sum("w").over(ordered))))
    left = F.lit(int(amount)) - F.sum("base").over(_all())
    return x.select(*KEY, (F.col("base") + (F.col("pos") <= left).cast("int")).cast("bigint").alias("need"))


def shrunk(needs: DataFrame, amount: int) -> DataFrame:
    """A14 where the needs (capped) exceed the gap: largest remainder, ties to the greatest name; at most one more each.

    ``needs``: topic, subtopic, need, and optionally room (null: no cap).
    """
    room = F.col("room") if "room" in needs.columns else F.lit(None).cast("bigint")
    x = needs.withColumn("v", F.least(F.col("need"), F.coalesce(room, F.col("need"))))
    x = x.withColumn("scaled", F.col("v") * (F.lit(float(amount)) / F.sum("v").over(_all())))
    x = x.withColumn("base", F.least(F.floor("scaled"), F.coalesce(room, F.floor("scaled"))))
    x = x.withColumn("frac", F.col("scaled") - F.col("base"))
    free = room.isNull() | (F.col("base") < room)
    pos = F.sum(free.cast("int")).over(_all().orderBy(F.desc("frac"), F.desc("topic"), F.desc("subtopic")).rowsBetween(W.unboundedPreceding, 0))
    left = F.lit(int(amount)) - F.sum("base").over(_all())
    x = x.withColumn("plus", (free & (pos <= left)).cast("int"))
    return x.select(*KEY, (F.col("base") + F.col("plus")).cast("bigint").alias("need"))


def _expand(amount: int):
    def one(t: pd.DataFrame) -> pd.DataFrame:
        """The deficit by weight, then by remainder, then in turns, never beyond a category's room."""
        t = t.sort_values(KEY).reset_index(drop=True)
        room = t["room"].fillna(float("inf"))
        got = t["need"].clip(upper=room)
        spare, weight = room - got, got.clip(lower=1)
        open_ = spare > 0
        deficit = amount - int(got.sum())
        if got.sum() and deficit > 0 and open_.any():
            raw = deficit * (weight / weight[open_].sum())
            extra = raw.where(open_, 0.0).floordiv(1).clip(upper=spare)
            left = int(deficit - extra.sum())
            rank = t.assign(f=(raw - extra).where(open_, -1.0)).sort_values(["f", *KEY], ascending=False).index
            for k in rank:
                if left > 0 and open_[k] and extra[k] < spare[k]:
                    extra[k] += 1
                    left -= 1
            while left > 0 and (extra < spare).any():
                for k in t.index:
                    if left > 0 and extra[k] < spare[k]:
                        extra[k] += 1
                        left -= 1
            got = got + extra
        elif not got.sum():
            got = got * 0
        return t.assign(need=got.astype("int64"))[KEY + ["need"]]

    return one


def scaled(needs: DataFrame, amount: int) -> DataFrame:
    """Needs shrunk or expanded to ``amount`` within each category's room; all zero for no gap or no needs.

    The categories are one small group, configured and not data.
    """
    if amount <= 0:
        return needs.select(*KEY, F.lit(0).cast("bigint").alias("need"))
    x = needs if "room" in needs.columns else needs.withColumn("room", F.lit(None).cast("double"))
    x = x.select(*KEY, F.col("need").cast("double").alias("need"), F.col("room").cast("double").alias("room"))
    total = x.agg(F.coalesce(F.sum(F.least("need", F.coalesce("room", "need"))), F.lit(0.0))).first()[0]
    if total >= amount:
        return shrunk(x.withColumn("need", F.col("need").cast("bigint")).withColumn("room", F.col("room").cast("bigint")), amount)
    return grouped(x.withColumn("one", F.lit(1)), "one").applyInPandas(_expand(amount), "topic string, subtopic string, need bigint")


def parsed_needs(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(topic, subtopic, need) from lines (pos, line) such as ``Topic Sub: need 5 more``; later lines hold.

    The number is the first of the part behind the last colon, at least 0; the topic
    is the longest name that begins the part before it, else its first word.
    """
    trim: Column = F.regexp_replace("line", r"^[\s\p{Z}]+|[\s\p{Z}]+\z", "")
    x = lines.where(F.col("line").isNotNull()).select("pos", F.regexp_extract(trim, r"(?s)^(.*):([^:]*)\z", 1).alias("head"), F.regexp_extract(trim, r"(?s)^(.*):([^:]*)\z", 2).alias("tail"))
    x = x.withColumn("head", F.trim("head")).withColumn("n", F.regexp_extract("tail", r"(-?\d+)", 1)).where((F.col("n") != "") & (F.col("head") != ""))
    names = F.broadcast(pairs.select(F.col("topic").alias("t")).where(F.col("t") != "").distinct())  # configured topics
    hit = x.join(names, F.expr("startswith(head, t) and trim(substring(head, length(t) + 1)) != ''"), "left")
    best = hit.groupBy("pos", "head", "n").agg(F.max_by("t", F.length("t")).alias("t"))
    first = F.regexp_extract("head", r"^(\S+)\s+(.+)\z", 1)
    rest = F.regexp_extract("head", r"^(\S+)\s+(.+)\z", 2)
    best = best.select("pos", F.coalesce("t", first).alias("topic"), F.trim(F.when(F.col("t").isNotNull(), F.expr("substring(head, length(t) + 1)")).otherwise(rest)).alias("subtopic"), F.greatest(F.lit(0), F.col("n").cast("bigint")).alias("need"))
    best = best.where((F.col("topic") != "") & (F.col("subtopic") != ""))
    return best.groupBy(*KEY).agg(F.max_by("need", "pos").alias("need"))
