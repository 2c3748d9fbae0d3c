"""The experience library: query tallies, merges and bounded memories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tallies(outcomes: DataFrame) -> DataFrame:
    """A10: (query, accepted, checked) of true counts; rows without a query are left out."""
    real = outcomes.where(F.col("query").isNotNull() & (F.col("query") != ""))
    return real.groupBy("query").agg(F.count_if(F.size("reasons") == 0).alias("accepted"), F.count(F.lit(1)).alias("checked"))


def accumulated(history: DataFrame, new: DataFrame) -> DataFrame:
    """Tallies over rounds, with pass_rate and whether the query is in the new round."""
    both = history.select("query", "accepted", "checked", F.lit(False).alias("cur")).unionByName(new.select("query", "accepted", "checked", F.lit(True).alias("cur")))
    out = both.groupBy("query").agg(F.sum("accepted").alias("accepted"), F.sum("checked").alias("checked"), F.max("cur").alias("is_current"))
    return out.withColumn("pass_rate", F.coalesce(F.col("accepted") / F.nullif("checked", F.lit(0)), F.lit(0.0)))


def top_queries(library: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best by pass rate, seen in this round, accepted; ties by query."""
    return library.orderBy(F.desc("pass_rate"), F.desc("is_current"), F.desc("accepted"), "query").limit(k)


def merged(candidates: DataFrame) -> DataFrame:
    """Per query the greatest score, and round and status of the latest row by ``ord``; nothing numeric: null score."""
    return candidates.groupBy("query").agg(F.max("score").alias("score"), F.max_by("round", "ord").alias("round"), F.max_by("status", "ord").alias("status"))


def trimmed(candidates: DataFrame, k: int = 10) -> DataFrame:
    """Distinct stripped queries (the first by ``ord``), missing scores as 0, best first."""
    x = candidates.withColumn("query", F.regexp_replace("query", r"^[\s\p{Z}]+|[\s\p{Z}]+\z", "")).where(F.col("query") != "")
    one = x.groupBy("query").agg(F.min(F.struct("ord", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("x"))
    return one.select("query", "x.ord", "x.score").orderBy(F.desc("score"), "ord").limit(k)


def last_rows(history: DataFrame, k: int, order: str = "round") -> DataFrame:
    """The last ``k`` rows."""
    return history.orderBy(F.desc(order)).limit(k)


def accepted_only(candidates: DataFrame) -> DataFrame:
    """F15."""
    return candidates.where(F.col("status") == "accepted")


def compressed(stats: DataFrame, column: str, keys: tuple[str, ...]) -> DataFrame:
    """only whitelisted keys with a value stay in the map ``column``."""
    return stats.withColumn(column, F.map_filter(column, lambda k, v: v.isNotNull() & k.isin(*keys)))


def strategy_due(rounds_done: int, warmup: int, has_strategy: bool, enabled: bool = True) -> bool:
    """F18."""
    return enabled and has_strategy and rounds_done >= warmup


def snapshots(events: DataFrame, order: str, *rates: str) -> DataFrame:
    """Differences to the snapshot before, per second of ``order`` (a timestamp). One row per snapshot."""
    w = W.orderBy(order)
    s = F.unix_micros(F.col(order).cast("timestamp")) / 1e6
    gap = s - F.lag(s).over(w)
    return events.select("*", *[((F.col(r) - F.lag(r).over(w)) / F.nullif(gap, F.lit(0.0))).alias(f"{r}_per_s") for r in rates])
