"""The query frontier: what to search for next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrain.functions.text import strip
from loomgrain.runtime import broadcast_if_small


def pairs(config_topics: DataFrame) -> DataFrame:
    """(topic, subtopic) from rows of topic and seed_queries; empty names and seeds are left out."""
    x = config_topics.where(F.col("topic") != "").select("topic", F.explode("seed_queries").alias("subtopic"))
    return x.where(F.col("subtopic") != "")


def remaining(all_pairs: DataFrame, *done: DataFrame) -> DataFrame:
    """Pairs that are neither processed nor scheduled."""
    for d in done:
        all_pairs = all_pairs.join(d.select("topic", "subtopic"), ["topic", "subtopic"], "left_anti")
    return all_pairs


def variants(base: Column, more: Column, subtopic: Column) -> Column:
    """Base and variant queries, stripped, in order, each once; the subtopic if there are none."""
    clean = F.filter(F.transform(F.concat(F.coalesce(base, F.array().cast("array<string>")), F.coalesce(more, F.array().cast("array<string>"))), strip), lambda q: q != "")
    return F.when(F.size(clean) > 0, F.array_distinct(clean)).otherwise(F.array(subtopic))


def not_issued(queries: DataFrame, issued: DataFrame, order: str) -> DataFrame:
    """queries whose text was not issued before, each text once (the first by ``order``).

    The first is found by an aggregate, so a very frequent text is no window of one task.
    """
    new = queries.where(F.col("query").isNotNull()).join(issued.select("query").distinct(), "query", "left_anti")
    first = new.groupBy("query").agg(F.min(order).alias(order))
    return new.join(first, ["query", order], "left_semi")


def unseen_urls(urls: DataFrame, seen: DataFrame, scope: list[str], limit: int = 3000) -> DataFrame:
    """URLs not yet seen in their scope, as long as fewer than ``limit`` are known there."""
    full = seen.groupBy(*scope).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit)
    fresh = urls.join(seen.select(*scope, "url").distinct(), [*scope, "url"], "left_anti")
    open_ = fresh.join(full.select(*scope), scope, "left_anti")
    return open_.unionByName(urls.join(full.select(*scope), scope, "left_semi"))


def order() -> list[Column]:
    """Smaller priority first, within it the newest; ties by query."""
    return [F.asc("priority"), F.desc("enqueued_at"), F.asc("query")]


def in_order(frontier: DataFrame) -> DataFrame:
    """T1."""
    return frontier.orderBy(*order())


def fan_out(targets: DataFrame, queries: DataFrame, each: bool = False) -> DataFrame:
    """Strategy queries for target pairs (with ``pos``). A query is issued once, so it falls to the first target; ``each``: to all.

    Both sides are a round's strategy, bounded by the settings, not by the data.
    """
    if each:
        return targets.crossJoin(F.broadcast(queries.select("query").distinct()))
    return targets.orderBy("pos").limit(1).crossJoin(F.broadcast(queries.select("query").distinct()))


def static_fallback(open_pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds of the pair's topic."""
    return open_pairs.join(broadcast_if_small(seeds), "topic")


def batch(open_pairs: DataFrame, k: int, order: str = "pos") -> DataFrame:
    """The first ``k`` by configured position."""
    return open_pairs.orderBy(order).limit(k)


def per_group(df: DataFrame, group: list[str], order: str, k: int) -> DataFrame:
    """the first ``k`` of each group."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*group).orderBy(order))).where(F.col("__r") <= k).drop("__r")


def refill(level: int, low: int, amount: int) -> int:
    """How many subtopics to add at this queue level."""
    return amount if level < low else 0


def starving(idle_s: float, idle_cycles: int, done: bool, max_s: float = 180.0, max_cycles: int = 20) -> bool:
    """Whether the fallback is due; it runs once."""
    return not done and (idle_s >= max_s or idle_cycles >= max_cycles)
