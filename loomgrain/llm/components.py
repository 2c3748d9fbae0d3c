"""Connected components of link tables that no single task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.runtime import broadcast_if_small, staged


def _with_min(edges: DataFrame, name: str) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours.

    The minimum is pre-aggregated and staged: a few rows are broadcast, many are joined
    as a plain table, which the adaptive planner splits for a vertex with very many neighbours (it does not split what it aggregates).
    """
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), name)
    return edges.join(broadcast_if_small(least), "u")


def _mark(edges: DataFrame) -> tuple:
    """What a link table is recognised by: rows and two sums over them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("u", "v").cast("bigint"))).first())


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(item_id, first_id) for every vertex but the least of its component; first_id is that least one.

    ``links``: columns a, b (bigint).  Alternating large-star and small-star
    steps; every round is staged, so the lineage stays short, and the number of rounds grows with the logarithm
    of the largest distance.  Nulls and loops are ignored; an empty table gives no rows.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    edges = links.where(F.col("a") != F.col("b")).select(hi.alias("u"), lo.alias("v")).distinct()
    edges = staged(edges, f"{name}-0")
    mark, n = _mark(edges), 0
    while True:
        n += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both, f"{name}-large-{n}").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, f"{name}-linked-{n}")
        x = _with_min(large, f"{name}-small-{n}")  # all links lead from the greater to the lesser vertex
        small = x.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(x.select("u", F.col("m").alias("v"))).distinct()
        edges = staged(small, f"{name}-{n}")
        now = _mark(edges)
        if now == mark:
            return edges.select(F.col("u").alias("item_id"), F.col("v").alias("first_id"))
        mark = now
