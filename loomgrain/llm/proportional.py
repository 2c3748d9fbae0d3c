"""Samples that match target category proportions (problem 6).

The quota is handed down a category tree (topic / subtopic / is_generated);
what a leaf cannot fill goes to its siblings, then to its cousins, then to the
rest of the tree.  Leaves are drawn by the rank of a pseudo-random permutation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrain.llm.ranked import group_offsets, range_sorted, with_rank
from loomgrain.llm.textkeys import letters_digits
from loomgrain.runtime import broadcast_if_small, staged

LEAF = ["t", "s", "g"]


def _leaf_columns(df: DataFrame, *rest) -> DataFrame:
    return df.select(letters_digits(F.col("topic")).alias("t"), letters_digits(F.col("subtopic")).alias("s"), F.col("is_generated").cast("int").alias("g"), *rest)


def leaf_counts(items: DataFrame) -> DataFrame:
    """(t, s, g, available), pre-aggregated by the spellings as they stand; rows with a null in any are left out."""
    raw = items.groupBy("topic", "subtopic", "is_generated").agg(F.count(F.lit(1)).alias("n"))
    return _leaf_columns(raw, "n").where(F.col("t").isNotNull() & F.col("s").isNotNull() & F.col("g").isNotNull()).groupBy(*LEAF).agg(F.sum("n").alias("available"))


def _pass_on(leaves: DataFrame, scope: list[str]) -> DataFrame:
    """Hands the unmet quota of each ``scope`` to its leaves with rows to spare, in proportion to these.

    Largest remainder, ties by name: no leaf gets more than it can spare, since
    what is handed out never exceeds the spare rows of the scope.
    """
    over = W.partitionBy(*[F.col(c) for c in scope]) if scope else W.partitionBy(F.lit(0))
    spare = F.col("available") - F.col("allocated")
    x = leaves.withColumn("spare", spare).withColumn("spares", F.sum("spare").over(over)).withColumn("unmet", F.sum("open").over(over))
    x = x.withColumn("give", F.least("unmet", "spares"))
    # products of counts need more than 64 bits
    x = x.withColumn("frac", F.when(F.col("spares") > 0, F.expr("cast((cast(give as decimal(19,0)) * cast(spare as decimal(19,0))) % spares as bigint)")).otherwise(F.lit(0)))
    x = x.withColumn("base", F.when(F.col("spares") > 0, F.expr("cast((cast(give as decimal(19,0)) * cast(spare as decimal(19,0)) - frac) / spares as bigint)")).otherwise(F.lit(0)))
    rank = F.row_number().over(over.orderBy(F.col("frac").desc(), *LEAF))
    x = x.withColumn("left", F.col("give") - F.sum("base").over(over))
    x = x.withColumn("gift", F.col("base") + F.when((rank <= F.col("left")) & (F.col("frac") > 0), 1).otherwise(0))
    # the quota handed on is taken off the open leaves, in order of their names
    before = F.coalesce(F.sum("open").over(over.orderBy(*LEAF).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("settled", F.greatest(F.lit(0), F.least(F.col("open"), F.col("give") - before)))
    return x.select(*LEAF, "topic", "subtopic", "is_generated", "wanted", "available", "short", (F.col("allocated") + F.col("gift")).alias("allocated"), (F.col("open") - F.col("settled")).alias("open"))


def allocate(items: DataFrame, targets: DataFrame, permille: int = 100, name: str = "quota") -> DataFrame:
    """One row per target category: wanted, available and allocated rows, ``short``: what its own rows leave open and is handed on, and ``unmet``: what of that no other category could take.

    Wanted is the greater of min_rows and floor(floor(rows * permille / 1000) *
    share_ppm / 1e6), with all rows of ``items``, whatever their category.  The
    tree has one leaf per row of ``targets``; windows over it hold no data rows.
    A target with a null category is left out; null share or minimum count as 0.
    Of targets that differ in spelling only, shares and minima are summed.
    """
    total = items.agg(F.count(F.lit(1)).alias("total"))
    goal = _leaf_columns(targets, "topic", "subtopic", "is_generated", "share_ppm", "min_rows").where(F.col("t").isNotNull() & F.col("s").isNotNull() & F.col("g").isNotNull())
    goal = goal.groupBy(*LEAF).agg(
        F.min("topic").alias("topic"), F.min("subtopic").alias("subtopic"), F.min(F.col("is_generated").cast("int")).alias("is_generated"),
        F.coalesce(F.sum("share_ppm"), F.lit(0)).alias("share_ppm"), F.coalesce(F.sum("min_rows"), F.lit(0)).alias("min_rows"),
    )
    part = f"(total div 1000) * {int(permille)} + ((total % 1000) * {int(permille)}) div 1000"
    size = F.expr(f"({part}) div 1000000 * share_ppm + (({part}) % 1000000 * share_ppm) div 1000000")
    leaves = goal.join(leaf_counts(items), LEAF, "left").crossJoin(F.broadcast(total))
    leaves = leaves.withColumn("available", F.coalesce("available", F.lit(0))).withColumn("wanted", F.greatest(F.col("min_rows").cast("bigint"), size))
    leaves = leaves.withColumn("allocated", F.least("wanted", "available")).withColumn("open", F.col("wanted") - F.col("allocated"))
    leaves = leaves.withColumn("short", F.col("open"))  # what the leaf cannot fill and hands on
    for scope in (["t", "s"], ["t"], []):
        leaves = _pass_on(leaves, scope)
    return staged(leaves.withColumnRenamed("open", "unmet"), name)


def shortfalls(items: DataFrame, targets: DataFrame, permille: int = 100) -> DataFrame:
    """The target categories with fewer rows than wanted: topic, subtopic, is_generated (0 or 1)."""
    return allocate(items, targets, permille).where(F.col("short") > 0).select("topic", "subtopic", "is_generated")


def sample(items: DataFrame, targets: DataFrame, permille: int = 100, seed: int = 0, name: str = "sample") -> DataFrame:
    """(item_id, topic, subtopic, is_generated) of the drawn rows, spelled as in ``targets``.

    Rows are range-sorted by (category, hash of item_id with ``seed``, item_id);
    the first ``allocated`` ranks of each category are drawn, over any number of
    partitions.  Same input and seed: same sample.
    """
    quota = allocate(items, targets, permille, name + "-quota")
    rows = _leaf_columns(items, "item_id").where(F.col("item_id").isNotNull())
    q = quota.select(*LEAF, F.col("topic").alias("topic"), F.col("subtopic").alias("subtopic"), "is_generated", "allocated").where(F.col("allocated") > 0)
    small = broadcast_if_small(q)
    rows = rows.join(small.select(*LEAF), LEAF, "left_semi").withColumn("perm", F.xxhash64(F.lit(seed), "item_id"))
    ordered = range_sorted(rows, [F.col(c).asc() for c in [*LEAF, "perm", "item_id"]], name)
    offsets = group_offsets(ordered, LEAF)
    ranked = with_rank(ordered, broadcast_if_small(offsets), LEAF, "rank")
    return ranked.join(small, LEAF).where(F.col("rank") <= F.col("allocated")).select("item_id", "topic", "subtopic", "is_generated")
