"""Score cutoffs that keep a target fraction of each source (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.llm.ranked import group_offsets, kth_rows, range_sorted
from loomgrain.llm.textkeys import letters_digits
from loomgrain.runtime import broadcast_if_small, staged


def latest_scores(quality: DataFrame, score: str = "legibility") -> DataFrame:
    """(item_id, score) of each item's latest assessment, where it is a number from 0 to 1.

    An assessment without a time counts as the earliest; of several at the same
    time the greatest score holds (null lowest, NaN highest: then not a number).
    Rows without item_id are left out.
    """
    at = F.coalesce(F.col("assessed_at"), F.lit("0001-01-01").cast("timestamp_ntz"))
    rows = quality.where(F.col("item_id").isNotNull()).select("item_id", at.alias("at"), F.col(score).alias("score"))
    best = rows.groupBy("item_id", "at").agg(F.max("score").alias("score"))
    # one shuffle by item_id serves both levels: (item_id, at) is aggregated first, then its maximum
    best = best.groupBy("item_id").agg(F.max_by("score", "at").alias("score"))
    return best.where(F.col("score").between(0.0, 1.0) & ~F.isnan("score"))


def scored_items(items: DataFrame, quality: DataFrame) -> DataFrame:
    """(topic, score, item_id) of the scored items, topic by letters and digits only."""
    topic = letters_digits(F.col("topic"))
    left = items.select("item_id", topic.alias("topic")).where(F.col("topic").isNotNull() & F.col("item_id").isNotNull())
    return left.join(latest_scores(quality), "item_id").select("topic", "score", "item_id")


def cutoffs(items: DataFrame, quality: DataFrame, targets: DataFrame, name: str = "cutoff") -> tuple[DataFrame, DataFrame]:
    """(kept items, report).

    ``items`` (item_id, topic), ``quality`` (item_id, assessed_at, legibility),
    ``targets`` (topic, keep_permille).  Of the n scored items of a topic the
    cutoff is the k-th highest score, k = n * keep_permille / 1000 rounded up;
    items at or above it are kept, so ties at the cutoff are all kept.

    The scored rows are range-sorted by (topic, score), counted per partition
    and topic, and prefix sums locate the one row that is the cutoff.

    Nulls: a null topic, item or score is not scored.  Topics without a target
    or with a target of 0 keep nothing.  An empty table gives empty results.
    Other columns of the inputs are ignored.  Report: topic (as in the target),
    keep_permille, cutoff, n_scored, n_kept; cutoff is null where nothing is
    scored or wanted.
    """
    goal = targets.where(F.col("topic").isNotNull() & F.col("keep_permille").isNotNull())
    goal = goal.groupBy(letters_digits(F.col("topic")).alias("topic")).agg(F.min("topic").alias("label"), F.max("keep_permille").alias("keep_permille"))
    rows = range_sorted(scored_items(items, quality), [F.col("topic").asc(), F.col("score").desc(), F.col("item_id").asc()], name)
    offsets = group_offsets(rows, ["topic"])
    n = offsets.groupBy("topic").agg(F.sum("__n").alias("n_scored"))
    k = n.join(goal, "topic").withColumn("k", F.expr("(n_scored * keep_permille + 999) div 1000"))
    found = kth_rows(rows, offsets, broadcast_if_small(k.select("topic", "k")), ["topic"], "k")
    cut = staged(found.select("topic", F.col("score").alias("cutoff")), name + "-rows")
    small = broadcast_if_small(cut)
    kept = rows.select("item_id", "topic", "score").join(small, "topic").where(F.col("score") >= F.col("cutoff"))
    sizes = kept.groupBy("topic").agg(F.count(F.lit(1)).alias("n_kept"))
    report = (
        goal.join(n, "topic", "left").join(cut, "topic", "left").join(sizes, "topic", "left")
        .select(F.col("label").alias("topic"), "keep_permille", "cutoff", F.coalesce("n_scored", F.lit(0)).cast("bigint").alias("n_scored"), F.coalesce("n_kept", F.lit(0)).cast("bigint").alias("n_kept"))
    )
    return kept.select("item_id"), report
