"""Mixing sources to target weights (problem 8).

Weighted fair queueing: each source lines up its shuffled documents, pass after
pass up to its cap of repeats; a document's virtual finish time is the source's
cumulative tokens divided by its weight.  All documents are range-sorted by
finish time and taken until the budget of tokens is spent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.llm.encoding import VOCABULARY, token_counts
from loomgrain.llm.ranked import range_cumulated
from loomgrain.runtime import broadcast_if_small, staged


def mix(
    docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 0,
    vocabulary: str = VOCABULARY, folder: str | None = None, name: str = "mix",
) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    ``docs``: doc_id, text, source; ``targets``: source, weight_permille,
    max_repeat; other columns are ignored.  ``budget`` is the total of tokens,
    by default those of all eligible documents once.  Eligible are documents with
    a doc_id, at least one token, and a source that has a positive weight and cap;
    a document counts as often as it is delivered.

    Mixture: doc_id, source, copy_no (1 .. max_repeat), tokens, start (tokens
    before it in the mixture).  The order is by finish time, then source, pass
    and shuffled rank, so it is the same for the same input and seed.  The last
    document is the last that fits whole.  A source that runs out leaves its
    place to the others.  Report, a row per target: source, weight_permille,
    n_docs, tokens, share_permille (of the mixture's tokens), max_copies, and
    exhausted: all its copies are in the mixture.  Shares are null for an empty mixture.
    """
    goal = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.max("weight_permille").alias("weight_permille"), F.max("max_repeat").alias("max_repeat")
    )
    small = broadcast_if_small(goal)
    line = small.where((F.col("weight_permille") > 0) & (F.col("max_repeat") > 0))
    rows = docs.select("doc_id", "source", "text").where(F.col("doc_id").isNotNull()).join(line.select("source"), "source", "left_semi")
    sized = staged(token_counts(rows, ["doc_id", "source"], vocabulary, folder).where(F.col("tokens") > 0), name + "-tokens")
    if budget is None:
        budget = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    passes = sized.join(line, "source").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("max_repeat"))))
    passes = passes.withColumn("perm", F.xxhash64(F.lit(seed), "doc_id", "copy_no")).select("source", "copy_no", "perm", "doc_id", "tokens", "weight_permille")
    order = ["source", "copy_no", "perm", "doc_id"]
    queued = range_cumulated(passes, [F.col(c).asc() for c in order], ["source"], "tokens", name + "-queues")
    # No document that finishes within the budget can have more tokens of its own source before it.
    queued = queued.where(F.col("total") <= F.lit(budget)).withColumn("finish", F.col("total") / F.col("weight_permille"))
    ready = queued.select("finish", *order, "tokens")
    ordered = range_cumulated(ready, [F.col(c).asc() for c in ["finish", *order]], [], "tokens", name + "-order")
    mixture = ordered.where(F.col("total") <= F.lit(budget)).select("doc_id", "source", "copy_no", "tokens", (F.col("total") - F.col("tokens")).alias("start"))
    got = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").alias("tokens"), F.max("copy_no").alias("max_copies"))
    have = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_have"))
    report = goal.join(got, "source", "left").join(have, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    report = report.crossJoin(F.broadcast(got.agg(F.sum("tokens").alias("all_tokens")))).select(
        "source", "weight_permille", zero("n_docs").alias("n_docs"), zero("tokens").alias("tokens"),
        (1000 * zero("tokens") / F.nullif("all_tokens", F.lit(0))).alias("share_permille"),
        zero("max_copies").alias("max_copies"), (zero("n_docs") >= zero("n_have") * F.col("max_repeat")).alias("exhausted"),
    )
    return mixture, report
