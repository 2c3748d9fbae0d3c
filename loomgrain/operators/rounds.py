"""Rounds of outcomes, their rejection vectors and metric averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrain.functions.text import advantage_text
from loomgrain.operators.ordering import numbered

# The canonical labels of quality codes, in the order of the vector.
QUALITY_LABELS = (
    "quality_error", "quality_resolution_lt", "quality_complexity_lt", "quality_blank_ratio_gt", "quality_coverage_lt", "quality_legibility_lt",
    "quality_words_lt", "quality_sharpness_lt", "quality_char_h_mean_lt", "quality_char_h_cv_gt", "quality_line_angle_std_gt",
    "quality_centrality_lt", "quality_border_ratio_gt", "quality_char_density_lt", "quality_text_density_lt", "quality_clutter_gt",
    "quality_contrast_lt", "quality_lang_not_allowed",
)
STAGE_LABELS = tuple(f"{s}_{d}" for s in ("semantic", "text") for d in ("topic_fail", "subtopic_fail", "combined_fail", "error"))
LABELS = ("ocr_failure", "dedup_failure", *QUALITY_LABELS, *STAGE_LABELS)
SYNONYMS = {"legacy_reject": "quality_error", "quality_reject": "quality_error", "quality_error": "quality_error"}
# The metrics of a quality record that are averaged.
METRICS = (
    "coverage", "legibility", "words", "sharpness", "contrast", "char_h_mean", "char_h_cv", "line_angle_std",
    "clutter_index", "centrality", "border_ratio", "char_density", "text_density",
)


def label(reason: Column) -> Column:
    """Canonical label of a reason, null if it has none."""
    known = [F.lit(x) for q in QUALITY_LABELS[1:] for x in (q.removeprefix("quality_"), q)]
    known += [F.lit(x) for kv in SYNONYMS.items() for x in kv]
    return (
        F.when(reason.startswith("ocr"), "ocr_failure").when(reason.startswith("dedup"), "dedup_failure")
        .otherwise(F.coalesce(F.try_element_at(F.create_map(*known), reason), F.when(reason.isin(*LABELS), reason)))
    )


def labels(reasons: Column) -> Column:
    """A3: labels of a rejected sample; ``quality_error`` if none can be mapped, empty for an accepted one."""
    mapped = F.array_compact(F.transform(reasons, label))
    return F.when(F.size(reasons) == 0, F.array().cast("array<string>")).otherwise(F.when(F.size(mapped) == 0, F.array(F.lit("quality_error"))).otherwise(mapped))


def with_rounds(outcomes: DataFrame, order: str, size: int = 1000) -> DataFrame:
    """Adds round_id, one per ``size`` outcomes in ``order`` (unique); the last may be short."""
    n = numbered(outcomes, [F.col(order).asc()], "seq", name="rounds")
    return n.withColumn("round_id", F.expr(f"(seq - 1) div {int(size)} + 1"))


def summary(rounds: DataFrame) -> DataFrame:
    """A2: processed, accepted, rejected and pass rate of each round."""
    n, ok = F.count(F.lit(1)), F.count_if(F.size("reasons") == 0)
    return rounds.groupBy("round_id").agg(n.alias("processed"), ok.alias("accepted"), (n - ok).alias("rejected"), F.round(ok / n, 6).alias("pass_rate"))


def rejection_vector(rounds: DataFrame) -> DataFrame:
    """A4: (round_id, label, share), every label of every round.

    A rejected sample hands out 100 / rejected equally over its labels; the label
    ``total_rejection_reason_count`` holds the number of labels.
    """
    bad = rounds.where(F.size("reasons") > 0).withColumn("labels", labels(F.col("reasons")))
    per = bad.select("round_id", F.size("labels").alias("n"), F.explode("labels").alias("label"))
    parts = per.groupBy("round_id", "label").agg(F.sum(F.lit(1.0) / F.col("n")).alias("parts"), F.count(F.lit(1)).alias("k"))
    n = bad.groupBy("round_id").agg(F.count(F.lit(1)).alias("rejected"))
    every = rounds.select("round_id").distinct().crossJoin(F.broadcast(rounds.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")))
    share = every.join(parts, ["round_id", "label"], "left").join(n, "round_id", "left")
    share = share.select("round_id", "label", F.round(F.coalesce(100.0 * F.col("parts") / F.col("rejected"), F.lit(0.0)), 6).alias("share"))
    total = every.select("round_id").distinct().join(parts.groupBy("round_id").agg(F.sum("k").cast("double").alias("share")), "round_id", "left")
    return share.unionByName(total.select("round_id", F.lit("total_rejection_reason_count").alias("label"), F.coalesce("share", F.lit(0.0)).alias("share")))


def metric_means(rounds: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """A5: means over the samples that have the metric, 0 if none has."""
    real = lambda m: F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double"))
    return rounds.groupBy("round_id").agg(*[F.round(F.coalesce(F.avg(real(m)), F.lit(0.0)), 6).alias(m) for m in metrics])


def trend(summaries: DataFrame) -> DataFrame:
    """Pass rate against the round before. One row per round: a table that is small whatever the outcomes."""
    before = F.lag("pass_rate").over(W.orderBy("round_id"))
    x = summaries.withColumn("before", before)
    none = F.lit(None).cast("double")
    return x.select("round_id", "pass_rate", "before", F.when(F.col("pass_rate") >= F.col("before"), "up").when(F.col("before").isNotNull(), "down").alias("trend"), advantage_text(F.col("pass_rate"), F.col("before"), none, none, none).alias("advantage"))


def top_reasons(rounds: DataFrame, k: int = 7) -> DataFrame:
    """The ``k`` most frequent labels of each round, ties by name."""
    n = rounds.select("round_id", F.explode(labels(F.col("reasons"))).alias("label")).groupBy("round_id", "label").agg(F.count(F.lit(1)).alias("n"))
    pos = F.row_number().over(W.partitionBy("round_id").orderBy(F.desc("n"), "label"))  # at most 28 labels a round
    return n.withColumn("pos", pos).where(F.col("pos") <= k)


def query_lists(rounds: DataFrame) -> DataFrame:
    """Sorted distinct queries of accepted and of rejected samples, without blanks. Sized by a round."""
    q = F.when(F.col("query") != "", F.col("query"))
    ok = F.size("reasons") == 0
    return rounds.groupBy("round_id").agg(F.array_sort(F.collect_set(F.when(ok, q))).alias("accepted_queries"), F.array_sort(F.collect_set(F.when(~ok, q))).alias("rejected_queries"))


def reason_report(outcomes: DataFrame, order: str, path: str, examples: int = 6) -> DataFrame:
    """A1: per reason the number of samples and up to ``examples`` paths, first in ``order`` first.

    Examples are picked per reason through partial aggregates of bounded size,
    not by sorting a reason's samples in one task.
    """
    each = outcomes.select(F.explode("reasons").alias("reason"), F.struct(F.col(order).alias("o"), F.col(path).alias("p")).alias("x"))
    # a salt keeps a frequent reason from meeting in one task before it is cut to a few rows
    salted = each.withColumn("salt", F.pmod(F.xxhash64("x.o"), F.lit(64)))
    n = salted.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(W.partitionBy("reason", "salt").orderBy("x.o", "x.p"))
    few = salted.withColumn("r", first).where(F.col("r") <= examples)
    top = few.groupBy("reason").agg(F.slice(F.array_sort(F.collect_list("x")), 1, examples).alias("x"))
    return n.join(top, "reason").select("reason", "n", F.col("x.p").alias("examples"))


def first_sample(rounds: DataFrame, order: str = "seq") -> DataFrame:
    """Topic and subtopic of each round's first sample, accepted ones before rejected ones."""
    rank = F.struct((F.size("reasons") > 0).cast("int").alias("rejected"), F.col(order).alias("o"))
    return rounds.groupBy("round_id").agg(F.min_by(F.struct("topic", "subtopic"), rank).alias("x")).select("round_id", "x.*")


def flat_stats(payload: Column) -> list[Column]:
    """The columns a critic reads of a round's payload (JSON text), 0 or empty where missing."""
    number = lambda p: F.coalesce(F.get_json_object(payload, f"$.{p}").try_cast("double"), F.lit(0.0))
    return [
        number("round_id").cast("bigint").alias("round"), number("pass_rate").alias("pass_rate"), number("metrics.avg_ocr_conf").alias("ocr_conf"),
        number("metrics.semantic.combined").alias("clip"), number("metrics.text_consistency.combined_similarity").alias("text"),
        F.coalesce(F.from_json(F.get_json_object(payload, "$.rejection_vector"), "array<double>"), F.array().cast("array<double>")).alias("vector"),
    ]
