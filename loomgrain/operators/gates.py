"""Gates: every failing code of a stage is reported, as an array of codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.functions.vectors import cosine, rescaled
from loomgrain.thresholds import Minima, QualityGate


def codes(*pairs: tuple[Column, str]) -> Column:
    """The codes whose condition holds, in order; a null condition does not."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in pairs]))


def has_watermark(texts: Column) -> Column:
    """a line names the stock agency."""
    return F.coalesce(F.exists(texts, lambda t: t.rlike("(?i)alamy")), F.lit(False))


def quality_codes(g: QualityGate) -> Column:
    """F1 over the columns of a quality record. Text density counts only where there is no character density."""
    c = F.col
    over = lambda name, most: (c(name) > most) & ~F.isnan(name)  # noqa: E731  NaN would be over every number
    language = ~F.coalesce(c("lang_ok"), F.lit(True)) if not g.languages else ~F.coalesce(c("lang").isin(*g.languages), F.lit(False))
    return codes(
        (c("coverage") < g.min_coverage, "coverage_lt"),
        (c("legibility") < g.min_legibility, "legibility_lt"),
        (c("words") < g.min_words, "words_lt"),
        (c("sharpness") < g.min_sharpness, "sharpness_lt"),
        (c("char_h_mean") < g.min_char_h, "char_h_mean_lt"),
        (over("char_h_cv", g.max_char_h_cv), "char_h_cv_gt"),
        (over("line_angle_std", g.max_line_angle_std), "line_angle_std_gt"),
        (c("centrality") < g.min_centrality, "centrality_lt"),
        (over("border_ratio", g.max_border_ratio), "border_ratio_gt"),
        (c("char_density") < g.min_char_density, "char_density_lt"),
        (c("char_density").isNull() & (c("text_density") < g.min_text_density), "text_density_lt"),
        (over("clutter_index", g.max_clutter), "clutter_gt"),
        (c("contrast") < g.min_contrast, "contrast_lt"),
        (c("min_side_val") < g.min_side, "min_side_lt"),
        (c("max_side_val") > g.max_side, "max_side_gt"),
        (c("aspect_ratio") < g.min_ar, "ar_lt"),
        (over("aspect_ratio", g.max_ar), "ar_gt"),
        (c("has_watermark") & F.lit(g.watermark), "has_watermark"),
        (language & F.lit(g.require_language), "lang_not_allowed"),
    )


def vector_codes(vector: Column, prompts: dict[str, list[Column]], minima: Minima, stage: str) -> Column:
    """F4 (``semantic``: mean of the rescaled cosines) and F5 (``text``: greatest raw cosine) per dimension.

    A stage that is switched off passes everything (F6); a missing vector fails
    with ``<stage>_error``.
    """
    if not minima.enabled:
        return F.array().cast("array<string>")
    conds = []
    for dim, vectors in prompts.items():
        cos = [cosine(vector, v) for v in vectors]
        score = sum((rescaled(x) for x in cos[1:]), rescaled(cos[0])) / len(cos) if stage == "semantic" else (F.greatest(*cos) if len(cos) > 1 else cos[0])
        conds.append((score < getattr(minima, dim), f"{stage}_{dim}_fail"))
    return F.when(vector.isNull(), F.array(F.lit(f"{stage}_error"))).otherwise(codes(*conds))


def first_failing(*stages: Column) -> Column:
    """The codes of the first stage that has any: later stages do not run. Empty: accepted."""
    out = F.array().cast("array<string>")
    for s in reversed(stages):
        out = F.when(F.size(s) > 0, s).otherwise(out)
    return out


def latest_quality(quality: DataFrame) -> DataFrame:
    """One row per item_id, that of its latest assessment; a null time is the earliest.

    Of rows of the same time the greatest by its values holds: repeated rows count once.
    """
    value = [c for c in quality.columns if c not in ("item_id", "assessed_at")]
    row = F.struct(F.coalesce("assessed_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("assessed_at"), *value)
    rows = quality.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.max(row).alias("q"))
    return rows.select("item_id", "q.*")


def accept_rates(outcomes: DataFrame, *by: str) -> DataFrame:
    """A2 by group: rows, accepted rows and their share, from a column ``reasons``."""
    n, ok = F.count(F.lit(1)), F.count_if(F.size("reasons") == 0)
    return outcomes.groupBy(*by).agg(n.alias("checked"), ok.alias("accepted"), (ok / n).alias("accept_rate"))
