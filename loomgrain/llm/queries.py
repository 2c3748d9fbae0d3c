"""The pN_ queries of this subpackage: each runs its operator over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.llm import canonical, cutoffs, encoding, history, languages, mixing, proportional, truncation
from loomgrain.runtime import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.found_duplicates(load(spark, sf_dir, "data_item", "item_id", "query", "prompt"))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.record_counts(load(spark, sf_dir, "data_item", "item_id", "query", "prompt"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "data_item", "item_id", "batch_no", "content_sha1", "shard", "image_path")
    return history.repeats(items, load(spark, sf_dir, "hash_index", "item_id", "hash"))


def _p4(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return cutoffs.cutoffs(
        load(spark, sf_dir, "data_item", "item_id", "topic"),
        load(spark, sf_dir, "quality_record", "item_id", "assessed_at", "legibility"),
        load(spark, sf_dir, "keep_target"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p4(spark, sf_dir)[0]


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p4(spark, sf_dir)[1]


def _p5(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, sf_dir, "ocr_record", "item_id", "texts"), load(spark, sf_dir, "documents", "doc_id", "text", "lang")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ocr, docs = _p5(spark, sf_dir)
    quality = load(spark, sf_dir, "quality_record", "item_id", "assessed_at", "lang")
    return languages.relabelled(ocr, quality, docs).select("item_id", "first_line", "lang")


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All segments of all records, with their confidence."""
    return languages.record_segments(*_p5(spark, sf_dir)).selectExpr("item_id", "inline(segments)")


def _p6(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, sf_dir, "data_item", "item_id", "topic", "subtopic", "is_generated"), load(spark, sf_dir, "sample_target")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proportional.shortfalls(*_p6(spark, sf_dir))


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proportional.sample(*_p6(spark, sf_dir))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the sample by category."""
    return p6_sample(spark, sf_dir).groupBy("topic", "subtopic", "is_generated").agg(F.count(F.lit(1)).alias("n"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = proportional.allocate(*_p6(spark, sf_dir))
    return out.select("topic", "subtopic", "is_generated", "wanted", "available", "allocated", "short", "unmet")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.token_ids(load(spark, sf_dir, "documents", "doc_id", "text"))


def _p8(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(load(spark, sf_dir, "documents", "doc_id", "text", "source"), load(spark, sf_dir, "mix_target"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p8(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p8(spark, sf_dir)[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.found_cut(load(spark, sf_dir, "documents", "doc_id", "text", "source"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_rates(load(spark, sf_dir, "documents", "doc_id", "text", "source"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_records, p3_found, p4_found, p4_report, p5_found, p5_segments, p6_found, p6_sample, p6_counts, p6_report, p7_ids, p8_mix, p8_shares, p9_found, p9_rates)
}
