"""Record schemas of the engine, as Spark types."""

from __future__ import annotations

from pyspark.sql.types import StructType

BOXES = "array<array<array<int>>>"
OCR = f"boxes {BOXES}, texts array<string>, confs array<double>, avg_conf double, word_count bigint, error string"
QUALITY = (
    "coverage double, legibility double, words bigint, sharpness double, contrast double, char_h_mean double, char_h_cv double, "
    "line_count int, line_angle_std double, clutter_index double, centrality double, border_ratio double, text_density double, "
    "char_density double, lang string, lang_ok boolean, min_side_val int, max_side_val int, aspect_ratio double, has_watermark boolean, "
    "watermark_methods array<string>, watermark_keywords array<string>, watermark_vote_count int"
)
SEMANTIC = "topic_avg double, subtopic_avg double, combined double, min_similarity double, similarities map<string,double>, rejection_reasons array<string>"
TEXT_CONSISTENCY = (
    "passed boolean, topic_similarity double, subtopic_similarity double, combined_similarity double, failed_dims array<string>, "
    "rejection_reasons array<string>, thresholds struct<topic:double,subtopic:double,combined:double>"
)
RECORDS = {
    "subtopic_pair": "topic string, subtopic string",
    "frontier_query": "priority int, enqueued_at timestamp, topic string, subtopic string, query string",
    "candidate": "topic string, subtopic string, query string, path string",
    "ocr": OCR,
    "quality": QUALITY,
    "semantic": SEMANTIC,
    "text_consistency": TEXT_CONSISTENCY,
    "data_item": "image_path string, topic string, subtopic string, source string, is_generated boolean, query string, prompt string, "
    "source_url string, license string, content_sha1 string, shard string, ts double",
    "hash_index": "scope string, path string, hash bigint",
    "round": "round_id bigint, processed bigint, accepted bigint, rejected bigint, pass_rate double, rejection_vector array<double>, "
    "rejection_reason_counts map<string,bigint>, accepted_queries array<string>, rejected_queries array<string>",
    "advantage": "round bigint, text string, timestamp double, metrics struct<pass_rate:double,ocr_conf:double,clip:double,text:double,quality:double>",
    "strategy": "round bigint, timestamp double, advantage string, queries array<string>, rationale string",
    "top_query": "query string, pass_rate double, accepted bigint, checked bigint",
    "topic_count": "topic string, subtopic string, image_count bigint",
    "gen_failure": "image_path string, topic string, subtopic string, prompt string, failure_stage string, failure_reasons array<string>",
    "prompt_plan": "topic string, subtopic string, prompt string",
}


def record(name: str) -> StructType:
    return StructType.fromDDL(RECORDS[name])
