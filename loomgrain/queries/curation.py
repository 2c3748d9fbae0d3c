"""Gates, rounds, memory, allocation, frontier and dedup over the test tables.

Outcomes: each delivered item in order of item_id, with the codes of its latest
assessment by the shipped thresholds; an item without an assessment fails as ``ocr_failed``.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.operators import allocation, dedup, experience, frontier, gates, ordering, rounds, search
from loomgrain.queries.texts import LATEST, _strip
from loomgrain.runtime import load
from loomgrain.thresholds import QualityGate

# The table's densities are per pixel and its clutter runs to 1: two limits are set to its scale.
G = replace(QualityGate.shipped(), min_char_density=0.03, max_clutter=0.8)
TARGET = 60_000  # items wanted by the gap analysis


# What the gate reads of an assessment, without its arrays
_GATED = ("item_id", "assessed_at", *rounds.METRICS, "min_side_val", "max_side_val", "aspect_ratio", "has_watermark", "lang", "lang_ok")


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    q = gates.latest_quality(load(spark, d, "quality_record", *_GATED)).select("item_id", F.lit(True).alias("assessed"), gates.quality_codes(G).alias("codes"), *rounds.METRICS)
    items = load(spark, d, "data_item", "item_id", "image_path", "topic", "subtopic", "source", "query").join(q, "item_id", "left")
    return items.withColumn("reasons", F.when(F.col("assessed"), F.col("codes")).otherwise(F.array(F.lit("ocr_failed"))))


def _over(c: str, most: float) -> str:
    return f"{c} > {most} AND NOT isnan({c})"


def _codes_sql(G: QualityGate = G) -> str:
    pairs = (
        (f"coverage < {G.min_coverage}", "coverage_lt"), (f"legibility < {G.min_legibility}", "legibility_lt"), (f"words < {G.min_words}", "words_lt"),
        (f"sharpness < {G.min_sharpness}", "sharpness_lt"), (f"char_h_mean < {G.min_char_h}", "char_h_mean_lt"), (_over("char_h_cv", G.max_char_h_cv), "char_h_cv_gt"),
        (_over("line_angle_std", G.max_line_angle_std), "line_angle_std_gt"), (f"centrality < {G.min_centrality}", "centrality_lt"),
        (_over("border_ratio", G.max_border_ratio), "border_ratio_gt"), (f"char_density < {G.min_char_density}", "char_density_lt"),
        (f"char_density IS NULL AND text_density < {G.min_text_density}", "text_density_lt"), (_over("clutter_index", G.max_clutter), "clutter_gt"),
        (f"contrast < {G.min_contrast}", "contrast_lt"), (f"min_side_val < {G.min_side}", "min_side_lt"), (f"max_side_val > {G.max_side}", "max_side_gt"),
        (f"aspect_ratio < {G.min_ar}", "ar_lt"), (_over("aspect_ratio", G.max_ar), "ar_gt"), ("has_watermark", "has_watermark"),
    )
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in pairs) + "], lambda x: x IS NOT NULL)"


_LABEL = (
    "CASE WHEN starts_with(x, 'ocr') THEN 'ocr_failure' WHEN starts_with(x, 'dedup') THEN 'dedup_failure' WHEN x IN ("
    + ", ".join(f"'{q.removeprefix('quality_')}'" for q in rounds.QUALITY_LABELS[1:])
    + ") THEN 'quality_' || x END"
)
OUTCOMES = f"""
q AS ({LATEST}), outcomes AS (
  SELECT d.item_id, d.image_path, d.topic, d.subtopic, d.source, d.query, q.* EXCLUDE (item_id, assessed_at),
    CASE WHEN q.item_id IS NULL THEN ['ocr_failed'] ELSE {_codes_sql()} END AS reasons,
    (row_number() OVER (ORDER BY d.item_id) - 1) // 1000 + 1 AS round_id
  FROM data_item d LEFT JOIN q USING (item_id)
), mapped AS (SELECT *, list_filter(list_transform(reasons, lambda x: {_LABEL}), lambda x: x IS NOT NULL) AS m FROM outcomes),
labelled AS (SELECT *, CASE WHEN len(reasons) = 0 THEN [] WHEN len(m) = 0 THEN ['quality_error'] ELSE m END AS labels FROM mapped)
"""


def quality_codes(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).select("item_id", F.array_join("reasons", ",").alias("codes"))


def accept_rate_by_topic(spark: SparkSession, d: str) -> DataFrame:
    x = gates.accept_rates(_outcomes(spark, d), "topic", "source")
    return x.select("topic", "source", "checked", "accepted", F.round("accept_rate", 6).alias("accept_rate"))


def reason_report(spark: SparkSession, d: str) -> DataFrame:
    x = rounds.reason_report(_outcomes(spark, d), "item_id", "image_path")
    return x.select("reason", "n", F.array_join("examples", "\n").alias("examples"))


def _rounds(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Numbered outcomes; only the columns asked for are sorted and staged."""
    return rounds.with_rounds(_outcomes(spark, d).select("item_id", "reasons", *columns), "item_id")


def round_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounds.summary(_rounds(spark, d))


def rejection_vectors(spark: SparkSession, d: str) -> DataFrame:
    return rounds.rejection_vector(_rounds(spark, d))


def round_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounds.metric_means(_rounds(spark, d, *rounds.METRICS))


def round_trend(spark: SparkSession, d: str) -> DataFrame:
    return rounds.trend(round_summary(spark, d)).select("round_id", "trend", "advantage")


def round_top_reasons(spark: SparkSession, d: str) -> DataFrame:
    return rounds.top_reasons(_rounds(spark, d))


def round_queries(spark: SparkSession, d: str) -> DataFrame:
    x = rounds.query_lists(_rounds(spark, d, "query"))
    return x.select("round_id", *[F.array_join(c, "\n").alias(c) for c in ("accepted_queries", "rejected_queries")])


def top_queries(spark: SparkSession, d: str) -> DataFrame:
    """Tallies of the history (all rounds but the last) merged with those of the last round; the best ten."""
    r = _rounds(spark, d, "query").select("round_id", "query", "reasons")
    last = r.agg(F.max("round_id").alias("last"))
    r = r.crossJoin(F.broadcast(last))
    lib = experience.accumulated(experience.tallies(r.where("round_id < last")), experience.tallies(r.where("round_id = last")))
    return experience.top_queries(lib).select("query", F.round("pass_rate", 4).alias("pass_rate"), "accepted", "checked")


def merged_candidates(spark: SparkSession, d: str) -> DataFrame:
    r = _rounds(spark, d, "query", "legibility").where("query IS NOT NULL")
    c = r.select("query", F.col("legibility").alias("score"), F.col("round_id").alias("round"), F.when(F.size("reasons") == 0, "accepted").otherwise("rejected").alias("status"), F.col("item_id").alias("ord"))
    return experience.merged(c.withColumn("score", F.when(~F.isnan("score"), F.col("score"))))


def last_rounds(spark: SparkSession, d: str) -> DataFrame:
    return experience.last_rows(round_summary(spark, d).withColumnRenamed("round_id", "round"), 2)


def split_rows(spark: SparkSession, d: str) -> DataFrame:
    """K2: the first nine tenths of the delivered items by position are the training part, the rest the development part."""
    x = ordering.numbered(load(spark, d, "data_item", "item_id"), [F.col("item_id").asc()], "pos", name="split")
    n = load(spark, d, "data_item", "item_id").agg(F.count(F.lit(1)).alias("n"))
    return x.crossJoin(F.broadcast(n)).select("item_id", F.when(F.col("pos") <= F.floor(F.col("n") * 0.9), "train").otherwise("dev").alias("part"))


def file_names(spark: SparkSession, d: str) -> DataFrame:
    """Sequential names of the accepted items."""
    ok = _outcomes(spark, d).where(F.size("reasons") == 0).select("item_id")
    return ordering.numbered(ok, [F.col("item_id").asc()], "pos", name="names").select("item_id", F.format_string("img_%07d", F.col("pos")).alias("file"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return allocation.pair_counts(load(spark, d, "subtopic_pair"), load(spark, d, "data_item", "topic", "subtopic"))


def pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d)


def coverage_gap(spark: SparkSession, d: str) -> DataFrame:
    return allocation.gap(_counts(spark, d), TARGET)


def allocation_uniform(spark: SparkSession, d: str) -> DataFrame:
    return allocation.uniform(_counts(spark, d), 1000)


def allocation_inverse(spark: SparkSession, d: str) -> DataFrame:
    return allocation.inverse(_counts(spark, d), 1000)


def allocation_shrunk(spark: SparkSession, d: str) -> DataFrame:
    x = _counts(spark, d).select("topic", "subtopic", F.greatest(F.lit(0), F.lit(400) - F.col("image_count")).alias("need"))
    return allocation.scaled(x, 777)


def allocation_capped(spark: SparkSession, d: str) -> DataFrame:
    """More is wanted than the needs sum to, with room for 50 in each category."""
    x = _counts(spark, d).select("topic", "subtopic", F.lit(7).cast("bigint").alias("need"), F.lit(50).cast("bigint").alias("room"))
    return allocation.scaled(x, 3000)


def remaining_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of which nothing has been delivered in their proper spelling."""
    return frontier.remaining(load(spark, d, "subtopic_pair"), load(spark, d, "data_item", "topic", "subtopic"))


def first_issues(spark: SparkSession, d: str) -> DataFrame:
    """Queries of the later batches that the history did not have, each once."""
    rows = load(spark, d, "data_item", "item_id", "query", "batch_no")
    return frontier.not_issued(rows.where("batch_no >= 1"), rows.where("batch_no = 0"), "item_id").select("item_id", "query")


def frontier_order(spark: SparkSession, d: str) -> DataFrame:
    """The place of every query in the frontier: generated ones first, then the newest."""
    rows = load(spark, d, "data_item", "item_id", "query", "is_generated", "ingested_at").where("query IS NOT NULL AND is_generated IS NOT NULL")
    x = rows.select("item_id", F.concat("query", F.lit("#"), F.col("item_id").cast("string")).alias("query"), F.when(F.col("is_generated"), 1).otherwise(10).alias("priority"), F.col("ingested_at").alias("enqueued_at"))
    return ordering.numbered(x, frontier.order(), "place", name="frontier").select("item_id", "priority", "place")


def query_variants(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "data_item", "item_id", "query", "prompt", "subtopic").where("subtopic IS NOT NULL")
    v = frontier.variants(F.array_compact(F.array("query")), F.array_compact(F.array("prompt", "query")), F.col("subtopic"))
    return x.select("item_id", F.size(v).cast("bigint").alias("n"), F.array_join(v, "\n").alias("variants"))


def near_pairs(spark: SparkSession, d: str) -> DataFrame:
    """J1 between class representatives: each distinct hash by its smallest item_id."""
    reps = dedup.representatives(load(spark, d, "hash_index", "item_id", "hash"), [], "item_id")
    return dedup.near_pairs(reps, []).withColumn("distance", F.col("distance").cast("int"))


def near_classes(spark: SparkSession, d: str) -> DataFrame:
    """Membership: each item with its representative and the links of that."""
    rows = load(spark, d, "hash_index", "item_id", "hash").where("hash IS NOT NULL")
    reps = dedup.representatives(rows, [], "item_id")
    p = dedup.near_pairs(reps, [])
    links = p.select("a").unionAll(p.select("b")).groupBy(F.col("a").alias("first")).agg(F.count(F.lit(1)).alias("n_links"))
    return rows.join(reps, "hash").join(links, "first", "left").select("item_id", F.col("first").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_first(spark: SparkSession, d: str) -> DataFrame:
    """G1 over the whole index, in order of item_id; dup_of is -1 for rows that are kept."""
    return dedup.keep_first(load(spark, d, "hash_index", "item_id", "hash"), [], "item_id").withColumn("dup_of", F.coalesce("dup_of", F.lit(-1)))


def keep_first_by_topic(spark: SparkSession, d: str) -> DataFrame:
    """G1, G2 within the scope; items that the quality gate rejects release their place."""
    q = gates.latest_quality(load(spark, d, "quality_record", *_GATED)).select("item_id", (F.size(gates.quality_codes(G)) > 0).alias("rejected"))
    rows = load(spark, d, "hash_index", "item_id", "hash", "scope").where("scope IS NOT NULL").join(q, "item_id", "left")
    return dedup.keep_first(rows, ["scope"], "item_id", releases="rejected").withColumn("dup_of", F.coalesce("dup_of", F.lit(-1)))


def index_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.cleaned(load(spark, d, "hash_index", "item_id", "scope", "hash"), ["scope"], "item_id").select("item_id")


def dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "hash_index", "item_id", "scope")
    return dedup.stats(keep_first(spark, d).withColumn("dup_of", F.nullif("dup_of", F.lit(-1))).join(rows, "item_id"), "scope")


def exact_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of equal texts by their SHA-1."""
    x = load(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select(F.sha1("text").alias("sha1"), "doc_id")
    return x.groupBy("sha1").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def centroid_gate(spark: SparkSession, d: str) -> DataFrame:
    x = search.centroid_gate(load(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.55)
    return x.select("vec_id", F.round("score", 6).alias("score"), "passed")


def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 20, among all."""
    e = load(spark, d, "embeddings")
    return search.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding")


QUERIES = {
    f.__name__: f
    for f in (
        quality_codes, accept_rate_by_topic, reason_report, round_summary, rejection_vectors, round_metrics, round_trend, round_top_reasons, round_queries,
        top_queries, merged_candidates, last_rounds, split_rows, file_names, pair_counts, coverage_gap, allocation_uniform, allocation_inverse,
        allocation_shrunk, allocation_capped, remaining_pairs, first_issues, frontier_order, query_variants, near_pairs, near_classes, keep_first,
        keep_first_by_topic, index_cleanup, dedup_stats, exact_groups, centroid_gate, nearest_vectors,
    )
}

_W = "WITH " + OUTCOMES
_SUM = "SELECT round_id, count(*) AS processed, count(*) FILTER (WHERE len(reasons) = 0) AS accepted, count(*) FILTER (WHERE len(reasons) > 0) AS rejected, round(count(*) FILTER (WHERE len(reasons) = 0) / count(*), 6) AS pass_rate FROM outcomes GROUP BY round_id"
_COUNTS = "SELECT p.topic, p.subtopic, count(d.item_id) AS image_count FROM subtopic_pair p LEFT JOIN data_item d ON d.topic = p.topic AND d.subtopic = p.subtopic GROUP BY ALL"
_REPS = "reps AS (SELECT hash, min(item_id) AS i FROM hash_index WHERE hash IS NOT NULL GROUP BY hash), pairs AS (SELECT a.i AS a, b.i AS b, CAST(bit_count(xor(a.hash, b.hash)) AS INT) AS distance FROM reps a JOIN reps b ON a.i < b.i AND bit_count(xor(a.hash, b.hash)) <= 3)"
_NAMES = ", ".join(f"('{x}')" for x in rounds.LABELS)
_REAL = lambda m: f"round(coalesce(avg({m}) FILTER (WHERE {m} IS NOT NULL AND NOT isnan({m}::DOUBLE)), 0.0), 6) AS {m}"
# Greedy first-keep: only holders of a hash with a neighbour are decided one after another, in order; ``r`` are all hashed rows (s, i, h, free).
_KEPT = """
holder AS (SELECT s, h, min(i) AS i FROM r WHERE NOT free GROUP BY s, h),
near AS (SELECT x.i AS a, y.i AS b FROM holder x JOIN holder y ON x.s IS NOT DISTINCT FROM y.s AND x.i < y.i AND bit_count(xor(x.h, y.h)) <= 3),
node AS (SELECT i, row_number() OVER (ORDER BY i) AS k FROM (SELECT a AS i FROM near UNION SELECT b FROM near)),
before AS (SELECT n.k, n.i, coalesce((SELECT list(a) FROM near WHERE b = n.i), []) AS l FROM node n),
step AS (
  SELECT 0::BIGINT AS k, []::BIGINT[] AS kept
  UNION ALL SELECT b.k, CASE WHEN list_has_any(step.kept, b.l) THEN step.kept ELSE list_append(step.kept, b.i) END FROM step JOIN before b ON b.k = step.k + 1
), kept AS (SELECT unnest(kept) AS i FROM step WHERE k = (SELECT max(k) FROM step)),
taken AS (SELECT * FROM holder WHERE i NOT IN (SELECT i FROM node) OR i IN (SELECT i FROM kept)),
dup AS (SELECT r.i, min(t.i) AS dup_of FROM r JOIN taken t ON r.s IS NOT DISTINCT FROM t.s AND t.i < r.i AND bit_count(xor(r.h, t.h)) <= 3 GROUP BY r.i)
"""
_KEEP_FIRST = f"WITH RECURSIVE r AS (SELECT 0 AS s, item_id AS i, hash AS h, false AS free FROM hash_index WHERE hash IS NOT NULL), {_KEPT} SELECT item_id, coalesce(dup_of, -1) AS dup_of FROM hash_index LEFT JOIN dup ON i = item_id"
SQL = {
    "keep_first": _KEEP_FIRST,
    "keep_first_by_topic": f"WITH RECURSIVE q AS ({LATEST}), j AS (SELECT h.item_id, h.scope, h.hash, coalesce(len({_codes_sql()}) > 0, false) AS free FROM hash_index h LEFT JOIN q USING (item_id) WHERE h.scope IS NOT NULL), r AS (SELECT scope AS s, item_id AS i, hash AS h, free FROM j WHERE hash IS NOT NULL), {_KEPT} SELECT item_id, coalesce(dup_of, -1) AS dup_of FROM j LEFT JOIN dup ON i = item_id",
    "dedup_stats": f"SELECT scope, count(*) AS total_processed, count(nullif(dup_of, -1)) AS duplicates_found FROM ({_KEEP_FIRST}) JOIN hash_index USING (item_id) GROUP BY scope",
    # what is missing is handed out evenly here: all needs are equal and no room is reached
    "allocation_capped": f"WITH c AS ({_COUNTS}) SELECT topic, subtopic, 7 + (3000 - 7 * count(*) OVER ()) // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY topic DESC, subtopic DESC) <= (3000 - 7 * count(*) OVER ()) % count(*) OVER () THEN 1 ELSE 0 END AS need FROM c",
    "quality_codes": _W + "SELECT item_id, array_to_string(reasons, ',') AS codes FROM outcomes",
    "accept_rate_by_topic": _W + "SELECT topic, source, count(*) AS checked, count(*) FILTER (WHERE len(reasons) = 0) AS accepted, round(count(*) FILTER (WHERE len(reasons) = 0) / count(*), 6) AS accept_rate FROM outcomes GROUP BY topic, source",
    "reason_report": _W + ", e AS (SELECT unnest(reasons) AS reason, item_id, image_path FROM outcomes), r AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY item_id) AS k FROM e) SELECT reason, count(*) AS n, string_agg(image_path, chr(10) ORDER BY item_id) FILTER (WHERE k <= 6) AS examples FROM r GROUP BY reason",
    "round_summary": _W + _SUM,
    "rejection_vectors": _W + f""", bad AS (SELECT round_id, len(labels) AS n, unnest(labels) AS label FROM labelled WHERE len(labels) > 0),
      rej AS (SELECT round_id, count(*) AS rejected FROM labelled WHERE len(labels) > 0 GROUP BY round_id), r AS (SELECT DISTINCT round_id FROM outcomes),
      p AS (SELECT round_id, label, sum(1.0 / n) AS parts FROM bad GROUP BY ALL)
      SELECT r.round_id, l.label, round(coalesce(100.0 * parts / rejected, 0.0), 6) AS share FROM r CROSS JOIN (VALUES {_NAMES}) l(label) LEFT JOIN p ON p.round_id = r.round_id AND p.label = l.label LEFT JOIN rej ON rej.round_id = r.round_id
      UNION ALL SELECT r.round_id, 'total_rejection_reason_count', coalesce((SELECT count(*) FROM bad WHERE bad.round_id = r.round_id), 0)::DOUBLE FROM r""",
    "round_metrics": _W + "SELECT round_id, " + ", ".join(map(_REAL, rounds.METRICS)) + " FROM outcomes GROUP BY round_id",
    "round_trend": _W + f", s AS ({_SUM}), t AS (SELECT round_id, pass_rate AS p, lag(pass_rate) OVER (ORDER BY round_id) AS b FROM s) SELECT round_id, CASE WHEN p >= b THEN 'up' WHEN b IS NOT NULL THEN 'down' END AS trend, CASE WHEN b IS NULL THEN '' ELSE 'Pass rate ' || CASE WHEN p >= b THEN 'up ' ELSE 'down ' END || printf('%.3f', abs(p - b)) || '; ' END || 'OCR avg=None; CLIP=None; Text consistency=None. Suggestion: raise clarity thresholds, emphasise high resolution, topic keywords, and readable text.' AS advantage FROM t",
    "round_top_reasons": _W + ", e AS (SELECT round_id, unnest(labels) AS label FROM labelled), n AS (SELECT round_id, label, count(*) AS n FROM e GROUP BY ALL) SELECT round_id, label, n, CAST(pos AS INT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY round_id ORDER BY n DESC, label) AS pos FROM n) WHERE pos <= 7",
    "round_queries": _W + ", x AS (SELECT DISTINCT round_id, len(reasons) = 0 AS ok, query FROM outcomes WHERE query <> ''), r AS (SELECT DISTINCT round_id FROM outcomes) SELECT r.round_id, coalesce(string_agg(query, chr(10) ORDER BY encode(query)) FILTER (WHERE ok), '') AS accepted_queries, coalesce(string_agg(query, chr(10) ORDER BY encode(query)) FILTER (WHERE NOT ok), '') AS rejected_queries FROM r LEFT JOIN x USING (round_id) GROUP BY r.round_id",
    "top_queries": _W + ", t AS (SELECT query, count(*) FILTER (WHERE len(reasons) = 0) AS accepted, count(*) AS checked, bool_or(round_id = (SELECT max(round_id) FROM outcomes)) AS cur FROM outcomes WHERE query IS NOT NULL AND query <> '' GROUP BY query) SELECT query, round(accepted / checked, 4) AS pass_rate, accepted, checked FROM t ORDER BY accepted / checked DESC, cur DESC, accepted DESC, encode(query) LIMIT 10",
    "merged_candidates": _W + "SELECT query, max(CASE WHEN NOT isnan(legibility) THEN legibility END) AS score, arg_max(round_id, item_id) AS round, arg_max(CASE WHEN len(reasons) = 0 THEN 'accepted' ELSE 'rejected' END, item_id) AS status FROM outcomes WHERE query IS NOT NULL GROUP BY query",
    "last_rounds": _W + f"SELECT round_id AS round, * EXCLUDE round_id FROM ({_SUM}) ORDER BY round_id DESC LIMIT 2",
    "split_rows": "SELECT item_id, CASE WHEN row_number() OVER (ORDER BY item_id) <= floor((SELECT count(*) FROM data_item) * 0.9) THEN 'train' ELSE 'dev' END AS part FROM data_item",
    "file_names": _W + "SELECT item_id, printf('img_%07d', row_number() OVER (ORDER BY item_id)) AS file FROM outcomes WHERE len(reasons) = 0",
    "pair_counts": _COUNTS,
    "coverage_gap": f"SELECT sum(image_count)::BIGINT AS current_total, greatest(0, {TARGET} - sum(image_count))::BIGINT AS gap FROM ({_COUNTS})",
    "allocation_uniform": f"SELECT topic, subtopic, (1000 // n + CASE WHEN pos <= 1000 % n THEN 1 ELSE 0 END)::BIGINT AS need FROM (SELECT topic, subtopic, row_number() OVER (ORDER BY topic, subtopic) AS pos, count(*) OVER () AS n FROM ({_COUNTS}))",
    "allocation_inverse": f"WITH c AS ({_COUNTS}), p AS (SELECT *, row_number() OVER (ORDER BY image_count, topic, subtopic) AS pos FROM c), b AS (SELECT *, floor(1000.0::DOUBLE * ((1.0::DOUBLE / pos) / sum(1.0::DOUBLE / pos) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))::BIGINT AS base FROM p) SELECT topic, subtopic, base + CASE WHEN pos <= 1000 - sum(base) OVER () THEN 1 ELSE 0 END AS need FROM b",
    "allocation_shrunk": f"WITH c AS (SELECT topic, subtopic, greatest(0, 400 - image_count)::BIGINT AS v FROM ({_COUNTS})), s AS (SELECT *, v * (777.0::DOUBLE / sum(v) OVER ()) AS scaled FROM c), b AS (SELECT *, floor(scaled)::BIGINT AS base, scaled - floor(scaled) AS frac FROM s), r AS (SELECT *, row_number() OVER (ORDER BY frac DESC, topic DESC, subtopic DESC) AS pos, 777 - sum(base) OVER () AS rest FROM b) SELECT topic, subtopic, base + CASE WHEN pos <= rest THEN 1 ELSE 0 END AS need FROM r",
    "remaining_pairs": "SELECT topic, subtopic FROM subtopic_pair p WHERE NOT EXISTS (SELECT 1 FROM data_item d WHERE d.topic = p.topic AND d.subtopic = p.subtopic)",
    "first_issues": "SELECT min(item_id) AS item_id, query FROM data_item WHERE batch_no >= 1 AND query IS NOT NULL AND query NOT IN (SELECT query FROM data_item WHERE batch_no = 0 AND query IS NOT NULL) GROUP BY query",
    "frontier_order": "SELECT item_id, priority, row_number() OVER (ORDER BY priority, enq DESC, q) AS place FROM (SELECT item_id, CASE WHEN is_generated THEN 1 ELSE 10 END AS priority, ingested_at AS enq, encode(query || '#' || item_id) AS q FROM data_item WHERE query IS NOT NULL AND is_generated IS NOT NULL)",
    "query_variants": f"WITH x AS (SELECT item_id, subtopic, list_filter([{_strip('query')}, {_strip('prompt')}], lambda t: t IS NOT NULL AND t <> '') AS l FROM data_item WHERE subtopic IS NOT NULL), v AS (SELECT item_id, CASE WHEN len(l) = 0 THEN [subtopic] WHEN len(l) = 2 AND l[1] = l[2] THEN [l[1]] ELSE l END AS v FROM x) SELECT item_id, len(v) AS n, array_to_string(v, chr(10)) AS variants FROM v",
    "near_pairs": f"WITH {_REPS} SELECT a, b, distance FROM pairs",
    "near_classes": f"WITH {_REPS}, l AS (SELECT i, count(*) AS n FROM (SELECT a AS i FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY i) SELECT h.item_id, r.i AS class_id, coalesce(l.n, 0) AS n_links FROM hash_index h JOIN reps r USING (hash) LEFT JOIN l ON l.i = r.i",
    "index_cleanup": "SELECT min(item_id) AS item_id FROM hash_index WHERE hash IS NOT NULL GROUP BY scope, hash UNION ALL SELECT item_id FROM hash_index WHERE hash IS NULL",
    "exact_groups": "SELECT sha1(text) AS sha1, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "centroid_gate": "WITH f AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings), m AS (SELECT label, p, avg(x) AS m FROM f GROUP BY ALL), s AS (SELECT f.vec_id, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS c FROM f JOIN m USING (label, p) GROUP BY f.vec_id) SELECT vec_id, round(least(greatest((c + 1) / 2, 0), 1), 6) AS score, least(greatest((c + 1) / 2, 0), 1) >= 0.55 AS passed FROM s",
    "nearest_vectors": "WITH s AS (SELECT q.vec_id AS query, e.vec_id AS match, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS c FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, match) AS rank FROM s) SELECT query, match, CAST(rank AS INT) AS rank, round(c, 6) AS similarity FROM r WHERE rank <= 5",
}
