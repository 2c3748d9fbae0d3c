"""Queries over the parts of the feedback loop: library, frontier, planning, dedup decisions and policies."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain import sinks, sources
from loomgrain.functions import geometry, jsonrepair, text, urls
from loomgrain.operators import allocation, dedup, experience, frontier, gates, ordering, recognition, rounds, search
from loomgrain.queries import curation
from loomgrain.queries.curation import OUTCOMES, _SUM, _codes_sql
from loomgrain.queries.texts import _HOST, LATEST, OCR, _ocr, _strip
from loomgrain.runtime import load
from loomgrain.thresholds import SEMANTIC, Minima, QualityGate


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with their position in the configuration: by name."""
    return ordering.numbered(load(spark, d, "subtopic_pair"), [F.col("topic").asc(), F.col("subtopic").asc()], "pos", name="pairs")


_POS = "pairs AS (SELECT topic, subtopic, row_number() OVER (ORDER BY topic, subtopic) AS pos FROM subtopic_pair)"


def topic_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Topics with their lists of seeds, flattened."""
    return frontier.pairs(load(spark, d, "subtopic_pair").groupBy("topic").agg(F.collect_list("subtopic").alias("seed_queries")))


def unseen_urls(spark: SparkSession, d: str) -> DataFrame:
    """URLs of the later batches that the history of their topic does not have, unless the history is full."""
    rows = load(spark, d, "data_item", "item_id", "topic", "source_url", "batch_no").where("source_url IS NOT NULL AND topic IS NOT NULL").withColumnRenamed("source_url", "url")
    return frontier.unseen_urls(rows.where("batch_no >= 1").drop("batch_no"), rows.where("batch_no = 0").drop("item_id", "batch_no"), ["topic"]).select("item_id", "topic", "url")


def strategy_targets(spark: SparkSession, d: str) -> DataFrame:
    """The queries of a strategy for each of the first pairs of the configuration."""
    targets = frontier.batch(_pairs(spark, d), 5)
    names = load(spark, d, "subtopic_pair").select(F.concat(F.lit("photo of "), "topic").alias("query"))
    return frontier.fan_out(targets, names, each=True).select("topic", "subtopic", "query")


def first_target(spark: SparkSession, d: str) -> DataFrame:
    """A query that is issued once falls to the first pair."""
    names = load(spark, d, "subtopic_pair").select(F.concat(F.lit("photo of "), "topic").alias("query"))
    return frontier.fan_out(_pairs(spark, d), names).select("topic", "subtopic", "query")


def fallback_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Seeds of the topic for each pair."""
    seeds = load(spark, d, "subtopic_pair").groupBy("topic").agg(F.min("subtopic").alias("seed"))
    return frontier.static_fallback(load(spark, d, "subtopic_pair"), seeds).select("topic", "subtopic", "seed")


def pending_batch(spark: SparkSession, d: str) -> DataFrame:
    """The first ten pairs in the order of the configuration."""
    return frontier.batch(_pairs(spark, d), 10).select("topic", "subtopic")


def topic_samples(spark: SparkSession, d: str) -> DataFrame:
    """the first five items of each subtopic."""
    return frontier.per_group(load(spark, d, "data_item", "topic", "subtopic", "item_id"), ["topic", "subtopic"], "item_id", 5)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    q = gates.latest_quality(load(spark, d, "quality_record", "item_id", "assessed_at", "legibility")).select("item_id", F.when(~F.isnan("legibility"), F.col("legibility")).alias("score"))
    return load(spark, d, "data_item", "item_id", "query").where("query IS NOT NULL").join(q, "item_id", "left").select("query", F.col("item_id").alias("ord"), "score")


def trimmed_library(spark: SparkSession, d: str) -> DataFrame:
    """The ten best of all distinct queries."""
    return experience.trimmed(_scored(spark, d))


def accepted_candidates(spark: SparkSession, d: str) -> DataFrame:
    """candidates whose last outcome was accepted."""
    return experience.accepted_only(curation.merged_candidates(spark, d)).select("query", "score")


def compressed_stats(spark: SparkSession, d: str) -> DataFrame:
    """of the statistics of a round only the named ones that have a value."""
    s = curation.round_summary(spark, d)
    names = ("processed", "accepted", "rejected", "pass_rate")
    m = F.create_map(*[x for n in names for x in (F.lit(n), F.when(F.col(n) > 0, F.col(n).cast("double")))])
    x = experience.compressed(s.select("round_id", m.alias("stats")), "stats", ("accepted", "pass_rate"))
    return x.select("round_id", F.col("stats")["accepted"].alias("accepted"), F.col("stats")["pass_rate"].alias("pass_rate"), F.size("stats").alias("n"))


def quality_prompts(spark: SparkSession, d: str) -> DataFrame:
    """X15."""
    return load(spark, d, "subtopic_pair").select("topic", "subtopic", text.quality_prompt(F.col("subtopic")).alias("prompt"))


def pixel_densities(spark: SparkSession, d: str) -> DataFrame:
    """X18, X19 with the sides of the assessment as width and height."""
    q = gates.latest_quality(load(spark, d, "quality_record", "item_id", "assessed_at", "words", "min_side_val", "max_side_val"))
    rows = q.join(_ocr(spark, d, "texts"), "item_id").where("min_side_val > 0 AND max_side_val > 0")
    chars = F.aggregate(F.col("texts"), F.lit(0), lambda n, t: n + F.coalesce(F.length(t), F.lit(0)))
    w, h = F.col("max_side_val"), F.col("min_side_val")
    x = rows.select("item_id", geometry.densities(F.col("words"), chars, w, h).alias("d"), geometry.sides(w, h).alias("s"))
    return x.select("item_id", F.round("d.text_density", 6).alias("text_density"), F.round("d.char_density", 6).alias("char_density"), F.round("s.aspect_ratio", 6).alias("aspect_ratio"), "s.min_side_val", "s.max_side_val")


def unfenced_prompts(spark: SparkSession, d: str) -> DataFrame:
    """X22, X24 over prompts put into a code fence, with a comma before each closing bracket."""
    rows = load(spark, d, "data_item", "item_id", "prompt").where("prompt IS NOT NULL")
    fenced = F.concat(F.lit("```json\n"), F.regexp_replace("prompt", r"([}\]])", ", $1"), F.lit("\n```"))
    return rows.select("item_id", text.without_trailing_commas(text.without_fence(fenced)).alias("prompt"))


def listed_answers(spark: SparkSession, d: str) -> DataFrame:
    """A list of a topic's subtopics in an answer with words around it and a comma too many."""
    rows = load(spark, d, "subtopic_pair").groupBy("topic").agg(F.array_sort(F.collect_list("subtopic")).alias("l"))
    answer = F.concat(F.lit("Here you are: "), F.regexp_replace(F.to_json("l"), r"\]$", ", ]"), F.lit(" Enjoy!"))
    return rows.select("topic", F.posexplode(jsonrepair.parsed_list(answer)).alias("pos", "subtopic"))


def parsed_needs(spark: SparkSession, d: str) -> DataFrame:
    """Needs read from lines of text."""
    counts = curation.pair_counts(spark, d)
    line = F.concat(F.lit("  "), "topic", F.lit(" "), "subtopic", F.lit(": need "), F.col("image_count").cast("string"), F.lit(" more"))
    lines = ordering.numbered(counts, [F.col("topic").asc(), F.col("subtopic").asc()], "pos", name="lines").select("pos", line.alias("line"))
    return allocation.parsed_needs(lines, load(spark, d, "subtopic_pair"))


def first_samples(spark: SparkSession, d: str) -> DataFrame:
    """A7."""
    return rounds.first_sample(curation._rounds(spark, d, "topic", "subtopic"))


def flat_rounds(spark: SparkSession, d: str) -> DataFrame:
    """X32 over the summaries as payloads."""
    s = curation.round_summary(spark, d)
    payload = F.to_json(F.struct("round_id", "pass_rate", F.struct(F.lit(0.5).alias("avg_ocr_conf")).alias("metrics")))
    x = s.select(payload.alias("p")).select(*rounds.flat_stats(F.col("p")))
    return x.select("round", "pass_rate", "ocr_conf", "clip", "text", F.size("vector").alias("n"))


def dealt_items(spark: SparkSession, d: str) -> DataFrame:
    """Items dealt to seven workers in turns."""
    return ordering.dealt(load(spark, d, "data_item", "item_id"), [F.col("item_id").asc()], 7).select("item_id", F.col("worker").cast("int").alias("worker"))


def semantic_codes(spark: SparkSession, d: str) -> DataFrame:
    """the codes of each dimension for a vector's score against the mean of its label, and with the gate switched off."""
    scored = search.centroid_gate(load(spark, d, "embeddings"), "vec_id", "embedding", "label", SEMANTIC.topic).withColumn("score", F.round("score", 6))
    x = search.gate_codes(scored, "vec_id", {"topic": "score", "subtopic": "score", "combined": "score"}, SEMANTIC, "semantic")
    off = gates.vector_codes(F.array(F.lit(0.0)), {"topic": [F.array(F.lit(1.0))]}, Minima(1.0, 1.0, 1.0, enabled=False), "semantic")
    return x.select("vec_id", F.array_join("codes", ",").alias("codes"), F.size(off).alias("n_off"))


def text_codes(spark: SparkSession, d: str) -> DataFrame:
    """the greatest cosine with the first and second vector of all; a missing vector is an error."""
    e = load(spark, d, "embeddings")
    two = e.where("vec_id <= 1").agg(F.array_agg(F.struct("vec_id", "embedding")).alias("v")).select(F.transform(F.array_sort("v"), lambda x: x["embedding"]).alias("v"))
    v = F.when(F.col("vec_id") > 2, F.col("embedding"))
    code = gates.vector_codes(v, {"topic": [F.col("v")[0], F.col("v")[1]]}, Minima(0.2, 0.2, 0.2), "text")
    return e.crossJoin(F.broadcast(two)).select("vec_id", F.array_join(code, ",").alias("codes"))


def language_gate(spark: SparkSession, d: str) -> DataFrame:
    """the codes when only English and German are allowed, by the limits as shipped."""
    g = replace(QualityGate.shipped(), require_language=True, languages=("en", "de"))
    q = gates.latest_quality(load(spark, d, "quality_record", *curation._GATED))
    return q.select("item_id", F.array_join(gates.quality_codes(g), ",").alias("codes"))


def shipped_codes(spark: SparkSession, d: str) -> DataFrame:
    """F1 by the limits as shipped."""
    q = gates.latest_quality(load(spark, d, "quality_record", *curation._GATED))
    return q.select("item_id", F.array_join(gates.quality_codes(QualityGate.shipped()), ",").alias("codes"))


def relevant_topics(spark: SparkSession, d: str) -> DataFrame:
    """F10 with topics as pages: under a third of their URLs from these domains."""
    rows = load(spark, d, "data_item", "topic", "source_url").where("topic IS NOT NULL")
    return urls.relevant_pages(rows, "topic", "source_url", ("wikimedia.org", "imgur.com", "alamy.com", "unknown"), 1 / 3)


def job_matches(spark: SparkSession, d: str) -> DataFrame:
    """Items as tasks, recognised records as results: matched, without a task, without a job."""
    tasks = load(spark, d, "data_item", "item_id", "is_generated").where("NOT is_generated").select(F.col("item_id").alias("job_id"))
    results = load(spark, d, "ocr_record", "item_id", "error").select(F.when(F.col("error").isNull(), F.col("item_id")).alias("job_id"))
    parts = zip(("matched", "no_task", "no_job"), recognition.matched(tasks, results))
    out = [p.select(F.lit(n).alias("kind"), F.col("job_id").cast("bigint").alias("job_id")) for n, p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("job_id"), F.lit(0)).alias("ids"))


def merged_index(spark: SparkSession, d: str) -> DataFrame:
    """The index of the history with the rows of the later batches, of a scope and path the new one."""
    b = load(spark, d, "data_item", "item_id", "batch_no")
    rows = load(spark, d, "hash_index", "item_id", "scope", "path", "hash").where("scope IS NOT NULL AND path IS NOT NULL").join(b, "item_id")
    one = lambda x: x.groupBy("scope", "path").agg(F.max(F.struct("item_id", "hash")).alias("x")).select("scope", "path", "x.*")
    return dedup.upserted(one(rows.where("batch_no = 0")), one(rows.where("batch_no >= 1"))).select("scope", "path", "item_id", "hash")


def commit_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What committing each later row to the index of the history amounts to; the history knows a hash by its first path."""
    b = load(spark, d, "data_item", "item_id", "batch_no")
    rows = load(spark, d, "hash_index", "item_id", "path", "hash").join(b, "item_id")
    known = rows.where("batch_no = 0 AND hash IS NOT NULL").groupBy("hash").agg(F.min_by("path", "item_id").alias("known_path"), F.min("hash").alias("known_hash"))
    new = rows.where("batch_no >= 1").join(known, "hash", "left")
    out = dedup.commit_outcome(F.col("path"), F.col("known_path"), F.col("known_hash"), F.when(F.col("hash").isNotNull() & F.col("known_hash").isNull(), F.col("path")))
    return new.select("item_id", out.alias("outcome"))


def result_pages(spark: SparkSession, d: str) -> DataFrame:
    """Links of result pages made of the items' URLs; short pages are no result pages."""
    u = load(spark, d, "data_item", "item_id", "source_url").where("source_url IS NOT NULL")
    tag = F.concat(F.lit('<a class="x iusc" href="#" m="{&quot;murl&quot;:&quot;'), "source_url", F.lit('&quot;}">'))
    html = F.concat(tag, F.repeat(F.lit(" "), F.pmod(F.col("item_id"), F.lit(2)).cast("int") * 20_000))
    return u.select("item_id", F.array_join(sources.image_links(html), " ").alias("links"), sources.is_real_page(html).alias("real"))


def page_stats(spark: SparkSession, d: str) -> DataFrame:
    """A18 over the same pages, all of them long."""
    u = load(spark, d, "data_item", "source_url").where("source_url IS NOT NULL")
    tag = F.concat(F.lit('<a class="iusc" m="{&quot;murl&quot;:&quot;'), "source_url", F.lit('&quot;}">'), F.repeat(F.lit(" "), 20_000))
    x = sources.page_stats(u.select(tag.alias("html")))
    return x.select("pages", F.round("challenge_share", 6).alias("challenge_share"), F.round("links_per_page", 6).alias("links_per_page"))


def valid_rows(spark: SparkSession, d: str) -> DataFrame:
    """K1: items that have all that a record must have, and those that have not."""
    good, bad = sinks.validated(load(spark, d, "data_item", "image_path", "topic", "subtopic", "source", "is_generated"), "data_item", ["image_path", "topic", "is_generated"])
    one = lambda x, ok: x.select(F.lit(ok).alias("valid"), "image_path", "topic")
    return one(good, True).unionByName(one(bad, False)).groupBy("valid").agg(F.count(F.lit(1)).alias("n"), F.count("topic").alias("n_topic"))


def hashed_names(spark: SparkSession, d: str) -> DataFrame:
    """K6: names by the SHA-1 of the content; equal content has a suffix."""
    x = sinks.named(load(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL"), "doc_id", mode="sha1", content="text")
    return x.select("doc_id", "file")


def topic_totals(spark: SparkSession, d: str) -> DataFrame:
    """Counts by topic, subtopic and kind."""
    rows = load(spark, d, "data_item", "topic", "subtopic", "is_generated").withColumn("is_generated", F.coalesce(F.col("is_generated").cast("string"), F.lit("unknown")))
    return rows.groupBy("topic", "subtopic", "is_generated").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        topic_seeds, unseen_urls, strategy_targets, first_target, fallback_seeds, pending_batch, topic_samples, trimmed_library, accepted_candidates,
        compressed_stats, quality_prompts, pixel_densities, unfenced_prompts, listed_answers, parsed_needs, first_samples, flat_rounds, dealt_items,
        semantic_codes, text_codes, language_gate, shipped_codes, relevant_topics, job_matches, merged_index, commit_outcomes, result_pages, page_stats,
        valid_rows, hashed_names, topic_totals,
    )
}

_W = "WITH " + OUTCOMES
_COS = "list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(a, lambda z: z * z))) * sqrt(list_sum(list_transform(b, lambda z: z * z))))"
_GATE = f"WITH q AS ({LATEST}) SELECT item_id, array_to_string({{}}, ',') AS codes FROM q"
_SHIPPED = _codes_sql(QualityGate.shipped())
SQL = {
    "topic_seeds": "SELECT topic, subtopic FROM subtopic_pair",
    "unseen_urls": """WITH u AS (SELECT item_id, topic, source_url AS url, batch_no FROM data_item WHERE source_url IS NOT NULL AND topic IS NOT NULL),
      f AS (SELECT topic FROM u WHERE batch_no = 0 GROUP BY topic HAVING count(*) >= 3000)
      SELECT item_id, topic, url FROM u WHERE batch_no >= 1 AND (topic IN (FROM f) OR (topic, url) NOT IN (SELECT (topic, url) FROM u WHERE batch_no = 0))""",
    "strategy_targets": f"WITH {_POS} SELECT p.topic, p.subtopic, 'photo of ' || t.topic AS query FROM pairs p, (SELECT DISTINCT topic FROM subtopic_pair) t WHERE pos <= 5",
    "first_target": f"WITH {_POS} SELECT p.topic, p.subtopic, 'photo of ' || t.topic AS query FROM pairs p, (SELECT DISTINCT topic FROM subtopic_pair) t WHERE pos = 1",
    "fallback_seeds": "SELECT topic, subtopic, min(subtopic) OVER (PARTITION BY topic) AS seed FROM subtopic_pair",
    "pending_batch": f"WITH {_POS} SELECT topic, subtopic FROM pairs WHERE pos <= 10",
    "topic_samples": "SELECT topic, subtopic, item_id FROM data_item QUALIFY row_number() OVER (PARTITION BY topic, subtopic ORDER BY item_id) <= 5",
    "trimmed_library": f"""WITH q AS ({LATEST}), c AS (SELECT {_strip('query')} AS query, d.item_id AS ord, CASE WHEN NOT isnan(legibility) THEN legibility ELSE 0 END AS score FROM data_item d LEFT JOIN q USING (item_id) WHERE query IS NOT NULL),
      o AS (SELECT query, min(ord) AS ord, coalesce(arg_min(coalesce(score, 0), ord), 0) AS score FROM c WHERE query <> '' GROUP BY query) SELECT query, ord, score FROM o ORDER BY score DESC, ord LIMIT 10""",
    "accepted_candidates": curation.SQL["merged_candidates"].replace("SELECT query, max(", "SELECT query, score FROM (SELECT query, max(", 1) + ") WHERE status = 'accepted'",
    "compressed_stats": _W + f"SELECT round_id, nullif(accepted, 0)::DOUBLE AS accepted, nullif(pass_rate, 0) AS pass_rate, CASE WHEN accepted > 0 THEN 2 ELSE 0 END AS n FROM ({_SUM})",
    "quality_prompts": "SELECT topic, subtopic, 'A high-resolution, text-dominant image of ''' || subtopic || ''', with clean grid layout, strong contrast, large readable glyphs, and consistent line orientation. No watermark or brand logos.' AS prompt FROM subtopic_pair",
    "pixel_densities": f"""WITH q AS ({LATEST}), o AS ({OCR}), x AS (SELECT item_id, words, min_side_val AS h, max_side_val AS w, coalesce(list_sum(list_transform(texts, lambda t: length(t))), 0) AS n, w::DOUBLE * h / 1e6 + 1e-6 AS mp FROM q JOIN o USING (item_id) WHERE min_side_val > 0 AND max_side_val > 0)
      SELECT item_id, round(words / mp, 6) AS text_density, round(n / mp, 6) AS char_density, round(w / (h + 1e-6), 6) AS aspect_ratio, h AS min_side_val, w AS max_side_val FROM x""",
    "unfenced_prompts": f"SELECT item_id, {_strip('prompt')} AS prompt FROM data_item WHERE prompt IS NOT NULL",
    "listed_answers": "SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY subtopic) - 1 AS INT) AS pos, subtopic FROM subtopic_pair",
    "parsed_needs": f"SELECT topic, subtopic, image_count AS need FROM ({curation._COUNTS})",
    "first_samples": _W + "SELECT round_id, topic, subtopic FROM outcomes QUALIFY row_number() OVER (PARTITION BY round_id ORDER BY len(reasons) > 0, item_id) = 1",
    "flat_rounds": _W + f"SELECT round_id AS round, pass_rate, 0.5::DOUBLE AS ocr_conf, 0.0::DOUBLE AS clip, 0.0::DOUBLE AS text, 0 AS n FROM ({_SUM})",
    "dealt_items": "SELECT item_id, CAST((row_number() OVER (ORDER BY item_id) - 1) % 7 AS INT) AS worker FROM data_item",
    "semantic_codes": f"""WITH s AS ({curation.SQL['centroid_gate']})
      SELECT vec_id, concat_ws(',', CASE WHEN score < {SEMANTIC.topic} THEN 'semantic_topic_fail' END, CASE WHEN score < {SEMANTIC.subtopic} THEN 'semantic_subtopic_fail' END, CASE WHEN score < {SEMANTIC.combined} THEN 'semantic_combined_fail' END) AS codes, 0 AS n_off FROM s""",
    "text_codes": f"""WITH x AS (SELECT e.vec_id, max({_COS}) AS c FROM (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings) e, (SELECT embedding::DOUBLE[] AS b FROM embeddings WHERE vec_id <= 1) v GROUP BY e.vec_id)
      SELECT vec_id, CASE WHEN vec_id <= 2 THEN 'text_error' WHEN c < 0.2 THEN 'text_topic_fail' ELSE '' END AS codes FROM x""",
    "language_gate": _GATE.format(f"list_concat({_SHIPPED}, CASE WHEN coalesce(lang IN ('en', 'de'), false) THEN [] ELSE ['lang_not_allowed'] END)"),
    "shipped_codes": _GATE.format(_SHIPPED),
    "relevant_topics": f"SELECT topic FROM data_item WHERE topic IS NOT NULL GROUP BY topic HAVING avg(CASE WHEN regexp_matches(lower({_HOST}), 'wikimedia\\.org|imgur\\.com|alamy\\.com|unknown') THEN 1 ELSE 0 END) < 1 / 3",
    "job_matches": """WITH t AS (SELECT item_id AS j FROM data_item WHERE NOT is_generated), r AS (SELECT CASE WHEN error IS NULL THEN item_id END AS j FROM ocr_record),
      k AS (SELECT j, CASE WHEN j IS NULL THEN 'no_job' WHEN j IN (FROM t) THEN 'matched' ELSE 'no_task' END AS kind FROM r) SELECT kind, count(*) AS n, coalesce(sum(j), 0)::BIGINT AS ids FROM k GROUP BY kind""",
    "merged_index": """SELECT h.scope, h.path, h.item_id, h.hash FROM hash_index h JOIN data_item d USING (item_id) WHERE h.scope IS NOT NULL AND h.path IS NOT NULL AND NOT starts_with(h.path, '__')
      QUALIFY row_number() OVER (PARTITION BY h.scope, h.path ORDER BY d.batch_no >= 1 DESC, h.item_id DESC) = 1""",
    "commit_outcomes": """WITH r AS (SELECT h.item_id, h.path, h.hash, d.batch_no FROM hash_index h JOIN data_item d USING (item_id)), k AS (SELECT hash, arg_min(path, item_id) AS p FROM r WHERE batch_no = 0 AND hash IS NOT NULL GROUP BY hash)
      SELECT item_id, CASE WHEN r.hash IS NULL THEN 'hash_failed' WHEN k.p = r.path THEN 'already_committed' WHEN k.hash IS NOT NULL THEN 'committed_to_existing_bucket' WHEN r.path IS NOT NULL THEN 'migrated' ELSE 'committed' END AS outcome
      FROM r LEFT JOIN k USING (hash) WHERE batch_no >= 1""",
    "result_pages": f"SELECT item_id, CASE WHEN starts_with(source_url, 'http') THEN source_url ELSE '' END AS links, length(source_url) + 60 + (item_id % 2) * 20000 >= {sources.SHORTEST_PAGE} AS real FROM data_item WHERE source_url IS NOT NULL",
    "page_stats": "SELECT count(*) AS pages, 0.0::DOUBLE AS challenge_share, round(avg(CASE WHEN starts_with(source_url, 'http') THEN 1 ELSE 0 END), 6) AS links_per_page FROM data_item WHERE source_url IS NOT NULL",
    "valid_rows": "SELECT image_path IS NOT NULL AND topic IS NOT NULL AND is_generated IS NOT NULL AS valid, count(*) AS n, count(topic) AS n_topic FROM data_item GROUP BY 1",
    "hashed_names": "SELECT doc_id, sha1(text) || CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY text) THEN '' ELSE '_' || left(md5(doc_id::VARCHAR), 6) END AS file FROM documents WHERE text IS NOT NULL",
    "topic_totals": "SELECT topic, subtopic, coalesce(is_generated::VARCHAR, 'unknown') AS is_generated, count(*) AS n FROM data_item GROUP BY ALL",
}
