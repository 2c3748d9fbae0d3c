"""Text, URL and recognition functions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.functions import geometry, text, urls
from loomgrain.operators import gates, recognition
from loomgrain.runtime import load

WS = r"[\s\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _squeeze(x: str) -> str:
    return _strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


LATEST = "SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY assessed_at DESC) AS r FROM quality_record) WHERE r = 1"
OCR = "SELECT DISTINCT item_id, boxes, texts, confs, avg_conf, word_count, error FROM ocr_record"


def _ocr(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Recognised records, rows delivered twice once."""
    return load(spark, d, "ocr_record", "item_id", *columns).distinct()


def clean_queries(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "data_item", "item_id", "query").where("query IS NOT NULL").select("item_id", text.clean_query(F.col("query")).alias("cleaned"))


def _clean_sql() -> str:
    s, q = "s", "s"
    for p in reversed(text.QUERY_PREFIXES):
        cut = _strip("regexp_replace(s, '(?i)" + p.replace("'", "''") + "', '')")
        q = f"CASE WHEN {cut} <> s THEN {cut} ELSE {q} END"
    short = f"array_to_string(list_slice(regexp_split_to_array(q2, '{WS}+'), 1, 6), ' ')"
    return f"""WITH a AS (SELECT item_id, {_strip('query')} AS s FROM data_item WHERE query IS NOT NULL),
    b AS (SELECT item_id, s, {_strip("regexp_replace(" + q + ", '^[''\"]+|[''\"]+$', '', 'g')")} AS q2 FROM a)
    SELECT item_id, coalesce(nullif(CASE WHEN length(q2) > 80 THEN {short} ELSE q2 END, ''), s) AS cleaned FROM b"""


def markets(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents", "doc_id", "text").select("doc_id", text.market(F.col("text")).alias("market"))


def _market_sql() -> str:
    whens = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{m}'" for p, m in text.MARKETS)
    return f"SELECT doc_id, CASE {whens} ELSE 'en-US' END AS market FROM documents"


def script_counts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents", "doc_id", "text").select("doc_id", text.script_counts(F.col("text")).alias("n")).select("doc_id", "n.*")


def folder_names(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "data_item", "topic", "subtopic").distinct()
    return rows.select("topic", "subtopic", text.folder_name(F.col("subtopic")).alias("folder"))


def caption_texts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents", "doc_id", "text").select("doc_id", text.caption_text(F.col("text")).alias("caption"))


def sentence_cuts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", text.to_sentence(F.col("text"), 200).alias("cut"))


def template_captions(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "data_item", "item_id", "topic", "subtopic")
    return rows.select("item_id", text.template_caption(F.col("topic"), F.col("subtopic")).alias("caption"))


_METRICS = ("line_count", "char_h_mean", "text_density", "contrast", "centrality", "line_angle_std", "char_h_cv")


def layout_captions(spark: SparkSession, d: str) -> DataFrame:
    q = gates.latest_quality(load(spark, d, "quality_record", "item_id", "assessed_at", *_METRICS))
    rows = load(spark, d, "data_item", "item_id", "topic", "subtopic").join(_ocr(spark, d, "texts"), "item_id").join(q, "item_id")
    return rows.select("item_id", text.layout_caption(F.col("topic"), F.col("subtopic"), F.col("texts"), {m: F.col(m) for m in _METRICS}).alias("caption"))


_LAYOUT_SQL = f"""
WITH q AS ({LATEST}), o AS ({OCR}), x AS (
  SELECT d.item_id, coalesce(d.topic, '') AS t, coalesce(d.subtopic, '') AS s, coalesce(array_to_string(o.texts, ' '), '') AS j, q.*
  FROM data_item d JOIN o USING (item_id) JOIN q USING (item_id)
), y AS (SELECT *, length(regexp_replace(j, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(j, '[^\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')) AS han FROM x)
SELECT item_id, concat_ws(' ',
  'Text-dominant ' || translate(t, '_', ' ') || ' / ' || translate(s, '_', ' ') || '.',
  CASE WHEN han > latin THEN 'Primary language: Chinese; secondary English.' WHEN latin > han THEN 'Primary language: English; secondary Chinese.' ELSE 'Bilingual layout.' END,
  CAST(coalesce(line_count, 0) AS BIGINT) || ' lines, avg glyph height ~' || CAST(trunc(coalesce(char_h_mean, 0)) AS BIGINT) || 'px, density ~' || CAST(trunc(coalesce(text_density, 0)) AS BIGINT) || ' words/MP.',
  CASE WHEN contrast >= 0.16 THEN 'High contrast between text and background.' END,
  CASE WHEN centrality >= 0.6 THEN 'Text blocks centered within the canvas.' END,
  CASE WHEN line_angle_std <= 4.5 THEN 'Lines are horizontally aligned.' END,
  CASE WHEN char_h_cv <= 0.45 THEN 'Consistent glyph sizes across lines.' END,
  CASE WHEN contains(lower(t), 'sign') OR contains(lower(s), 'sign') THEN 'Legible signage style with bold typography.' END,
  CASE WHEN contains(lower(t), 'menu') OR contains(s, '菜单') THEN 'Multi-column menu layout with clear sections.' END,
  CASE WHEN contains(lower(s), 'blackboard') OR contains(lower(t), 'poster') THEN 'Dense text blocks suitable for chalkboard/poster rendering.' END) AS caption
FROM y"""


def joined_texts(spark: SparkSession, d: str) -> DataFrame:
    return _ocr(spark, d, "texts").select("item_id", text.joined_texts(F.col("texts")).alias("joined"))


def prompt_matches(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "data_item", "item_id", "query", "prompt").where("query IS NOT NULL AND prompt IS NOT NULL")
    return rows.select("item_id", F.round(text.prompt_match(F.col("query"), F.col("prompt")), 6).alias("match"))


def similarity_prompts(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "subtopic_pair").select("topic", "subtopic", F.posexplode(text.similarity_prompts(F.col("topic"), F.col("subtopic"))).alias("pos", "prompt"))
    return p.select("topic", "subtopic", "pos", "prompt")


def json_prompts(spark: SparkSession, d: str) -> DataFrame:
    j = text.json_object(F.col("prompt"))
    rows = load(spark, d, "data_item", "item_id", "prompt").where("prompt IS NOT NULL").select("item_id", j.alias("j"))
    return rows.select("item_id", F.get_json_object("j", "$.scene").alias("scene"), F.get_json_object("j", "$.place").alias("place"))


def host_report(spark: SparkSession, d: str) -> DataFrame:
    h = urls.host(F.col("source_url"))
    rows = load(spark, d, "data_item", "source_url").select(h.alias("host"), urls.is_blocked(h).alias("is_blocked"), urls.is_cdn(h).alias("is_cdn"))
    return rows.groupBy("host", "is_blocked", "is_cdn").agg(F.count(F.lit(1)).alias("n"))


_HOST = "coalesce(nullif(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), ''), 'unknown')"


def _rx(parts: tuple[str, ...]) -> str:
    return "|".join(p.replace(".", r"\.") for p in parts)


def download_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = urls.download_plan(load(spark, d, "data_item", "item_id", "source_url"), "source_url", "item_id")
    return rows.select("item_id", "host", "is_cdn", "pos", "place", urls.target_file(F.col("source_url")).alias("file"))


def ocr_stats(spark: SparkSession, d: str) -> DataFrame:
    s = recognition.ocr_stats(F.col("texts"), F.col("confs"))
    return _ocr(spark, d, "texts", "confs").select("item_id", s.alias("s")).select("item_id", F.round("s.avg_conf", 6).alias("avg_conf"), "s.n_lines", F.round("s.legibility", 6).alias("legibility"))


def watermarks(spark: SparkSession, d: str) -> DataFrame:
    return _ocr(spark, d, "texts").select("item_id", gates.has_watermark(F.col("texts")).alias("has_watermark"))


def best_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = recognition.best_lines(F.col("texts"), F.col("confs"))
    return _ocr(spark, d, "texts", "confs").select("item_id", F.array_join(lines, "\n").alias("lines"))


def important_lines(spark: SparkSession, d: str) -> DataFrame:
    return _ocr(spark, d, "texts", "boxes").select("item_id", F.array_join(recognition.important_lines(F.col("texts"), F.col("boxes")), "\n").alias("lines"))


def keyword_lines(spark: SparkSession, d: str) -> DataFrame:
    return _ocr(spark, d, "texts").select("item_id", F.array_join(recognition.lines_with(F.col("texts"), ["exit", "price", "字"]), "\n").alias("lines"))


def box_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = _ocr(spark, d, "boxes").select("item_id", geometry.char_stats(F.col("boxes")).alias("c"), geometry.line_stats(F.col("boxes")).alias("l"))
    return rows.select("item_id", F.round("c.char_h_mean", 4).alias("char_h_mean"), F.round("c.char_h_cv", 4).alias("char_h_cv"), "c.n_boxes", "l.line_count", F.round("l.line_angle_std", 4).alias("line_angle_std"))


_BOX_SQL = f"""
WITH o AS ({OCR}), b AS (SELECT item_id, unnest(boxes) AS b FROM o WHERE len(boxes) > 0),
g AS (SELECT item_id, list_max(list_transform(b, lambda p: p[2])) - list_min(list_transform(b, lambda p: p[2])) AS h,
  list_sum(list_transform(b, lambda p: p[2])) / 4.0 AS cy, list_sort(list_transform(b, lambda p: [p[2], p[1]])) AS top FROM b WHERE len(b) = 4),
m AS (SELECT *, avg(h) OVER (PARTITION BY item_id) AS mh, cy - lag(cy) OVER (PARTITION BY item_id ORDER BY cy) AS gap,
  degrees(atan2(top[2][1] - top[1][1], top[2][2] - top[1][2] + 1e-6)) AS angle FROM g),
r AS (SELECT item_id, avg(h) AS char_h_mean, stddev_pop(h) / (avg(h) + 1e-6) AS char_h_cv, count(*) AS n_boxes,
  1 + count(*) FILTER (WHERE gap > mh * 0.8) AS line_count, stddev_pop(angle) AS line_angle_std FROM m GROUP BY item_id)
SELECT o.item_id, round(coalesce(char_h_mean, 0), 4) AS char_h_mean, round(coalesce(char_h_cv, 1), 4) AS char_h_cv, coalesce(n_boxes, 0) AS n_boxes,
  coalesce(line_count, 0) AS line_count, round(coalesce(line_angle_std, 999), 4) AS line_angle_std FROM o LEFT JOIN r USING (item_id)"""

QUERIES = {
    f.__name__: f
    for f in (
        clean_queries, markets, script_counts, folder_names, caption_texts, sentence_cuts, template_captions, layout_captions, joined_texts, prompt_matches,
        similarity_prompts, json_prompts, host_report, download_plan, ocr_stats, watermarks, best_lines, important_lines, keyword_lines, box_stats,
    )
}
_LINES = f"SELECT item_id, list_transform(range(1, len(texts) + 1), lambda i: {{'t': texts[i], 'c': confs[i], 'p': i}}) AS l FROM ({OCR})"
_C = "CASE WHEN x.c > 1 THEN x.c / 100 ELSE x.c END"
# no SQL for prompt_matches: the edit distance there counts bytes, not characters
SQL = {
    "clean_queries": _clean_sql(),
    "markets": _market_sql(),
    "script_counts": r"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(coalesce(text, ''), '[^\x{4E00}-\x{9FFF}]', '', 'g')) AS han, length(regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g')) AS digits FROM documents",
    "folder_names": r"SELECT DISTINCT topic, subtopic, coalesce(nullif(translate(subtopic, '/\:', '___'), ''), 'default') AS folder FROM data_item",
    "caption_texts": f"SELECT doc_id, coalesce({_squeeze('text')}, '') AS caption FROM documents",
    "sentence_cuts": "SELECT doc_id, " + _strip("CASE WHEN length(text) <= 200 THEN text ELSE left(regexp_replace(left(text, 201), '[^.!?]*$', ''), 200) END") + " AS cut FROM documents WHERE text IS NOT NULL",
    "template_captions": "SELECT item_id, 'A concise description of a ' || coalesce(nullif("
    + _strip("translate(coalesce(topic, ''), '_', ' ') || ' ' || translate(coalesce(subtopic, ''), '_', ' ')")
    + ", ''), 'text-centric poster') || ' focusing on layout and typography.' AS caption FROM data_item",
    "layout_captions": _LAYOUT_SQL,
    "joined_texts": f"SELECT item_id, left(coalesce(array_to_string(list_filter(list_transform(texts, lambda t: {_squeeze('t')}), lambda t: t <> ''), ' '), ''), 4000) AS joined FROM ({OCR})",
    "similarity_prompts": """SELECT topic, subtopic, CAST(i - 1 AS INT) AS pos, p[i] AS prompt FROM (SELECT topic, subtopic, ['An image about ' || topic, 'A photo related to ' || topic, 'A picture showing ' || topic,
      'An image about ' || subtopic, 'A photo related to ' || subtopic, 'A picture showing ' || subtopic, 'A picture of ' || subtopic || ' in ' || topic, 'A ' || topic || ' image about ' || subtopic] AS p FROM subtopic_pair), range(1, 9) AS r(i)""",
    "json_prompts": "SELECT item_id, json_extract_string(try_cast(prompt AS JSON), '$.scene') AS scene, json_extract_string(try_cast(prompt AS JSON), '$.place') AS place FROM data_item WHERE prompt IS NOT NULL",
    "host_report": f"SELECT {_HOST} AS host, regexp_matches({_HOST}, '{_rx(urls.STOCK)}') AS is_blocked, regexp_matches({_HOST}, '{_rx(urls.CDN)}') AS is_cdn, count(*) AS n FROM data_item GROUP BY ALL",
    "download_plan": f"""SELECT item_id, host, is_cdn, CAST(pos AS INT) AS pos, row_number() OVER (ORDER BY is_cdn DESC, pos, host, item_id) AS place, md5(source_url) || '.jpg' AS file FROM (SELECT item_id, source_url, {_HOST} AS host, regexp_matches({_HOST}, '{_rx(urls.CDN)}') AS is_cdn,
      row_number() OVER (PARTITION BY {_HOST} ORDER BY item_id) AS pos FROM data_item WHERE source_url IS NOT NULL AND NOT regexp_matches({_HOST}, '{_rx(urls.STOCK)}')) WHERE pos <= CASE WHEN is_cdn THEN 12 ELSE 4 END""",
    "ocr_stats": f"""WITH x AS (SELECT item_id, confs, texts, list_filter(l, lambda x: {_strip('x.t')} <> '') AS k FROM ({_LINES}) JOIN ({OCR}) USING (item_id))
      SELECT item_id, round(coalesce(list_sum(list_transform(k, lambda x: coalesce({_C}, 0.0))) / nullif(len(k), 0), 0.0), 6) AS avg_conf, len(k) AS n_lines,
      round(CASE WHEN len(confs) = 0 OR confs IS NULL THEN 0.0 ELSE coalesce(list_sum(list_transform(confs, lambda c: CASE WHEN c > 1 THEN c / 100 ELSE c END)) / nullif(len(list_filter(confs, lambda c: c IS NOT NULL)), 0), 'NaN'::DOUBLE) END, 6) AS legibility FROM x""",
    "watermarks": f"SELECT item_id, coalesce(len(list_filter(texts, lambda t: regexp_matches(t, '(?i)alamy'))) > 0, false) AS has_watermark FROM ({OCR})",
    "best_lines": f"SELECT item_id, array_to_string(list_transform(list_slice(list_sort(list_transform(l, lambda x: {{'c': -coalesce({_C}, 0.0), 'p': x.p, 't': x.t}})), 1, 10), lambda x: x.t), chr(10)) AS lines FROM ({_LINES})",
    "keyword_lines": f"SELECT item_id, array_to_string(list_transform(list_slice(list_filter(texts, lambda t: regexp_matches(lower(t), 'exit|price|字')), 1, 12), lambda t: {_strip('t')}), chr(10)) AS lines FROM ({OCR})",
    "important_lines": f"""WITH l AS (SELECT item_id, unnest(range(1, least(len(texts), len(boxes)) + 1)) AS p, texts, boxes FROM ({OCR})),
      h AS (SELECT item_id, p, {_strip('texts[p]')} AS t, CASE WHEN len(boxes[p]) >= 4 THEN abs(boxes[p][4][2] - boxes[p][1][2]) ELSE 20 END AS h FROM l),
      f AS (SELECT *, row_number() OVER (PARTITION BY item_id, left(lower(t), 30) ORDER BY h DESC, p) AS r FROM h WHERE t <> ''),
      k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY h DESC, p) AS n FROM f WHERE r = 1)
      SELECT o.item_id, coalesce(string_agg('"' || t || '"', chr(10) ORDER BY n) FILTER (WHERE n <= 15), '') AS lines FROM (SELECT DISTINCT item_id FROM ocr_record) o LEFT JOIN k USING (item_id) GROUP BY o.item_id""",
    "box_stats": _BOX_SQL,
}
