"""DuckDB SQL for the pN_ queries that SQL can express."""

KEY = "lower(upper(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')))"

_SCORED = f"""
WITH last_at AS (SELECT item_id, max(assessed_at) AS at FROM quality_record GROUP BY item_id),
score AS (
  SELECT q.item_id, max(q.legibility) AS score FROM quality_record q JOIN last_at l ON q.item_id = l.item_id AND q.assessed_at = l.at GROUP BY q.item_id
), scored AS (
  SELECT d.item_id, {KEY.format('d.topic')} AS t, s.score FROM data_item d JOIN score s USING (item_id)
  WHERE d.topic IS NOT NULL AND s.score IS NOT NULL AND NOT isnan(s.score) AND s.score BETWEEN 0 AND 1
), goal AS (SELECT topic, {KEY.format('topic')} AS t, keep_permille FROM keep_target),
n AS (SELECT t, count(*) AS n FROM scored GROUP BY t),
ranked AS (SELECT t, score, row_number() OVER (PARTITION BY t ORDER BY score DESC) AS r FROM scored),
cut AS (
  SELECT g.topic, g.t, g.keep_permille, n.n, r.score AS cutoff FROM goal g JOIN n USING (t)
  LEFT JOIN ranked r ON r.t = g.t AND r.r = (n.n * g.keep_permille + 999) // 1000
)
"""

_LEAVES = f"""
WITH available AS (
  SELECT {KEY.format('topic')} AS t, {KEY.format('subtopic')} AS s, is_generated AS g, count(*) AS n
  FROM data_item WHERE topic IS NOT NULL AND subtopic IS NOT NULL AND is_generated IS NOT NULL GROUP BY ALL
), wanted AS (
  SELECT topic, subtopic, is_generated, {KEY.format('topic')} AS t, {KEY.format('subtopic')} AS s,
    greatest(min_rows, (((SELECT count(*) FROM data_item) // 10) * share_ppm) // 1000000) AS wanted FROM sample_target
), leaf AS (
  SELECT w.*, coalesce(a.n, 0) AS available, least(wanted, coalesce(a.n, 0)) AS allocated, wanted - least(wanted, coalesce(a.n, 0)) AS open
  FROM wanted w LEFT JOIN available a ON a.t = w.t AND a.s = w.s AND a.g = w.is_generated
)"""


def _handed_on(source: str, name: str, scope: str) -> str:
    """What leaves leave open goes to those of the same ``scope`` by the rows they have to spare: largest remainder, ties by name."""
    over = f"PARTITION BY {scope}"
    return f""",
{name}_a AS (SELECT *, sum(available - allocated) OVER ({over}) AS spares, least(sum(open) OVER ({over}), sum(available - allocated) OVER ({over})) AS give FROM {source}),
{name}_b AS (SELECT *, CASE WHEN spares > 0 THEN (give * (available - allocated)) // spares ELSE 0 END AS base, CASE WHEN spares > 0 THEN (give * (available - allocated)) % spares ELSE 0 END AS frac FROM {name}_a),
{name}_c AS (
  SELECT *, row_number() OVER ({over} ORDER BY frac DESC, t, s, is_generated) AS pos, give - sum(base) OVER ({over}) AS rest,
    coalesce(sum(open) OVER ({over} ORDER BY t, s, is_generated ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {name}_b
), {name} AS (
  SELECT topic, subtopic, is_generated, t, s, wanted, available, allocated + base + CASE WHEN pos <= rest AND frac > 0 THEN 1 ELSE 0 END AS allocated,
    open - greatest(0, least(open, give - before)) AS open FROM {name}_c
)"""


_P6 = _LEAVES + "SELECT topic, subtopic, CAST(is_generated AS INT) AS is_generated FROM leaf WHERE open > 0"
_QUOTA = _LEAVES + _handed_on("leaf", "sibling", "t, s") + _handed_on("sibling", "cousin", "t") + _handed_on("cousin", "quota", "0")

_NAMES = r"scene|lettering|material|sign[^\p{L}\p{N}]*colour|frame[^\p{L}\p{N}]*colour|place|size"
_LABEL = r"""[\s"''*_]*[:=]"""
_KEYED = rf"""
WITH r AS (
  SELECT item_id, coalesce({KEY.format('query')}, '') AS q, coalesce(prompt, '') AS p,
    CASE WHEN starts_with(ltrim(prompt), '{{{{') THEN try_cast(prompt AS JSON) END AS j FROM data_item
), x AS (
  SELECT *, CASE WHEN json_type(j) = 'OBJECT' THEN list_transform(json_keys(j), lambda k: {KEY.format('k')} || '=' || {KEY.format("coalesce(json_extract_string(j, '$.\"' || k || '\"'), '')")})
    WHEN len(regexp_extract_all(p, '(?i)({_NAMES}){_LABEL}', 1)) >= 2 THEN
      list_transform(list_zip(regexp_extract_all(p, '(?i)({_NAMES}){_LABEL}', 1), regexp_split_to_array(p, '(?i)(?:{_NAMES}){_LABEL}')[2:]), lambda z: {KEY.format('z[1]')} || '=' || {KEY.format('z[2]')}) END AS f FROM r
), k AS (
  SELECT item_id, q, CASE WHEN f IS NOT NULL THEN 'N' || array_to_string(list_sort(list_distinct(f)), '|') WHEN {KEY.format('p')} = '' THEN '' ELSE 'F' || {KEY.format('p')} END AS p FROM x
), g AS (SELECT item_id, min(item_id) OVER (PARTITION BY q, p) AS first_id FROM k WHERE q <> '' OR p <> '')
""".replace("{{", "{").replace("}}", "}")

_FILE = r"replace(url_decode(replace(image_path, '+', '%2B')), '\', '/')"
for _ in range(4):
    _FILE = rf"regexp_replace({_FILE}, '(^|/)(\.?/)+', '\1', 'g')"
    _FILE = rf"regexp_replace({_FILE}, '[^/]+/\.\./', '', 'g')"
_P3 = f"""
WITH RECURSIVE r AS (
  SELECT d.item_id, d.batch_no, nullif(regexp_extract(lower(content_sha1), '([0-9a-f]{{40}})', 1), '') AS dg, d.shard || chr(0) || {_FILE} AS f, h.hash
  FROM data_item d LEFT JOIN hash_index h USING (item_id)
), u AS (SELECT hash, min(item_id) AS i FROM r WHERE hash IS NOT NULL GROUP BY hash),
e AS (
  SELECT min(item_id) OVER (PARTITION BY dg) AS a, item_id AS b FROM r WHERE dg IS NOT NULL
  UNION SELECT min(item_id) OVER (PARTITION BY f), item_id FROM r WHERE f IS NOT NULL
  UNION SELECT min(item_id) OVER (PARTITION BY hash), item_id FROM r WHERE hash IS NOT NULL
  UNION SELECT x.i, y.i FROM u x JOIN u y ON x.i < y.i AND bit_count(xor(x.hash, y.hash)) <= 3
), s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
c AS (SELECT DISTINCT a AS v, a AS root FROM s UNION SELECT s.b, c.root FROM c JOIN s ON s.a = c.v)
SELECT min(root) AS kept_id, v AS item_id FROM c JOIN r ON r.item_id = c.v WHERE batch_no >= 1 GROUP BY v HAVING min(root) < v
"""

SQL = {
    "p1_found": _KEYED + "SELECT first_id, item_id FROM g WHERE first_id <> item_id",
    "p1_records": _KEYED + "SELECT first_id, count(*) AS n_rows FROM g GROUP BY first_id",
    "p3_found": _P3,
    "p4_found": _SCORED + "SELECT s.item_id FROM scored s JOIN cut c USING (t) WHERE s.score >= c.cutoff",
    "p4_report": _SCORED
    + """SELECT g.topic, g.keep_permille, c.cutoff, coalesce(c.n, 0)::BIGINT AS n_scored,
      coalesce((SELECT count(*) FROM scored s WHERE s.t = g.t AND s.score >= c.cutoff), 0)::BIGINT AS n_kept
    FROM goal g LEFT JOIN cut c USING (t)""",
    "p6_found": _P6,
    "p6_counts": _QUOTA + "SELECT topic, subtopic, CAST(is_generated AS INT) AS is_generated, allocated::BIGINT AS n FROM quota WHERE allocated > 0",
    "p6_report": _QUOTA
    + """SELECT topic, subtopic, CAST(is_generated AS INT) AS is_generated, wanted::BIGINT AS wanted, available::BIGINT AS available, allocated::BIGINT AS allocated,
      greatest(0, wanted - available)::BIGINT AS short, open::BIGINT AS unmet FROM quota""",
}
