"""Monitoring views over the event stream, and the star-schema smoke query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.operators import experience, throttle
from loomgrain.runtime import load


def _events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    x = _events(spark, d).groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return x.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    x = _events(spark, d).groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count(F.lit(1)).alias("n"))
    return x.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def failure_counts(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent kinds first."""
    return load(spark, d, "events", "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type")


def event_props(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events", "event_id", "props").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


def daily_rates(spark: SparkSession, d: str) -> DataFrame:
    """Events a second from one daily snapshot to the next."""
    day = load(spark, d, "events", "ts").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    x = experience.snapshots(day, "day", "n")
    return x.select(F.col("day").cast("timestamp_ntz").alias("day"), "n", F.round("n_per_s", 8).alias("n_per_s"))


def concurrency_levels(spark: SparkSession, d: str) -> DataFrame:
    """G11 per event type: an event with a value over 20 is a success."""
    log = load(spark, d, "events", "event_id", "event_type", "value").select(F.col("event_type").alias("worker"), F.col("event_id").alias("seq"), (F.col("value") > 20).alias("ok"))
    return throttle.adaptive_concurrency(log)


def request_waits(spark: SparkSession, d: str) -> DataFrame:
    """G10 per user, one request a minute."""
    t = F.unix_micros(F.col("ts")) / 1e6
    log = _events(spark, d).select(F.col("user_id").cast("string").alias("worker"), F.col("event_id").alias("seq"), t.alias("t"))
    return throttle.token_bucket(log, 1 / 60).withColumn("wait", F.round("wait", 3))


def bans(spark: SparkSession, d: str) -> DataFrame:
    """G12, G13 per event type as host: small values are timeouts."""
    v = F.col("value")
    log = _events(spark, d).select(F.col("event_type").alias("host"), F.col("event_id").alias("seq"), (F.unix_micros("ts") / 1e6).alias("t"), F.when(v < 5, "timeout").when(v < 20, "fail").otherwise("ok").alias("outcome"))
    return throttle.host_bans(log)


def revenue_by_region(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    o = load(spark, d, "orders", "o_orderkey", "o_custkey")
    c = load(spark, d, "customer", "c_custkey", "c_nationkey")
    n, r = load(spark, d, "nation", "n_nationkey", "n_regionkey"), load(spark, d, "region", "r_regionkey", "r_name")
    x = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return x.groupBy("r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0).alias("revenue"), F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (event_windows, event_sessions, failure_counts, event_props, daily_rates, concurrency_levels, request_waits, bans, revenue_by_region)}
_T = "epoch_us(ts) / 1e6"
SQL = {
    "concurrency_levels": """WITH RECURSIVE e AS (SELECT event_type AS worker, event_id AS seq, row_number() OVER w AS n, count(*) FILTER (WHERE value > 20) OVER w AS ok FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
      c AS (SELECT worker, n // 80 AS k, ok / n AS rate FROM e WHERE n % 80 = 0),
      l AS (SELECT DISTINCT worker, 0::BIGINT AS k, 8 AS level FROM e UNION ALL SELECT l.worker, c.k, CASE WHEN rate < 0.5 THEN greatest(2, level - 2) WHEN rate > 0.8 THEN least(32, level + 2) ELSE level END FROM l JOIN c ON c.worker = l.worker AND c.k = l.k + 1)
      SELECT e.worker, e.seq, l.level FROM e JOIN l ON l.worker = e.worker AND l.k = e.n // 80""",
    "request_waits": f"""WITH RECURSIVE e AS (SELECT user_id, event_id AS seq, {_T} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
      g AS (SELECT k, user_id, seq, t, t AS since, 1 / 60::DOUBLE AS have FROM e WHERE k = 1),
      s AS (SELECT k, user_id, seq, t, since + CASE WHEN have < 1 THEN (1 - have) / (1 / 60::DOUBLE) ELSE 0 END AS since, greatest(have, 1) - 1 AS have FROM g
        UNION ALL SELECT k, user_id, seq, t, since + CASE WHEN have < 1 THEN (1 - have) / (1 / 60::DOUBLE) ELSE 0 END, greatest(have, 1) - 1
          FROM (SELECT e.k, e.user_id, e.seq, e.t, greatest(e.t, s.since) AS since, least(1 / 60::DOUBLE, s.have + (greatest(e.t, s.since) - s.since) / 60) AS have FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1))
      SELECT user_id::VARCHAR AS worker, seq, round(since - t, 3) AS wait FROM s""",
    "bans": f"""WITH RECURSIVE e AS (SELECT event_type AS host, event_id AS seq, {_T} AS t, CASE WHEN value < 5 THEN 'timeout' WHEN value < 20 THEN 'fail' ELSE 'ok' END AS o, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
      s AS (SELECT DISTINCT host, 0::BIGINT AS k, NULL::BIGINT AS seq, 0 AS fails, 0 AS outs, 0 AS oks, 0::DOUBLE AS til, false AS banned FROM e
        UNION ALL SELECT host, k, seq, f, u, g, CASE WHEN banned THEN til WHEN o = 'ok' THEN CASE WHEN til > 0 THEN 0 ELSE til END WHEN f >= 15 THEN t + 90 WHEN u >= 3 AND g = 0 THEN t + 45 ELSE 0 END, banned
          FROM (SELECT *, CASE WHEN banned THEN fails ELSE CASE WHEN til > 0 THEN 0 ELSE fails END + CASE WHEN o <> 'ok' THEN 1 ELSE 0 END END AS f,
              CASE WHEN banned THEN outs ELSE CASE WHEN til > 0 THEN 0 ELSE outs END + CASE WHEN o = 'timeout' THEN 1 ELSE 0 END END AS u, CASE WHEN banned OR o <> 'ok' THEN oks ELSE oks + 1 END AS g
            FROM (SELECT e.host, e.k, e.seq, e.t, e.o, s.fails, s.outs, s.oks, s.til, e.t < s.til AS banned FROM s JOIN e ON e.host = s.host AND e.k = s.k + 1)))
      SELECT host, seq, banned FROM s WHERE k > 0""",
    "event_windows": "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "event_sessions": "WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOURS THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k",
    "failure_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type",
    "event_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "daily_rates": "WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*)::DOUBLE AS n FROM events GROUP BY 1) SELECT day, n, round((n - lag(n) OVER (ORDER BY day)) / epoch(day - lag(day) OVER (ORDER BY day)), 8) AS n_per_s FROM d",
    "revenue_by_region": "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
}
