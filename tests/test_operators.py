import collections
import random

import pytest
from pyspark.sql import functions as F

from loomgrain.operators import allocation, dedup, experience, frontier, gates, ordering, rounds, throttle
from loomgrain.thresholds import Minima, QualityGate

Q = "coverage double, legibility double, words bigint, sharpness double, char_h_mean double, char_h_cv double, line_angle_std double, centrality double, border_ratio double, char_density double, text_density double, clutter_index double, contrast double, min_side_val int, max_side_val int, aspect_ratio double, has_watermark boolean, lang string, lang_ok boolean"
GOOD = dict(coverage=0.04, legibility=0.55, words=4, sharpness=35.0, char_h_mean=10.0, char_h_cv=0.8, line_angle_std=12.0, centrality=0.35, border_ratio=0.35, char_density=80.0, text_density=1.0, clutter_index=0.18, contrast=0.08, min_side_val=512, max_side_val=4096, aspect_ratio=0.35, has_watermark=False, lang="en", lang_ok=True)


def codes(spark, gate, **change):
    row = tuple((GOOD | change).values())
    return spark.createDataFrame([row], Q).select(gates.quality_codes(gate)).first()[0]


def test_quality_gate(spark):
    g = QualityGate()
    assert codes(spark, g) == []  # a value equal to its limit passes
    assert codes(spark, g, coverage=0.03, aspect_ratio=3.5, lang_ok=False) == ["coverage_lt", "ar_gt", "lang_not_allowed"]
    assert codes(spark, g, text_density=5.0) == [] and codes(spark, g, text_density=5.0, char_density=None) == ["text_density_lt"]
    assert codes(spark, QualityGate(languages=("de",)), lang=None) == ["lang_not_allowed"]
    assert codes(spark, QualityGate.of({"min_words": 9, "x": 1})) == ["words_lt"]
    assert len(codes(spark, g, **{k: None for k in GOOD})) == 0


def test_vector_gates_and_stages(spark):
    df = spark.createDataFrame([([1.0, 0.0],), (None,)], "v array<double>")
    prompts = {"topic": [F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))], "subtopic": [F.array(F.lit(-1.0), F.lit(0.0))]}
    m = Minima(0.7, 0.1, 0.0)
    run = lambda stage, m=m: [r[0] for r in df.select(gates.vector_codes(F.col("v"), prompts, m, stage)).collect()]
    assert run("semantic") == [["semantic_subtopic_fail"], ["semantic_error"]]  # mean of 1 and 0.5 is over 0.7
    assert run("text") == [["text_subtopic_fail"], ["text_error"]]
    assert run("text", Minima(1, 1, 1, enabled=False)) == [[], []]
    x = spark.range(1).select(gates.first_failing(F.array().cast("array<string>"), F.array(F.lit("b")), F.array(F.lit("c")))).first()[0]
    assert x == ["b"]
    w = spark.createDataFrame([(["x", "(c) ALAMY stock"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in w.select(gates.has_watermark(F.col("t"))).collect()] == [True, False, False]


def outcomes(spark, reasons):
    return spark.createDataFrame([(i, f"p{i}", f"q{i % 3}", r, float(i)) for i, r in enumerate(reasons)], "seq0 bigint, path string, query string, reasons array<string>, words double")


def test_rounds(spark):
    r = rounds.with_rounds(outcomes(spark, [[] if i % 2 else ["words_lt"] for i in range(2500)]), "seq0", 1000)
    s = {x["round_id"]: (x["processed"], x["accepted"], x["rejected"], x["pass_rate"]) for x in rounds.summary(r).collect()}
    assert s == {1: (1000, 500, 500, 0.5), 2: (1000, 500, 500, 0.5), 3: (500, 250, 250, 0.5)}
    assert [x["trend"] for x in rounds.trend(rounds.summary(r)).orderBy("round_id").collect()] == [None, "up", "up"]


def test_labels_and_vector(spark):
    r = rounds.with_rounds(outcomes(spark, [["words_lt"], ["words_lt", "coverage_lt"], [], ["ar_lt"], ["ar_lt", "words_lt"], ["ocr_failed"], ["text_topic_fail", "dedup_duplicate"]]), "seq0", 100)
    v = {x["label"]: x["share"] for x in rounds.rejection_vector(r).collect()}
    assert v["quality_words_lt"] == pytest.approx(100 / 6 * 2.5, abs=1e-5) and v["quality_error"] == pytest.approx(100 / 6, abs=1e-5)
    assert v["text_topic_fail"] == v["dedup_failure"] == pytest.approx(100 / 12, abs=1e-5) and v["total_rejection_reason_count"] == 8
    assert sum(x for k, x in v.items() if k != "total_rejection_reason_count") == pytest.approx(100, abs=1e-4) and len(v) == 29
    top = rounds.top_reasons(r, 1).collect()
    assert [(x["label"], x["n"]) for x in top] == [("quality_words_lt", 3)]
    rep = {x["reason"]: (x["n"], x["examples"]) for x in rounds.reason_report(r, "seq0", "path", 2).collect()}
    assert rep["words_lt"] == (3, ["p0", "p1"])
    lists = rounds.query_lists(r).first()
    assert lists["accepted_queries"] == ["q2"] and lists["rejected_queries"] == ["q0", "q1", "q2"]
    assert rounds.metric_means(r, ("words",)).first()["words"] == 3.0


def test_rounds_without_rejects_and_empty(spark):
    r = rounds.with_rounds(outcomes(spark, [[]]), "seq0")
    assert sum(x["share"] for x in rounds.rejection_vector(r).collect()) == 0
    assert rounds.summary(rounds.with_rounds(outcomes(spark, []), "seq0")).collect() == []


def test_experience(spark):
    new = experience.tallies(outcomes(spark, [[], ["x"], [], [], ["x"], ["x"]]))
    old = spark.createDataFrame([("q0", 1, 4), ("old", 9, 9)], "query string, accepted bigint, checked bigint")
    lib = experience.accumulated(old, new)
    assert [(r["query"], r["pass_rate"]) for r in experience.top_queries(lib, 2).collect()] == [("old", 1.0), ("q0", 0.5)]
    c = spark.createDataFrame([("a", 0.5, 1, "accepted", 1), ("a", 0.9, 2, "rejected", 2), (" a ", None, 3, "x", 3), ("b", None, 1, "accepted", 4)], "query string, score double, round int, status string, ord int")
    m = {r["query"]: tuple(r)[1:] for r in experience.merged(c).collect()}
    assert m["a"] == (0.9, 2, "rejected") and m["b"][0] is None
    assert [r["query"] for r in experience.trimmed(c, 5).collect()] == ["a", "b"]
    assert experience.accepted_only(c).count() == 2 and [r["round"] for r in experience.last_rows(c, 1).collect()] == [3]
    assert experience.strategy_due(3, 2, True) and not experience.strategy_due(1, 2, True)
    stats = spark.createDataFrame([({"words": 1.0, "x": 2.0, "coverage": None},)], "m map<string,double>")
    assert experience.compressed(stats, "m", ("words", "coverage")).first()["m"] == {"words": 1.0}


def counts(spark, rows):
    return spark.createDataFrame([(t, s, n) for (t, s), n in rows.items()], "topic string, subtopic string, image_count bigint")


def need(df):
    return {(r["topic"], r["subtopic"]): r["need"] for r in df.collect()}


def test_allocation(spark):
    c = counts(spark, {("a", "x"): 5, ("a", "y"): 0, ("b", "z"): 2})
    assert need(allocation.uniform(c, 11)) == {("a", "x"): 4, ("a", "y"): 4, ("b", "z"): 3}
    assert need(allocation.inverse(c, 11)) == {("a", "y"): 6, ("b", "z"): 3, ("a", "x"): 2}
    assert allocation.gap(c, 10).first()["gap"] == 3 and allocation.gap(c, 1).first()["gap"] == 0
    n = spark.createDataFrame([("a", "x", 5), ("a", "y", 5), ("b", "z", 5)], "topic string, subtopic string, need bigint")
    assert need(allocation.scaled(n, 10)) == {("a", "x"): 3, ("a", "y"): 3, ("b", "z"): 4}  # the rest to the greatest name
    assert need(allocation.scaled(n, 0)) == {("a", "x"): 0, ("a", "y"): 0, ("b", "z"): 0}
    capped = n.withColumn("room", F.when(F.col("topic") == "b", 2).cast("bigint"))
    assert need(allocation.scaled(capped, 20)) == {("a", "x"): 9, ("a", "y"): 9, ("b", "z"): 2}
    tight = n.withColumn("room", F.lit(6).cast("bigint"))
    assert need(allocation.scaled(tight, 99)) == {("a", "x"): 6, ("a", "y"): 6, ("b", "z"): 6}


@pytest.mark.parametrize("seed", range(3))
def test_allocation_sums_to_the_gap(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), str(i), rng.randrange(30)) for i in range(25)]
    n = spark.createDataFrame(rows, "topic string, subtopic string, need bigint")
    for amount in (rng.randrange(1, 300), 2000):
        assert sum(need(allocation.scaled(n, amount)).values()) == amount


def test_allocation_lines(spark):
    lines = ["Topic Sub: need 5 more", "x", "A b: -3", "Long Topic q r: 7", "Long Topic q r: 8 or 9", "nothing:", None, "solo: 3", "Topic: 4"]
    df = spark.createDataFrame(list(enumerate(lines)), "pos int, line string")
    pairs = spark.createDataFrame([("Topic", "s"), ("Long Topic", "t"), ("Long", "u")], "topic string, subtopic string")
    assert need(allocation.parsed_needs(df, pairs)) == {("Topic", "Sub"): 5, ("A", "b"): 0, ("Long Topic", "q r"): 8}


def test_frontier(spark):
    conf = spark.createDataFrame([("a", ["x", "", "y"]), ("", ["z"]), ("b", [])], "topic string, seed_queries array<string>")
    p = frontier.pairs(conf)
    assert sorted(tuple(r) for r in p.collect()) == [("a", "x"), ("a", "y")]
    assert frontier.remaining(p, p.where("subtopic = 'x'"), p.where("false")).collect() == [("a", "y")]
    v = spark.createDataFrame([(["b", " a "], ["a", None, ""], "s"), (None, None, "s")], "b array<string>, m array<string>, s string")
    assert [r[0] for r in v.select(frontier.variants(F.col("b"), F.col("m"), F.col("s"))).collect()] == [["b", "a"], ["s"]]
    q = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "i int, query string")
    assert frontier.not_issued(q, q.where("i = 3"), "i").select("i", "query").collect() == [(1, "x")]
    f = spark.createDataFrame([(10, 1, "a"), (1, 5, "b"), (1, 7, "c")], "priority int, enqueued_at int, query string")
    assert [r["query"] for r in frontier.in_order(f).collect()] == ["c", "b", "a"]
    seen = spark.createDataFrame([("t", "u1"), ("full", "u1"), ("full", "u2")], "scope string, url string")
    urls = spark.createDataFrame([("t", "u1"), ("t", "u2"), ("full", "u1")], "scope string, url string")
    assert sorted(tuple(r) for r in frontier.unseen_urls(urls, seen, ["scope"], 2).collect()) == [("full", "u1"), ("t", "u2")]
    t = spark.createDataFrame([(1, "a"), (2, "b")], "pos int, topic string")
    assert frontier.fan_out(t, q.where("query IS NOT NULL")).count() == 2 and frontier.fan_out(t, q.where("query IS NOT NULL"), each=True).count() == 4
    assert frontier.per_group(urls, ["scope"], "url", 1).count() == 2 and frontier.static_fallback(p, p.select("topic", F.lit("seed").alias("query")).distinct()).count() == 2
    assert frontier.refill(5, 30, 3) == 3 and frontier.starving(200, 0, False) and not frontier.starving(200, 0, True)


def greedy(rows, scoped, d=3):
    kept, out = collections.defaultdict(list), {}
    for i, h, scope, rel in sorted(rows):
        if h is None:
            out[i] = None
            continue
        near = [f for v, f in kept[scope if scoped else 0] if ((v ^ h) & (1 << 64) - 1).bit_count() <= d]
        out[i] = min(near) if near else None
        if not near and not rel:
            kept[scope if scoped else 0].append((h, i))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_keep_first_equals_one_after_another(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.getrandbits(7) if rng.random() < 0.95 else None, rng.choice("ab"), rng.random() < 0.3) for i in range(90)]
    df = spark.createDataFrame(rows, "i bigint, hash bigint, scope string, rel boolean")
    got = {r["i"]: r["dup_of"] for r in dedup.keep_first(df, ["scope"], "i", 1, "rel").collect()}
    assert got == greedy(rows, True, 1)


def test_keep_first_chain_release_and_index(spark):
    rows = [(1, 0b0, "s", False), (2, 0b111, "s", False), (3, 0b111111, "s", False), (4, None, "s", False)]
    df = spark.createDataFrame(rows, "i bigint, hash bigint, scope string, rel boolean")
    assert {r["i"]: r["dup_of"] for r in dedup.keep_first(df, [], "i").collect()} == {1: None, 2: 1, 3: None, 4: None}
    freed = df.withColumn("rel", F.col("i") == 1)
    assert {r["i"]: r["dup_of"] for r in dedup.keep_first(freed, [], "i", releases="rel").collect()} == {1: None, 2: None, 3: 2, 4: None}
    assert dedup.keep_first(df.where("false"), [], "i").collect() == []
    again = df.unionByName(df.withColumn("i", F.col("i") + 10))
    assert sorted(r["i"] for r in dedup.cleaned(again, ["scope"], "i").collect()) == [1, 2, 3, 4, 14]
    index = spark.createDataFrame([("s", "a", 1), ("s", "__meta", 0), ("s", "b", 2)], "scope string, path string, hash bigint")
    new = spark.createDataFrame([("s", "a", 9)], "scope string, path string, hash bigint")
    assert sorted(tuple(r) for r in dedup.upserted(index, new).collect()) == [("s", "a", 9), ("s", "b", 2)]


def test_positions(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), i) for i in rng.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "g string, i bigint")
    s = sorted(i for _, i in rows)
    assert {r["i"]: r["n"] for r in ordering.numbered(df, [F.col("i").asc()], "n").collect()} == {i: k + 1 for k, i in enumerate(s)}
    got = ordering.numbered(df, [F.col("g").asc(), F.col("i").asc()], "n", ["g"]).collect()
    for g in "ab":
        assert sorted((r["n"], r["i"]) for r in got if r["g"] == g) == list(enumerate(sorted(i for x, i in rows if x == g), 1))


def test_throttles(spark):
    log = [("w", i, i < 160 or i >= 400) for i in range(560)]
    got = {r["seq"]: r["level"] for r in throttle.adaptive_concurrency(spark.createDataFrame(log, "worker string, seq bigint, ok boolean")).collect()}
    assert [got[i] for i in (78, 79, 159, 239, 319, 399)] == [8, 10, 12, 12, 12, 10]
    waits = [r["wait"] for r in throttle.token_bucket(spark.createDataFrame([("w", i, 0.0) for i in range(5)], "worker string, seq bigint, t double"), 2.0).orderBy("seq").collect()]
    assert waits == pytest.approx([0, 0, 0.5, 1.0, 1.5])
    rows = [("h", i, float(i), "fail") for i in range(20)] + [("h", 20, 105.0, "ok"), ("r", 0, 0.0, "timeout"), ("r", 1, 1.0, "timeout"), ("r", 2, 2.0, "timeout"), ("r", 3, 3.0, "ok"), ("r", 4, 50.0, "ok")]
    banned = {(r["host"], r["seq"]) for r in throttle.host_bans(spark.createDataFrame(rows, "host string, seq bigint, t double, outcome string")).where("banned").collect()}
    assert banned == {("h", i) for i in range(15, 20)} | {("r", 3)}
    assert throttle.cooldown(3) == 8 and throttle.cooldown(99, 4) == 60 and throttle.stalled(10, 5)


def test_nan_is_over_no_limit(spark):
    from loomgrain.thresholds import QualityGate

    nan = float("nan")
    cols = ("char_h_cv", "line_angle_std", "border_ratio", "clutter_index", "aspect_ratio")
    others = ("coverage", "legibility", "sharpness", "char_h_mean", "centrality", "char_density", "text_density", "contrast")
    schema = ", ".join(f"{c} double" for c in (*cols, *others)) + ", words bigint, min_side_val int, max_side_val int, has_watermark boolean, lang string, lang_ok boolean"
    row = (*[nan] * len(cols), *[1000.0] * len(others), 50, 600, 800, False, "en", True)
    assert spark.createDataFrame([row], schema).select(gates.quality_codes(QualityGate()).alias("c")).first()["c"] == []


def test_index_rows_without_a_scope_stay(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, None, 5), (3, "a", 5), (4, None, None), (5, None, 6)], "item_id bigint, scope string, hash bigint")
    assert sorted(r[0] for r in dedup.cleaned(rows, ["scope"], "item_id").select("item_id").collect()) == [1, 3, 4, 5]


def test_pairs_remain_where_nothing_was_delivered(spark):
    p = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "topic string, subtopic string")
    done = spark.createDataFrame([("a", "x"), ("A", "y"), (None, "z")], "topic string, subtopic string")
    assert sorted(map(tuple, frontier.remaining(p, done).collect())) == [("a", "y"), ("b", "z")]


def test_download_plan_puts_networks_first(spark):
    from loomgrain.functions import urls

    rows = [(i, f"https://h{i % 2}.org/{i}") for i in range(20)] + [(100 + i, f"https://x.imgur.com/{i}") for i in range(20)] + [(200, None), (201, "https://alamy.com/1")]
    got = urls.download_plan(spark.createDataFrame(rows, "item_id bigint, url string"), "url", "item_id", 4).orderBy("place").collect()
    assert [r["is_cdn"] for r in got] == [True] * 12 + [False] * 8 and [r["place"] for r in got] == list(range(1, 21))
