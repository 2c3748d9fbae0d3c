import json

import pytest
from pyspark.sql import functions as F

from loomgrain import plans, providers, schemas, sinks, sources, streaming
from loomgrain.operators import gates
from loomgrain.runtime import broadcast_if_small, release, scratch, staged
from loomgrain.thresholds import QualityGate, Settings
from tests.test_operators import GOOD, Q


def test_staging(spark):
    x = staged(spark.range(10), "t")
    assert x.count() == 10 and x.dtypes == spark.range(1).dtypes
    assert broadcast_if_small(x) is not x and broadcast_if_small(x, 5) is x
    release(spark)


def test_schemas_parse():
    for name in schemas.RECORDS:
        assert schemas.StructType.fromDDL(schemas.RECORDS[name]).fields


def test_search_source(spark):
    got = sources.searched(spark, ["cats", "dogs"], "loomgrain.providers.FakeSearch", max_images=70).collect()
    assert len(got) == 140 and {r["pos"] for r in got} == set(range(70)) and ("dogs", "dry://dogs/69", 69) in {tuple(r) for r in got}


def test_pages(spark):
    tag = '<a class="iusc big" href="x" m="{&quot;murl&quot;:&quot;http://a/1.jpg&quot;,&quot;turl&quot;:&quot;http://t/1&quot;}"></a>'
    thumb = '<a class="iusc" m="{&quot;turl&quot;:&quot;http://t/2&quot;}"></a><a class="iusc" m="{&quot;murl&quot;:&quot;ftp://x&quot;}"></a>'
    rows = [(tag + thumb + tag,), ('x "murl":"http://b/1.jpg" y',), ("nothing" + " " * 8000,), (None,)]
    df = spark.createDataFrame(rows, "html string")
    assert [r[0] for r in df.select(sources.image_links(F.col("html"))).collect()][:3] == [["http://a/1.jpg", "http://t/2"], ["http://b/1.jpg"], []]
    assert [r[0] for r in df.select(sources.is_real_page(F.col("html"))).collect()] == [False, False, True, False]
    assert sources.page_stats(df.where("html IS NOT NULL")).first()["pages"] == 3


def test_downloads(spark):
    urls = spark.createDataFrame([("http://a/1",), ("http://a/1",), ("http://a/2",), (None,)], "url string")
    have = urls.limit(1).select(sources.target_file(F.col("url")).alias("file"))
    got = sources.downloaded(urls, have, providers.FakeFetch()).collect()
    assert [(r["url"], len(r["content"]), r["error"]) for r in got] == [("http://a/2", 2048, None)]
    assert sources.downloaded(urls, have.where("false"), providers.FakeFetch(10)).where("error = 'too_small'").count() == 2
    assert sources.dry_run(spark, "q", 3).select("url").collect()[2][0] == "dry://q/2"


def test_settings_and_plans(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("bing: {x: 1}\npaths: {out: data/x}\ntopics:\n - {name: A, seed_queries: [s, '']}\n")
    c = sources.settings(str(tmp_path / "c.yaml"), {"BING_API_KEY": "k"})
    assert c["bing"]["api_key"] == "k" and c["paths"]["out"] == str(tmp_path / "data/x")
    assert sources.topics(spark, c).count() == 1
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.json").write_text(json.dumps({"topic": "t", "subtopic": "s", "prompt": "go"}))
    (tmp_path / "p/b.json").write_text("{broken")
    (tmp_path / "p/c.json").write_text(json.dumps({"topic": "t", "prompt": " "}))
    assert [tuple(r) for r in sources.prompt_plans(spark, str(tmp_path / "p")).collect()] == [("t", "s", "go")]


def test_tables(spark):
    path = scratch(spark, "sink")
    assert sources.or_empty(spark, path, "hash_index").count() == 0
    sinks.replace_table(spark.createDataFrame([("s", "a", 1), ("s", "__v", 2)], schemas.RECORDS["hash_index"]), path)
    assert sources.hash_index(spark, path).count() == 1 and sources.or_empty(spark, path, "hash_index").count() == 2
    rows = spark.createDataFrame([(i, "t", f"c{i // 2}") for i in range(20)], "i bigint, topic string, content string")
    assert sinks.split(rows, "i", 0.85).where("part = 'train'").count() == 17
    out = scratch(spark, "split")
    sinks.write_split(rows, out, "i")
    assert spark.read.json(out).where("part = 'dev'").count() == 2
    assert sorted(r["file"] for r in sinks.named(rows, "i", 5).collect())[0] == "img_0000005"
    assert sinks.named(rows, "i", mode="hash", content="content").select("file").distinct().count() == 20
    assert sources.next_number(sinks.named(rows, "i")) == 21
    acc = scratch(spark, "accepted")
    sinks.append_accepted(rows, acc)
    sinks.append_accepted(rows, acc, True)
    assert spark.read.parquet(acc).where("is_generated").count() == 20
    good, bad = sinks.validated(spark.createDataFrame([("a", "t", "9"), (None, "t", "x")], "path string, scope string, hash string"), "hash_index", ["path"])
    assert [tuple(r) for r in good.collect()] == [("t", "a", 9)] and bad.count() == 1
    totals = sinks.Totals(spark.createDataFrame([([],), (["x"],)], "reasons array<string>"))
    totals.rows.collect()
    assert totals.get() == {"checked": 2, "accepted": 1, "rejected": 1, "accept_rate": 0.5}


def test_providers(spark):
    df = spark.createDataFrame([("a",), ("b",)], "text string")
    v = providers.embedded(df, "text", providers.FakeEmbed(4)).collect()
    assert len(v[0]["embedding"]) == 4 and v[0]["embedding"] != v[1]["embedding"]
    bad = providers.mapped(df, ["text"], "n", lambda: lambda t: 1 // (t == "a"), "int").collect()
    assert [r["n"] for r in bad] == [1, None]


def test_curation_loop(spark):
    rows = [(i, f"q{i % 2}", i << 8, *tuple((GOOD | ({"words": 1} if i == 3 else {})).values())) for i in range(6)] + [(6, "q0", 1, *GOOD.values())]
    df = spark.createDataFrame(rows, "seq bigint, query string, hash bigint, " + Q).withColumn("hash", F.when(F.col("seq") == 0, 0).otherwise(F.when(F.col("seq") == 6, 1).otherwise(F.xxhash64("seq"))))
    settings = Settings(quality=QualityGate(), round_size=4)
    seen = []

    def dear(x):
        seen.append(x.count())
        return x.withColumn("codes", F.when(F.col("seq") == 5, F.array(F.lit("semantic_topic_fail"))).otherwise(F.array().cast("array<string>")))

    out = plans.curated(df, settings, [("semantic", dear)])
    got = {r["seq"]: (r["stage"], r["reasons"]) for r in out.collect()}
    assert got[6] == ("dedup", ["dedup_duplicate"]) and got[3] == ("quality", ["words_lt"]) and got[5] == ("semantic", ["semantic_topic_fail"])
    assert all(got[i] == ("accepted", []) for i in (0, 1, 2, 4)) and seen == [5]
    lib = spark.createDataFrame([], "query string, accepted bigint, checked bigint")
    f = plans.feedback(out, lib, providers.FakeLlm((("Next", '["new one", "q0"]'),)), settings)
    assert f["queries"] == ["new one", "q0"] and f["summary"].count() == 2 and f["advantage"].startswith("Pass rate down")
    pairs = spark.createDataFrame([("t", "a"), ("t", "b")], "topic string, subtopic string")
    nxt = plans.next_frontier(pairs, pairs.limit(1), df.select("query"), f["queries"])
    assert [(r["subtopic"], r["query"]) for r in nxt.collect()] == [("b", "new one")]
    assert plans.feedback(out, lib, providers.FakeLlm(), settings)["queries"] == ["q0", "q1"]


def test_gap_filling(spark):
    pairs = spark.createDataFrame([("t", "a"), ("t", "b")], "topic string, subtopic string")
    accepted = spark.createDataFrame([("t", "a")] * 3, "topic string, subtopic string")
    plan = lambda needs: needs.select(F.concat("topic", F.lit("/"), "subtopic").alias("prompt_id"), F.lit("v0").alias("prompt"))
    ok = F.array().cast("array<string>")
    generate = lambda p: p.withColumn("reasons", F.when((F.col("prompt") == "v1") | (F.col("prompt_id") == "t/a"), ok).otherwise(F.array(F.lit("words_lt"))))
    needs, done = plans.filled(pairs, accepted, 10, plan, generate, lambda failed: failed.select("prompt_id", F.lit("v1").alias("prompt")))
    assert sum(r["need"] for r in needs.collect()) == 7
    assert sorted((r["prompt_id"], r["prompt"], r["reasons"]) for r in done.collect()) == [("t/a", "v0", []), ("t/b", "v1", [])]
    lines = spark.createDataFrame([(0, "t b: 3")], "pos int, line string")
    needs, _ = plans.filled(pairs, accepted, 10, plan, generate, lambda f: f, lines, max_rounds=1)
    assert [(r["subtopic"], r["need"]) for r in needs.collect()] == [("b", 7)]


def run_stream(spark, df, make, mode="append"):
    path = scratch(spark, "stream")
    df.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    q = make(stream).writeStream.outputMode(mode).format("memory").queryName(path.rsplit("-", 1)[1]).option("checkpointLocation", scratch(spark, "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(path.rsplit("-", 1)[1]).collect()


def test_stream_rounds_equal_batch(spark):
    rows = [("s" if i % 3 else "t", i, i % 4 > 0) for i in range(700)]
    got = run_stream(spark, spark.createDataFrame(rows, "shard string, seq bigint, accepted boolean"), lambda s: streaming.rounds(s, 100))
    expected = []
    for shard in "st":
        mine = [a for x, _, a in rows if x == shard]
        expected += [(shard, k + 1, 100, sum(mine[k * 100 : k * 100 + 100])) for k in range(len(mine) // 100)]
    assert sorted((r["shard"], r["round_id"], r["processed"], r["accepted"]) for r in got) == sorted(expected)


def test_stream_first_keep_equals_one_after_another(spark):
    import random

    from tests.test_operators import greedy

    rng = random.Random(2)
    rows = [("a", i, f"p{i}", rng.getrandbits(9)) for i in range(80)]
    got = run_stream(spark, spark.createDataFrame(rows, "scope string, seq bigint, path string, hash bigint"), lambda s: streaming.keep_first(s, 1))
    expected = greedy([(i, h, "a", False) for _, i, _, h in rows], True, 1)
    assert {r["seq"]: r["dup_of"] for r in got} == {i: None if v is None else f"p{v}" for i, v in expected.items()}


def test_stream_windows(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    got = run_stream(spark, events, lambda s: streaming.windows(s, width="1 day"), "complete")
    batch = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").count().collect()
    assert {(r["window"]["start"], r["event_type"], r["n"]) for r in got} == {(r["window"]["start"], r["event_type"], r["count"]) for r in batch}


def test_stream_bans(spark):
    rows = [("h", i, float(i), False) for i in range(20)] + [("h", 20, 200.0, True)]
    got = run_stream(spark, spark.createDataFrame(rows, "host string, seq bigint, t double, ok boolean"), lambda s: streaming.host_bans(s, 15))
    assert sorted(r["seq"] for r in got if r["banned"]) == list(range(15, 20))


def test_latest_quality(spark):
    import datetime

    t = datetime.datetime(2024, 1, 1)
    q = spark.createDataFrame([(1, t, 0.5), (1, t + datetime.timedelta(1), 0.1), (1, None, 0.9), (2, None, 0.3), (None, t, 1.0), (2, None, 0.3)], "item_id bigint, assessed_at timestamp_ntz, legibility double")
    assert {r["item_id"]: r["legibility"] for r in gates.latest_quality(q).collect()} == {1: 0.1, 2: 0.3}


class Reader:
    def read(self, path):
        if path == "bad":
            raise OSError
        return [([[0, 0], [9.5, 0], [9, 5], [0, 5]], ("hello", 87)), ({"points": [[0, 0]] * 4}, "  "), ([[0, 0]], ("x", 1)), {"box": [[1, 1]] * 4, "text": "b", "conf": 0.5}, 7]


class Painter:
    def image(self, prompt, seed):
        return f"{prompt}-{seed}.png"


def test_recognisers_and_painters(spark):
    got = {r["path"]: r["ocr"] for r in providers.recognised(spark.createDataFrame([("a",), ("bad",)], "path string"), Reader()).collect()}
    assert got["a"]["texts"] == ["hello", "b"] and got["a"]["confs"] == [0.87, 0.5] and got["a"]["boxes"][0][1] == [10, 0] and got["a"]["word_count"] == 2
    assert got["bad"]["texts"] == [] and got["bad"]["error"] == "OSError"
    p = spark.createDataFrame([("x", 2)], "prompt string, idx int")
    assert providers.generated(p, Painter(), 5).first()["path"] == "x-7.png"


def test_screening_dedups_last(spark):
    rows = [(0, 1 << 8, *(GOOD | {"words": 1}).values()), (1, 1 << 8, *GOOD.values()), (2, 1 << 8, *GOOD.values())]
    df = spark.createDataFrame(rows, "seq bigint, hash bigint, " + Q)
    got = {r["seq"]: (r["stage"], r["reasons"]) for r in plans.screened(df, Settings(quality=QualityGate())).collect()}
    assert got == {0: ("quality", ["words_lt"]), 1: ("accepted", []), 2: ("dedup", ["pHash_duplicate"])}


def test_small_helpers(spark):
    from loomgrain.operators import ordering, rounds

    df = spark.createDataFrame([(i, 1, "t" if i else "u", "s", ["x"] if i < 2 else []) for i in range(5)], "seq bigint, round_id int, topic string, subtopic string, reasons array<string>")
    assert tuple(rounds.first_sample(df).first()) == (1, "t", "s")
    assert [r["worker"] for r in ordering.dealt(df, [F.col("seq").asc()], 3).orderBy("seq").collect()] == [0, 1, 2, 0, 1]
    j = spark.createDataFrame([(json.dumps({"round_id": 3, "pass_rate": 0.5, "metrics": {"semantic": {"combined": 0.7}}, "rejection_vector": [1, 2]}),), ("{}",)], "p string")
    assert [tuple(r) for r in j.select(*rounds.flat_stats(F.col("p"))).collect()] == [(3, 0.5, 0.0, 0.7, 0.0, [1.0, 2.0]), (0, 0.0, 0.0, 0.0, 0.0, [])]
    c = spark.createDataFrame([("t", "s", 4)], "topic string, subtopic string, image_count bigint")
    assert "t s: 4" in plans.allocation_prompt(c, 9) and "3 prompts" in plans.plan_prompt("t", "s", 3)


def test_streaming_keep_first_keeps_rows_without_a_hash(spark):
    rows = spark.createDataFrame([("a", 1, "p1", 5), ("a", 2, "p2", None), ("a", 3, "p3", 5)], "scope string, seq bigint, path string, hash bigint")
    got = run_stream(spark, rows, lambda s: streaming.keep_first(s, 1))
    assert {r["seq"]: r["dup_of"] for r in got} == {1: None, 2: None, 3: "p1"}
