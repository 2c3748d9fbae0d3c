import math
import random
from collections import Counter, defaultdict

import pytest

from loomgrain.llm import cutoffs, mixing, proportional

ITEM = "item_id bigint, topic string, subtopic string, is_generated boolean, score double, k int, rank int"
Q = "item_id bigint, assessed_at timestamp_ntz, legibility double, topic string, at int"


def at(n):
    import datetime

    return None if n is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=n)


def run_cutoffs(spark, items, quality, targets):
    i = spark.createDataFrame([(a, t, None, None, 0.0, 0, 0) for a, t in items], ITEM)
    q = spark.createDataFrame([(a, at(n), s, "z", 0) for a, n, s in quality], Q)
    t = spark.createDataFrame(targets, "topic string, keep_permille int")
    kept, report = cutoffs.cutoffs(i, q, t)
    return sorted(r[0] for r in kept.collect()), {r["topic"]: tuple(r)[1:] for r in report.collect()}


def test_cutoff_by_latest_score_with_ties(spark):
    items = [(i, "A_b") for i in range(1, 8)] + [(8, "a-B"), (9, None), (10, "other"), (None, "A_b")]
    quality = [(1, 0, 0.9), (1, 5, 0.1), (2, 0, 0.5), (3, 0, 0.5), (4, 0, 0.5), (5, 0, float("nan")), (6, 0, 1.2), (7, 0, None), (8, None, 0.8), (9, 0, 0.7), (10, 0, 0.4), (2, 0, 0.5), (None, 0, 0.3)]
    kept, report = run_cutoffs(spark, items, quality, [("A_b", 300), ("none", 500), ("other", 0), (None, 10)])
    # scored: 0.1, 0.5, 0.5, 0.5, 0.8; k = 2: the cutoff is 0.5 and its ties stay
    assert kept == [2, 3, 4, 8]
    assert report == {"A_b": (300, 0.5, 5, 4), "none": (500, None, 0, 0), "other": (0, None, 1, 0)}


def test_cutoff_of_empty_tables(spark):
    assert run_cutoffs(spark, [], [], []) == ([], {})
    assert run_cutoffs(spark, [(1, "a")], [], [("a", 500)]) == ([], {"a": (500, None, 0, 0)})


def test_cutoff_matches_brute_force_with_a_hot_topic(spark):
    rng = random.Random(2)
    items = [(i, rng.choice(["hot"] * 5 + ["x", "y"])) for i in range(1500)]
    quality = [(i, 0, rng.choice([0.5, round(rng.random(), 2), None])) for i in range(1500)]
    targets = [("hot", 333), ("x", 1), ("y", 1000)]
    score = dict((i, s) for i, _, s in quality)
    expected = []
    for t, p in targets:
        s = sorted(((score[i], i) for i, x in items if x == t and score[i] is not None), reverse=True)
        cut = s[math.ceil(len(s) * p / 1000) - 1][0]
        expected += [i for v, i in s if v >= cut]
    assert run_cutoffs(spark, items, quality, targets)[0] == sorted(expected)


def run_sample(spark, items, targets, **kw):
    i = spark.createDataFrame([(*r, 0.0, 0, 0) for r in items], ITEM)
    t = spark.createDataFrame(targets, "topic string, subtopic string, is_generated boolean, share_ppm int, min_rows int")
    quota = proportional.allocate(i, t, **kw).collect()
    drawn = proportional.sample(i, t, **kw).collect()
    short = sorted(tuple(r) for r in proportional.shortfalls(i, t, **kw).collect())
    return {(r["topic"], r["subtopic"], r["is_generated"]): r for r in quota}, drawn, short


def test_quota_goes_to_siblings_then_cousins(spark):
    items = [(i, "A", "a1", True) for i in range(10)] + [(10 + i, "a", "A-1", False) for i in range(15)]
    items += [(100 + i, "A", "a2", True) for i in range(300)] + [(500 + i, "B", "b1", False) for i in range(300)]
    items += [(900, None, "a1", True), (901, "A", None, True), (902, "A", "a1", None), (903, "Z", "z", True)]
    targets = [("A", "a1", True, 500_000, 1), ("A", "a1", False, 10_000, 0), ("A", "a2", True, 200_000, 0), ("B", "b1", False, 290_000, 0), ("C", "c", False, 0, 2), (None, "x", True, 1, 1)]
    quota, drawn, short = run_sample(spark, items, targets)
    # 629 rows: 62 wanted in all; 31 + 0 + 12 + 17, and 2 of the minimum
    assert quota["A", "a1", 1]["wanted"] == 31 and quota["A", "a1", 1]["allocated"] == 10
    assert quota["A", "a1", 0]["allocated"] == 15  # all that the sibling can spare
    assert quota["A", "a2", 1]["allocated"] >= 12 + 6  # the rest to the cousin
    assert quota["B", "b1", 0]["allocated"] + quota["A", "a2", 1]["allocated"] == 17 + 18 + 2  # what C lacks goes to the rest of the tree
    assert short == [("A", "a1", 1), ("C", "c", 0)]
    got = Counter((r["topic"], r["subtopic"], r["is_generated"]) for r in drawn)
    assert got == {k: r["allocated"] for k, r in quota.items() if r["allocated"]}
    assert len({r["item_id"] for r in drawn}) == len(drawn)


def test_quota_of_very_large_counts(spark):
    """Products of counts do not fit into 64 bits."""
    rows = [("t", "s", g, "T", "S", g, n * 10**9, m * 10**9, min(n, m) * 10**9, max(0, n - m) * 10**9, max(0, n - m) * 10**9) for g, n, m in ((0, 8, 3), (1, 1, 7))]
    df = spark.createDataFrame(rows, "t string, s string, g int, topic string, subtopic string, is_generated int, wanted bigint, available bigint, allocated bigint, short bigint, open bigint")
    got = {r["g"]: (r["allocated"], r["open"]) for r in proportional._pass_on(df, ["t", "s"]).collect()}
    assert got == {0: (3 * 10**9, 0), 1: (6 * 10**9, 0)}


def test_sample_is_repeatable_and_changes_with_the_seed(spark):
    items = [(i, "A", "a", i % 2 == 0) for i in range(2000)]
    targets = [("A", "a", True, 700_000, 0), ("A", "a", False, 300_000, 0)]
    pick = lambda seed: {r["item_id"] for r in run_sample(spark, items, targets, **seed)[1]}
    i = spark.createDataFrame([(*r, 0.0, 0, 0) for r in items], ITEM)
    t = spark.createDataFrame(targets, "topic string, subtopic string, is_generated boolean, share_ppm int, min_rows int")
    again = {r["item_id"] for r in proportional.sample(i, t, seed=0).collect()}
    assert pick({}) == again and len(again) == 200
    assert {r["item_id"] for r in proportional.sample(i, t, seed=1).collect()} != again


def test_sample_of_empty_tables(spark):
    assert run_sample(spark, [], [("A", "a", True, 10, 0)])[1:] == ([], [])
    assert run_sample(spark, [], [("A", "a", True, 10, 3)])[1:] == ([], [("A", "a", 1)])
    assert run_sample(spark, [(1, "A", "a", True)], [])[1:] == ([], [])


def run_mix(spark, docs, targets, **kw):
    d = spark.createDataFrame([(*r, 1, 1.0) for r in docs], "doc_id bigint, text string, source string, tokens int, finish double")
    t = spark.createDataFrame(targets, "source string, weight_permille int, max_repeat int")
    m, r = mixing.mix(d, t, **kw)
    return sorted(m.collect(), key=lambda x: x["start"]), {x["source"]: x for x in r.collect()}


def test_mix_reaches_weights_within_a_document(spark):
    docs = [(i, "one two three four", rng) for i, rng in enumerate(["a"] * 200 + ["b"] * 200)]
    mixture, report = run_mix(spark, docs, [("a", 750, 3), ("b", 250, 1), ("none", 10, 2)])
    assert sum(r["tokens"] for r in mixture) == 1600
    assert report["a"]["share_permille"] == pytest.approx(750, abs=5) and report["b"]["share_permille"] == pytest.approx(250, abs=5)
    assert report["a"]["max_copies"] == 2 and not report["a"]["exhausted"] and report["none"]["n_docs"] == 0
    assert [r["start"] for r in mixture] == [4 * i for i in range(400)]


def test_mix_caps_repeats_and_leaves_the_rest_to_others(spark):
    docs = [(1, "small source", "s"), (2, None, "s"), (3, "", "s"), (None, "x y", "s"), (9, "lost", None)] + [(100 + i, "many words in here", "b") for i in range(100)]
    mixture, report = run_mix(spark, docs, [("s", 900, 3), ("b", 100, 2), (None, 5, 1), ("off", 0, 9)])
    n = Counter((r["doc_id"], r["copy_no"]) for r in mixture)
    assert max(n.values()) == 1 and {k for k in n if k[0] == 1} == {(1, 1), (1, 2), (1, 3)}
    assert report["s"]["exhausted"] and report["s"]["max_copies"] == 3
    assert len({r["doc_id"] for r in mixture} - {1}) >= 98


def test_mix_order_is_the_fair_queue(spark):
    rng = random.Random(3)
    docs = [(i, "w " * rng.randrange(1, 40), rng.choice("aab")) for i in range(300)]
    mixture, _ = run_mix(spark, docs, [("a", 400, 2), ("b", 600, 4)])
    total, last = defaultdict(int), (0.0, "")
    for r in mixture:
        total[r["source"]] += r["tokens"]
        now = (total[r["source"]] / {"a": 400, "b": 600}[r["source"]], r["source"])
        assert now >= last
        last = now
    assert run_mix(spark, docs, [("a", 400, 2), ("b", 600, 4)])[0] == mixture


def test_mix_of_empty_tables(spark):
    assert run_mix(spark, [], [("a", 1, 1)])[0] == []
    mixture, report = run_mix(spark, [(1, "x", "a")], [])
    assert mixture == [] and report == {}
