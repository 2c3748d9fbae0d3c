import json
import random
import re

from loomgrain.llm import canonical
from loomgrain.llm.ranked import neighbours, range_cumulated, run_counts, run_members

ITEM = "item_id bigint, query string, prompt string, key string, pid int, n bigint"


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], ITEM)
    return sorted(tuple(r) for r in canonical.found_duplicates(df).collect())


def norm(s):
    return "".join(c for c in (s or "").upper().lower() if c.isalnum())


def brute(rows):
    """Sequential version with its own reading of prompts."""

    def prompt(p):
        p = p or ""
        fields = None
        if p.strip().startswith("{"):
            try:
                fields = json.loads(p)
            except ValueError:
                fields = None
        names = r"scene|lettering|material|sign colour|frame colour|place|size"
        if fields is None and len(re.findall(rf"(?i)\b(?:{names})\s*[:=]", p)) >= 2:
            parts = re.split(rf"(?i)\b({names})\s*[:=]", p)
            fields = dict(zip(parts[1::2], parts[2::2]))
        return frozenset((norm(k), norm(str(v))) for k, v in fields.items()) if fields else norm(p)

    first, out = {}, []
    for i, q, p in sorted(rows):
        k = (norm(q), prompt(p))
        if k == ("", ""):
            continue
        if k in first:
            out.append((first[k], i))
        else:
            first[k] = i
    return sorted(out)


def test_notations_agree(spark):
    rows = [
        (1, None, "scene: red shop; lettering: OPEN; size: 20 x 30 cm"),
        (2, "", '{"size": "20 X 30 CM ", "Scene": "Red-Shop", "lettering": "open"}'),
        (3, " ", "- SIZE: 20 x 30 cm\n- lettering: Open.\n- scene: red  shop"),
        (4, None, "Lettering=open | Scene=RED SHOP | Size=20 x 30 cm"),
        (5, None, "scene: red shop; lettering: CLOSED; size: 20 x 30 cm"),
        (6, "Red Shop!", None),
        (7, "“red-shop”", ""),
        (8, "shop red", None),
        (9, None, None),
        (10, "...", " \t"),
        (11, "red shop", "x"),
        (12, "RED　SHOP", "(X)"),
    ]
    assert found(spark, rows) == [(1, 2), (1, 3), (1, 4), (6, 7), (11, 12)]


def test_ties_repeats_nulls_and_long_texts(spark):
    long = "word " * 200_000
    rows = [(3, long, None), (1, long.upper(), None), (2, "a", None), (2, "a", None), (None, "a", None), (5, "a", None)]
    assert found(spark, rows) == [(1, 3), (2, 5)]


def test_empty(spark):
    assert found(spark, []) == []
    assert canonical.record_counts(spark.createDataFrame([], "item_id bigint, query string, prompt string")).collect() == []


def test_free_text_keeps_word_order_and_single_labels(spark):
    rows = [(1, None, "size: big"), (2, None, "Size big"), (3, None, "big size"), (4, "Straße", None), (5, "STRASSE", None)]
    assert found(spark, rows) == [(1, 2), (4, 5)]


def test_runs_across_partitions_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot"] * 6 + [f"k{n}" for n in range(40)]), None) for i in range(3000)]
    df = spark.createDataFrame(rows, "item_id bigint, query string, prompt string")
    assert sorted(tuple(r) for r in canonical.found_duplicates(df).collect()) == brute(rows)
    counts = {r["first_id"]: r["n_rows"] for r in canonical.record_counts(df).collect()}
    assert sum(counts.values()) == 3000
    assert len(counts) == len({q for _, q, _ in rows})
    keyed = df.selectExpr("item_id", "query AS key")
    assert run_counts(keyed, "t").count() == len(counts)
    assert run_members(keyed, "t").count() == 3000 - len(counts)


def test_test_table_matches_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/data_item.parquet").select("item_id", "query", "prompt")
    rows = [tuple(r) for r in df.collect()]
    assert sorted(tuple(r) for r in canonical.found_duplicates(df).collect()) == brute(rows)


def test_neighbours_and_running_totals(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    rows = [(rng.choice("aaab"), rng.randrange(50), i, rng.randrange(9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, o int, i bigint, v bigint")
    got = {(r["a"], r["b"]) for r in neighbours(df, ["g", "o", "i"], "g", "i", "t").collect()}
    s = sorted(rows)
    assert got == {(x[2], y[2]) for x, y in zip(s, s[1:]) if x[0] == y[0]}
    total, expected = {}, {}
    for g, _, i, v in s:
        total[g] = total.get(g, 0) + v
        expected[i] = total[g]
    out = range_cumulated(df, [F.col(c).asc() for c in ("g", "o", "i")], ["g"], "v", "t")
    assert {r["i"]: r["total"] for r in out.collect()} == expected
