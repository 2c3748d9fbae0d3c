import json
import random
from collections import Counter
from datetime import datetime, timezone

import pytest

from loomgrain.operators import compaction
from loomgrain.runtime import scratch


def files(spark, contents):
    return spark.createDataFrame([(i, c, "r", 0) for i, c in enumerate(contents)], "file_id bigint, content string, record string, pid int")


def found(spark, contents):
    return sorted((r["image_path"], r["ts_ms"]) for r in compaction.found_records(files(spark, contents)).collect())


def test_layouts_fragments_and_repeats(spark):
    a = {"image_path": "a.jpg", "ts": 1707195620.41, "prompt": '{"scene": "x"}'}
    b = {"image_path": "b.jpg", "ts": "2024-02-06T05:00:20.410Z"}
    c = {"image_path": "c.jpg", "ts": "2024-02-06 07:00:20.410+02:00", "query": "字 {"}
    d = {"image_path": "d.jpg", "ts": "1707195620.41"}
    contents = [
        json.dumps(a), json.dumps(a, indent=2), json.dumps([a, b], indent=1), "\r\n".join(json.dumps(x, ensure_ascii=False) for x in (c, d)),
        json.dumps([d, {"image_path": "lost.jpg", "ts": 5}])[:-9], json.dumps(b)[:-1], json.dumps(a)[10:] + "\n" + json.dumps(b),
        '{"image_path": "no time"}', '{"ts": 5}', '{"image_path": "e.jpg", "ts": null}', '{"image_path": 7, "ts": 1}', '{"image_path": "f.jpg", "ts": true}',
        "", " \n", "[]", None, "{" * 200, json.dumps({"records": [d, {"image_path": "in.jpg", "ts": 1}]}),
    ]
    t = 1707195620410
    assert found(spark, contents) == [("a.jpg", t), ("b.jpg", t), ("c.jpg", t), ("d.jpg", t), ("in.jpg", 1000)]


def test_empty_table_and_very_long_record(spark):
    assert found(spark, []) == []
    assert found(spark, [json.dumps({"image_path": "p", "ts": 1, "x": "y" * 3_000_000})] * 3) == [("p", 1000)]


@pytest.mark.parametrize("text,ms", [("1.0005", 1000), ("-1.5", -1500), (1e300, None), ("nan", None), ("1970-01-01T00:00:01", 1000), ("x", None), (0, 0)])
def test_times(text, ms):
    assert compaction.epoch_ms(text) == ms


def made(rng, lo, hi, n):
    return [json.dumps({"image_path": f"p{rng.randrange(lo, hi):04d}.jpg", "ts": rng.randrange(50), "pad": "z" * rng.randrange(300)}) for _ in range(n)]


def stored(spark, path):
    return Counter((r["image_path"], r["ts_ms"], r["record"]) for r in compaction.records(spark, path).collect())


def as_stored(texts):
    return Counter((r["image_path"], r["ts"] * 1000, json.dumps(r, sort_keys=True)) for r in map(json.loads, texts))


def whole(spark, path, table):
    """The range table holds for the files, in order and without gaps."""
    rows = sorted(table.collect(), key=lambda r: r["part"])
    for r in rows:
        x = spark.read.parquet(r["file"]).collect()
        keys = [(y["image_path"], y["ts_ms"], y["digest"]) for y in x]
        assert keys == sorted(keys) and len(x) == r["n_rows"] and sum(y["n_bytes"] for y in x) == r["n_bytes"]
        assert keys[0] == (r["first_path"], r["first_ts_ms"], r["first_digest"]) and keys[-1] == (r["last_path"], r["last_ts_ms"], r["last_digest"])
    ends = [((r["first_path"], r["first_ts_ms"], r["first_digest"]), (r["last_path"], r["last_ts_ms"], r["last_digest"])) for r in rows]
    assert all(x[1] <= y[0] for x, y in zip(ends, ends[1:])) and [r["part"] for r in rows] == list(range(len(rows)))
    return rows


@pytest.mark.parametrize("fan_in", [64, 2])
@pytest.mark.parametrize("unique", compaction.UNIQUE)
def test_runs_are_merged_into_few_sorted_files(spark, monkeypatch, unique, fan_in):
    monkeypatch.setattr(compaction, "BLOCK_ROWS", 32)
    rng = random.Random(1)
    texts = made(rng, 0, 300, 2000)
    texts += [texts[0]] * 900 + texts[:200]  # a record that holds a third of all rows
    path = scratch(spark, "test-consolidated")
    table = compaction.consolidate(files(spark, ["\n".join(texts[i : i + 7]) for i in range(0, len(texts), 7)]).repartition(7), path, 60_000, unique, fan_in)
    rows, expected, got = whole(spark, path, table), as_stored(texts), stored(spark, path)
    if unique == "key":
        assert sorted(k[:2] for k in got.elements()) == sorted({k[:2] for k in expected}) and set(got) <= set(expected)
    else:
        assert got == (Counter(set(expected)) if unique else expected)
    assert len(rows) > 3 and all(r["n_bytes"] < 140_000 for r in rows)


def test_differing_records_of_one_key_and_repeats_are_kept(spark):
    a, b, c = ({"image_path": "a", "ts": 1, "x": x} for x in "abc")
    for unique, n in ((None, (3, 5)), ("record", (2, 3)), ("key", (1, 1))):
        path = scratch(spark, "test-kept")
        compaction.consolidate(files(spark, [json.dumps(x) for x in (a, a, b)]), path, unique=unique)
        assert compaction.records(spark, path).count() == n[0]
        compaction.extend(files(spark, [json.dumps(x) for x in (c, a)]), path)
        assert compaction.records(spark, path).count() == n[1]


@pytest.mark.parametrize("unique", compaction.UNIQUE)
def test_extending_rewrites_only_what_it_touches(spark, monkeypatch, unique):
    monkeypatch.setattr(compaction, "BLOCK_ROWS", 16)
    rng = random.Random(2)
    path = scratch(spark, "test-extended")
    first, more = made(rng, 0, 1000, 1500), made(rng, 300, 420, 700)
    again = [x for x in first if '"p03' in x]
    before = {r["file"] for r in compaction.consolidate(files(spark, first), path, 20_000, unique).collect()}
    rows = whole(spark, path, compaction.extend(files(spark, more + again), path, 20_000))
    expected, got = as_stored(first + more + again), stored(spark, path)
    if unique == "key":
        assert sorted(k[:2] for k in got.elements()) == sorted({k[:2] for k in expected})
    else:
        assert got == (Counter(set(expected)) if unique else expected)
    after = {r["file"] for r in rows}
    assert len(after & before) > len(before) // 3 and all(r["n_bytes"] < 35_000 for r in rows)
    later = {r["file"] for r in compaction.extend(files(spark, made(rng, 300, 301, 5)), path, 20_000).collect()}
    assert len(after - later) <= 2
    n = sum(stored(spark, path).values())
    assert compaction.expire(spark, path) > 0 and sum(stored(spark, path).values()) == n


def test_an_unfinished_version_does_not_hold(spark, monkeypatch):
    path = scratch(spark, "test-unfinished")
    one, two = ([json.dumps({"image_path": p, "ts": 1})] for p in "ab")
    compaction.consolidate(files(spark, one), path)
    commit = compaction._commit

    def fails(*_):
        raise RuntimeError("lost between the data and the range table")

    monkeypatch.setattr(compaction, "_commit", fails)
    with pytest.raises(RuntimeError):
        compaction.extend(files(spark, two), path)
    assert [k[0] for k in stored(spark, path)] == ["a"]
    monkeypatch.setattr(compaction, "_commit", commit)
    compaction.extend(files(spark, two), path)
    assert sorted(k[0] for k in stored(spark, path)) == ["a", "b"]


def test_extending_nothing_and_with_nothing(spark):
    path = scratch(spark, "test-extended")
    assert compaction.consolidate(files(spark, []), path).count() == 0
    assert compaction.extend(files(spark, []), path).count() == 0
    assert compaction.extend(files(spark, [json.dumps({"image_path": "a", "ts": 1})]), path).first()["n_rows"] == 1
    assert compaction.extend(files(spark, [""]), path).first()["n_rows"] == 1
    assert compaction.extend(files(spark, [json.dumps({"image_path": "A", "ts": 1})]), path).first()["n_rows"] == 2
    with pytest.raises(ValueError):
        compaction.consolidate(files(spark, []), path, unique="x")


def test_test_table_matches_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/sidecar_file.parquet")
    expected, decoder = set(), json.JSONDecoder()
    for (text,) in df.select("content").collect():
        at = (text or "").find("{")
        while at >= 0:
            try:
                r, at = decoder.raw_decode(text, at)
                try:
                    ms = round(float(r["ts"]) * 1000)
                except ValueError:
                    ms = round(datetime.fromisoformat(r["ts"]).astimezone(timezone.utc).timestamp() * 1000)
                expected.add((r["image_path"], ms))
            except ValueError:
                at += 1
            at = text.find("{", at)
    assert found(spark, [r[0] for r in df.select("content").collect()]) == sorted(expected)
