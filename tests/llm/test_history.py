import random

import numpy as np
import pytest

from loomgrain.llm import history
from loomgrain.llm.components import components
from loomgrain.runtime import scratch

ITEM = "item_id bigint, batch_no int, content_sha1 string, shard string, image_path string, key string, hash string, a int"
H = "item_id bigint, hash bigint, digest string"


def found(spark, items, hashes):
    i = spark.createDataFrame([(*r, "k", "h", 0) for r in items], ITEM)
    h = spark.createDataFrame([(*r, "d") for r in hashes], H)
    return sorted(tuple(r) for r in history.repeats(i, h).collect())


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def brute(items, hashes):
    hs = dict(hashes)
    parent = {i[0]: i[0] for i in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, x in enumerate(items):
        for y in items[:k]:
            near = hs.get(x[0]) is not None and hs.get(y[0]) is not None and ((hs[x[0]] ^ hs[y[0]]) & (1 << 64) - 1).bit_count() <= 3
            if near or (x[2] and x[2] == y[2]) or (x[3] is not None and x[4] is not None and x[3:5] == y[3:5]):
                a, b = sorted((root(x[0]), root(y[0])))
                parent[b] = a
    return sorted((root(i[0]), i[0]) for i in items if i[1] and root(i[0]) != i[0])


def test_digests_and_paths_in_several_writings(spark):
    d = "ab" * 20
    rows = [
        (1, 0, d, "s1", "a/b.jpg"),
        (2, 1, f"SHA1={d.upper()}\n", None, "x"),
        (3, 1, None, "s1", "./a//c/../b.jpg"),
        (4, 2, None, "s2", "a/b.jpg"),
        (5, 2, None, "s1", "a\\b.jpg"),
        (6, 2, "", "s1", "a%2Fb.jpg"),
        (7, 3, None, None, "a/b.jpg"),
        (8, 3, "nonsense", "s1", None),
        (9, 3, "nonsense", "s1", " "),
    ]
    assert found(spark, rows, []) == [(1, 2), (1, 3), (1, 5), (1, 6)]


def test_chains_join_images_and_history_is_not_reported(spark):
    items = [(1, 0, None, None, "a"), (2, 0, None, None, "b"), (3, 1, None, None, "c"), (4, 2, None, None, "d"), (5, None, None, None, "e")]
    hashes = [(1, 0), (3, 0b111), (2, 0b111111), (4, signed((1 << 63) | 0b1111111)), (5, 1 << 40)]
    assert found(spark, items, hashes) == brute(items, hashes) == [(1, 3), (1, 4)]


def test_nulls_repeats_and_empty_tables(spark):
    assert found(spark, [], []) == []
    items = [(1, 0, None, None, None), (2, 1, None, None, None), (2, 1, None, None, None), (None, 1, "ab" * 20, "s", "p")]
    assert found(spark, items, [(1, None), (2, None), (None, 5), (7, 7)]) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_random_items_match_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(40)]
    items, hashes = [], []
    for i in range(1, 301):
        items.append((i, min(6, i // 40), rng.choice([None, f"{rng.randrange(60):040x}", f"{i:040x}"]), rng.choice([None, "s", "t"]), rng.choice([f"p{rng.randrange(80)}", f"q{i}"])))
        if rng.random() < 0.9:
            h = rng.choice(base)
            for _ in range(rng.randrange(6)):
                h ^= 1 << rng.randrange(64)
            hashes.append((i, signed(h)))
    assert found(spark, items, hashes) == brute(items, hashes)


def test_batch_after_batch_gives_the_images_of_all_at_once(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(15)]
    items, hashes = [], []
    for i in range(1, 161):
        items.append((i, min(3, i // 40), rng.choice([None, f"{rng.randrange(40):040x}"]), rng.choice([None, "s"]), rng.choice([f"p{rng.randrange(60)}", f"q{i}"])))
        h = rng.choice(base)
        for _ in range(rng.randrange(5)):
            h ^= 1 << rng.randrange(64)
        hashes.append((i, signed(h)))
    path, seen = scratch(spark, "test-index"), {}
    for b in range(4):
        part = spark.createDataFrame([(*r, "k", "h", 0) for r in items if r[1] == b], ITEM)
        known = spark.createDataFrame([(*r, "d") for r in hashes if items[r[0] - 1][1] == b], H)
        now = history.accept(path, part, known, max_shards=2)
        for r in now.collect():
            assert items[r["item_id"] - 1][1] == b and r["kept_id"] < r["item_id"]
            seen[r["item_id"]] = r["kept_id"]
        sofar = [x for x in items if x[1] <= b]
        assert {i: k for i, k in seen.items() if items[i - 1][1] == b and b} == {i: k for k, i in brute(sofar, hashes) if items[i - 1][1] == b}
    images = sorted((r["first_id"], r["item_id"]) for r in history.images(spark, path).collect() if items[r["item_id"] - 1][1])
    assert images == brute(items, hashes)
    assert len(history._held(spark, path).shards) <= 2


def test_a_batch_reads_its_own_slots_only(spark):
    """What a batch of two rows reads is a small part of the stored places, and nothing of them where it has no hashes."""
    rng = random.Random(3)
    path = scratch(spark, "test-index")
    some = lambda lo, n: (spark.createDataFrame([(i, 0, None, None, None, "k", "h", 0) for i in range(lo, lo + n)], ITEM), spark.createDataFrame([(i, signed(rng.getrandbits(64)), "d") for i in range(lo, lo + n)], H))
    history.accept(path, *some(0, 3000), bits=6)
    shards = history._held(spark, path).shards
    all_places = history._part(spark, path, "places", shards).count()
    places = spark.createDataFrame([(0, 5, 3), (1, 7, 64 + 9)], "ring int, lead16 bigint, slot int")
    read = history.old_places(spark, path, shards, places)
    assert all_places == 12_000 and 0 < read.count() < all_places / 50
    assert "PartitionFilters: [isnotnull(slot" in (plan := read._jdf.queryExecution().toString()) or "PartitionFilters: [slot" in plan
    history.accept(path, *some(5000, 2), bits=6)
    assert len(history._held(spark, path).shards) == 2


def test_what_is_stored_is_not_shuffled_for_a_batch(spark, monkeypatch):
    """300 rows whose places are those of 3,000 stored ones: groups are formed of the batch's own keys and places only."""
    rng = random.Random(5)
    path = scratch(spark, "test-index")
    groups = [rng.getrandbits(16) for _ in range(64)]
    value = lambda: sum(rng.choice(groups) << s for s in (0, 16, 32, 48))
    items = [(i, int(i >= 3000), None, "s", f"p{i % 3100}") for i in range(3300)]
    hashes = [(i, signed(value())) for i in range(3300)]
    batch = lambda b: (spark.createDataFrame([(*r, "k", "h", 0) for r in items if r[1] == b], ITEM), spark.createDataFrame([(*r, "d") for r in hashes if items[r[0]][1] == b], H))
    history.accept(path, *batch(0))
    rows, group = [], history.grouped

    def seen(df, *keys):
        rows.append(df.count())
        return group(df, *keys)

    monkeypatch.setattr(history, "grouped", seen)
    got = sorted(tuple(r) for r in history.accept(path, *batch(1)).collect())
    assert sum(rows) <= 300 * (4 + 3) and got == brute(items, hashes) and len(got) >= 200


def test_crowded_places_of_a_stored_index_are_split_without_loss(spark, monkeypatch):
    """Batches of hashes that share their leading 48 bits: all places are beyond the limit, old nodes with new."""
    monkeypatch.setattr(history, "HOT_ROWS", 20)
    monkeypatch.setattr(history, "PIECE_ROWS", 30)
    values = random.Random(9).sample(range(1 << 16), 240)
    items = [(i, min(2, i // 100), None, None, None) for i in range(240)]
    hashes = [(i, signed(v | (0xABCD << 48))) for i, v in enumerate(values)]
    assert found(spark, items, hashes) == brute(items, hashes) != []


def test_ranges_of_stored_keys_and_places_are_read_whole(spark, monkeypatch):
    """Ranges of a few rows: many of them in a slot or bucket, of either sign."""
    monkeypatch.setattr(history, "RANGE_ROWS", 20)
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(60)]
    items = [(i, min(3, i // 80), None, rng.choice([None, "s"]), f"p{rng.randrange(200)}") for i in range(320)]
    hashes = [(i, signed(rng.choice(base) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))) for i in range(320)]
    assert found(spark, items, hashes) == brute(items, hashes) != []


def test_an_unfinished_batch_leaves_the_index_as_it_was(spark, monkeypatch):
    path = scratch(spark, "test-index")
    one = lambda i: (spark.createDataFrame([(i, 0, "ab" * 20, None, None, "k", "h", 0)], ITEM), spark.createDataFrame([], H))
    assert history.accept(path, *one(1)).count() == 0
    hold = history._hold

    def fails(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(history, "_hold", fails)
    with pytest.raises(RuntimeError):
        history.accept(path, *one(2))
    monkeypatch.setattr(history, "_hold", hold)
    assert [tuple(r) for r in history.accept(path, *one(3)).collect()] == [(1, 3)]


def test_a_vertex_with_very_many_neighbours_is_split(spark):
    """The join with the least neighbours is one of two plain tables, which the adaptive planner may split."""
    from loomgrain.llm import components as c

    edges = spark.range(0, 100_000, 1, 8).selectExpr("0L AS u", "abs(xxhash64(id)) AS v").unionByName(spark.range(0, 30_000, 1, 4).selectExpr("id + 50000 AS u", "id AS v"))
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        x = c._with_min(c.staged(edges, "test-star"), "test-least")
        assert x.count() == 130_000
        x.write.format("noop").mode("overwrite").save()
        x.collect()
        assert "skew=true" in x._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_search_finds_what_an_exhaustive_one_finds_and_recall_grows_with_the_beam():
    rng = np.random.default_rng(3)
    nodes = np.sort(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 20_000, dtype=np.uint64))
    queries = nodes[:2000].copy()
    for k in range(2000):
        for b in rng.choice(64, 3, replace=False):
            queries[k] ^= np.uint64(1) << np.uint64(b)
    r = history.recall(nodes, queries, (1, 4, None))
    assert r[1] <= r[4] <= r[None] == 1.0
    assert history.recall(nodes[:0], queries[:5])[None] == 1.0


def test_routing_arrives_at_the_place_on_the_ring():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 7, 1000):
        nodes = np.sort(rng.integers(0, 500, n, dtype=np.uint64))
        q = rng.integers(0, 600, 200, dtype=np.uint64)
        assert (history.route(nodes, q) == np.searchsorted(nodes, q, side="right") - 1).all()


def test_hot_places_are_split_without_loss(spark):
    """All hashes share their leading 48 bits, far beyond the limit for one piece."""
    rng = random.Random(8)
    values = rng.sample(range(1 << 16), 400)  # pieces of 100 rows: the finer rings are cut too
    rows = [(v | (0xABCD << 48), i, i % 3) for i, v in enumerate(values)]
    df = spark.createDataFrame([(signed(h), i, b) for h, i, b in rows], "hash bigint, item_id bigint, batch_no int")
    links = history.near_links(df, hot_rows=50, piece_rows=100)
    got = {r["item_id"]: r["first_id"] for r in components(links).collect()}
    plain = {r["item_id"]: r["first_id"] for r in components(history.near_links(df)).collect()}
    parent = list(range(400))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(400):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= 3:
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    expected = {i: root(i) for i in range(400) if root(i) != i}
    assert got == plain == expected


def test_shards_are_compacted_on_schedule():
    piece = history.Piece(history.GROUP, max_shards=2)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 500, dtype=np.uint64)
    links = []
    for b in range(6):
        links += piece.arrive(base ^ np.uint64(1 << b), np.arange(500) + 500 * b)
        assert len(piece.shards) <= 2
    assert sum(len(s[0]) for s in piece.shards) == 3000
    assert len(links) == 2500  # a spanning forest: five links for each of 500 images


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5000, 5000), (None, 3)]
    got = {r["item_id"]: r["first_id"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1001: 1000}
