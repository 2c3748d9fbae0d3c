import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrain.functions import geometry, hashes, jsonrepair, pixels, text, urls, vectors
from loomgrain.operators import recognition


def one(spark, make, *values, types="string"):
    kinds = types.split(";") if ";" in types else [types] * len(values)
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
    return df.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()[0]


@pytest.mark.parametrize("raw,clean", [
    ("Search for: 'x'", "x"), ("search: \"a b\"", "a b"), ("Find images of red signs", "red signs"), ("  plain ", "plain"), ("", ""), ("''", "''"),
    ("Images of Query: y", "Query: y"), ("w " * 50, "w w w w w w"), ("　wide　", "wide"),
])
def test_clean_query(spark, raw, clean):
    assert one(spark, text.clean_query, raw) == clean


@pytest.mark.parametrize("query,market", [("かな漢字", "ja-JP"), ("漢字", "zh-CN"), ("latin", "en-US"), ("한국", "ko-KR"), ("Привет", "ru-RU"), ("سلام", "ar-SA"), ("नमस्ते", "hi-IN"), ("ไทย", "th-TH"), ("", "en-US"), (None, "en-US")])
def test_market(spark, query, market):
    assert one(spark, text.market, query) == market


def test_small_texts(spark):
    assert one(spark, text.folder_name, "a/b\\c:d") == "a_b_c_d" and one(spark, text.folder_name, "") == "default" and one(spark, text.folder_name, None) == "default"
    assert one(spark, text.caption_text, " a\n b\t") == "a b" and one(spark, text.caption_text, None) == ""
    assert one(spark, lambda c: text.to_sentence(c, 10), "One. Two! Three?") == "One. Two!"
    assert one(spark, lambda c: text.to_sentence(c, 10), "nothing to cut at") == "" and one(spark, lambda c: text.to_sentence(c, 99), " a ") == "a"
    assert one(spark, text.template_caption, None, "x_y") == "A concise description of a x y focusing on layout and typography."
    assert one(spark, text.template_caption, None, None) == "A concise description of a text-centric poster focusing on layout and typography."
    assert one(spark, text.prompt_match, "Abc", "abd") == pytest.approx(2 / 3) and one(spark, text.prompt_match, "", None) == 1.0
    assert one(spark, text.without_fence, "```json\n[1]\n```") == "[1]" and one(spark, text.without_trailing_commas, '{"a": [1, ], }') == '{"a": [1]}'
    assert one(spark, text.json_object, 'so: {"a": 1} end') == '{"a": 1}' and one(spark, text.json_object, "none") is None
    assert one(spark, text.joined_texts, [" a ", None, "", "b\nc"], types="array<string>") == "a b c"
    assert "'x'" in one(spark, text.quality_prompt, "x") and len(one(spark, text.similarity_prompts, "t", "s")) == 8
    up = one(spark, lambda a, b: text.advantage_text(a, b, a, b, F.lit(None).cast("double")), 0.5, 0.25, types="double")
    assert up.startswith("Pass rate up 0.250; OCR avg=0.5; CLIP=0.25; Text consistency=None.")


def test_layout_caption(spark):
    q = {"line_count": F.lit(3), "char_h_mean": F.lit(20.9), "text_density": F.lit(7.0), "contrast": F.lit(0.16), "centrality": F.lit(0.5), "line_angle_std": F.lit(None).cast("double"), "char_h_cv": F.lit(0.45)}
    got = one(spark, lambda t, s, x: text.layout_caption(t, s, x, q), "Shop_Signs", "menu", ["ab", None, "菜单单单"], types="string;string;array<string>")
    assert got == ("Text-dominant Shop Signs / menu. Primary language: Chinese; secondary English. 3 lines, avg glyph height ~20px, density ~7 words/MP. "
                   "High contrast between text and background. Consistent glyph sizes across lines. Legible signage style with bold typography.")  # fmt: skip


def test_hosts(spark):
    assert one(spark, urls.host, "https://a.b:8080/x?y") == "a.b:8080" and one(spark, urls.host, "nothing") == "unknown" and one(spark, urls.host, None) == "unknown"
    assert one(spark, urls.is_blocked, "www.alamy.com") and not one(spark, urls.is_blocked, "alamyxcom") and one(spark, urls.is_cdn, "i.imgur.com")
    rows = [(i, f"https://{h}/{i}") for h, n in (("i.imgur.com", 15), ("x.org", 9), ("alamy.com", 3)) for i in range(n)] + [(99, None)]
    got = urls.download_plan(spark.createDataFrame(rows, "i int, url string"), "url", "i").groupBy("host").count().collect()
    assert {r["host"]: r["count"] for r in got} == {"i.imgur.com": 12, "x.org": 4}
    pages = spark.createDataFrame([("p", "http://bad.x/1"), ("p", "http://ok.x/1"), ("q", "http://ok.x/2")], "page string, url string")
    assert [r[0] for r in urls.relevant_pages(pages, "page", "url", ("bad.x",)).collect()] == ["q"]


def test_hashes(spark):
    assert one(spark, hashes.from_hex, "ffffffffffffffff") == -1 and one(spark, hashes.from_hex, "8000000000000000") == -(1 << 63) and one(spark, hashes.from_hex, "xyz") is None
    assert one(spark, lambda c: hashes.to_hex(c), -1, types="bigint") == "f" * 16
    assert one(spark, hashes.hamming, 5, 6, types="bigint") == 2
    rng = np.random.default_rng(1)
    img = rng.random((90, 120))
    big = np.kron(img, np.ones((2, 2)))
    h, g = hashes.dct_hash(img), hashes.dct_hash(big)
    assert ((h ^ g) & (1 << 64) - 1).bit_count() <= 4 and hashes.dct_hash(img[:10]) is None


def test_vectors(spark):
    assert one(spark, vectors.cosine, [1.0, 0.0], [1.0, 1.0], types="array<double>") == pytest.approx(2**-0.5)
    assert one(spark, vectors.cosine, [0.0], [1.0], types="array<double>") is None


BOX = [[0, 0], [10, 0], [10, 8], [0, 8]]


def test_boxes(spark):
    kind = "array<array<array<int>>>"
    none = one(spark, geometry.char_stats, [], types=kind)
    assert tuple(none) == (0.0, 1.0, 0) and tuple(one(spark, geometry.line_stats, None, types=kind)) == (0, 999.0)
    low = [[x, y + 8] for x, y in BOX]
    at = lambda dy: [BOX, [[x, y + dy] for x, y in BOX]]
    assert tuple(one(spark, geometry.char_stats, [BOX, low, [[1, 2]], None], types=kind)) == (8.0, 0.0, 2)
    assert one(spark, lambda b: geometry.line_stats(b, 0.75), at(6), types=kind)["line_count"] == 1  # a gap equal to the limit
    assert one(spark, lambda b: geometry.line_stats(b, 0.75), at(7), types=kind)["line_count"] == 2
    assert one(spark, geometry.angle, [[0, 0], [10, 10], [10, 20], [0, 20]], types="array<array<int>>") == pytest.approx(45, abs=1e-3)
    assert one(spark, geometry.std, [1.0, 2.0, 4.0], types="array<double>") == pytest.approx(np.std([1, 2, 4]))
    assert tuple(one(spark, geometry.bounds, BOX, types="array<array<int>>")) == (0, 0, 10, 8)
    assert one(spark, geometry.sides, 200, 100, types="int")["aspect_ratio"] == pytest.approx(2)


def test_recognised_lines(spark):
    kinds = "array<string>;array<double>"
    s = lambda t, c: tuple(one(spark, recognition.ocr_stats, t, c, types=kinds))
    assert s(["a", " ", "b"], [87.0, 0.1, 0.5]) == (pytest.approx(0.685), 2, pytest.approx(0.49))
    assert s([], []) == (0.0, 0, 0.0) and s(None, None) == (0.0, 0, 0.0)
    assert np.isnan(s(["a"], [None])[2])
    assert one(spark, recognition.best_lines, ["a", "b", "c"], [0.1, 0.9], types=kinds) == ["b", "a", "c"]
    assert one(spark, recognition.best_lines, ["b", "a", "c"], [], types=kinds) == ["b", "a", "c"]
    boxes = [[[0, 0], [0, 0], [0, 0], [0, h]] for h in (5, 50, 7)]
    got = one(spark, recognition.important_lines, ["x", " Big ", "BIG", "more"], boxes, types="array<string>;array<array<array<int>>>")
    assert got == ['"Big"', '"x"']
    assert one(spark, lambda t: recognition.lines_with(t, ["(a", "Z"]), ["x (A", None, "bz", "c"], types="array<string>") == ["x (A", "bz"]
    tasks, results = spark.createDataFrame([("j1",), ("j2",)], "job_id string"), spark.createDataFrame([("j1", 1), ("j9", 2), (None, 3)], "job_id string, v int")
    assert [x.count() for x in recognition.matched(tasks, results)] == [1, 1, 1]


@pytest.mark.parametrize("answer,out", [
    ('```json\n["a", "b",]\n```', ["a", "b"]), ("here: ['x' \"y\" z] bye", ["x", "y", "z"]), ('[{"query": "q1"}, {"other": 1, "b": "two"}, ["deep"]]', ["q1", "1 two", "deep"]),
    ('["a", "a", " ", "b"]', ["a", "b"]), ('[\n // note\n"a"]', ["a"]), ("plain words", ["plain", "words"]), ("", []), (None, []), ("[" + ",".join(f'"{i}"' for i in range(50)) + "]", [str(i) for i in range(32)]),
])
def test_string_lists(spark, answer, out):
    assert jsonrepair.string_list(answer) == out
    assert one(spark, jsonrepair.parsed_list, answer) == out


def test_pixel_kernels():
    rng = np.random.default_rng(2)
    flat = np.full((60, 80, 3), 128, np.uint8)
    noisy = rng.integers(0, 255, (60, 80, 3), dtype=np.uint8)
    half = flat.copy()
    half[:, 40:] = 250
    assert pixels.sharpness(flat) == 0.0 and pixels.contrast(flat) == pytest.approx(0) and pixels.sharpness(noisy) > 1000
    assert pixels.edges(flat).sum() == 0 and 50 <= pixels.edges(half).sum() <= 130
    box = [[20, 15], [59, 15], [59, 44], [20, 44]]
    m = pixels.mask([box, box, [[1, 1]]], 60, 80)
    assert m.sum() == 40 * 30 and pixels.coverage(m, False) == pytest.approx(0.25) and pixels.coverage(m) == pytest.approx(63.75)
    assert pixels.centrality(m) == 1.0 and pixels.border_ratio(m) == 0.0 and pixels.border_ratio(np.ones((60, 80), bool)) > 0
    assert pixels.centrality(np.zeros((5, 5), bool)) == 0.0
    s = pixels.scores(half, [box])
    assert s["clutter_index"] < pixels.clutter(half, np.zeros((60, 80), bool))


def png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[i].tobytes() for i in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    from loomgrain import sources

    rgb = np.random.default_rng(3).integers(0, 255, (64, 48, 3), dtype=np.uint8)
    png(tmp_path / "a.png", rgb)
    (tmp_path / "b.png").write_bytes(b"\xff\xd8\xff\xd9")
    x = sources.images(spark, str(tmp_path))
    got = {r["path"][-5:]: r for r in x.select("path", "is_corrupt", hashes.phash("image").alias("h")).collect()}
    assert got["b.png"]["is_corrupt"] and got["b.png"]["h"] is None and not got["a.png"]["is_corrupt"]
    assert got["a.png"]["h"] == hashes.dct_hash(rgb.astype(float) @ np.array([0.299, 0.587, 0.114]))
    boxes = x.withColumn("boxes", F.array(F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((5, 5), (20, 5), (20, 9), (5, 9))])))
    rows = {r["path"][-5:]: r for r in pixels.scored(boxes).collect()}
    assert rows["b.png"]["sharpness"] is None and rows["a.png"]["sharpness"] == pytest.approx(pixels.sharpness(rgb))


def test_hamming_bands_meet_every_pair(spark):
    from loomgrain.operators import dedup

    rng = random.Random(4)
    for d in (0, 2, 3, 7):
        base = [rng.getrandbits(64) for _ in range(20)]
        values = set()
        for b in base:
            for _ in range(6):
                h = b
                for _ in range(rng.randrange(d + 3)):
                    h ^= 1 << rng.randrange(64)
                values.add(h - (1 << 64) if h >> 63 else h)
        rows = list(enumerate(sorted(values)))
        df = spark.createDataFrame(rows, "i bigint, hash bigint")
        pairs = lambda hot: sorted((r["a"], r["b"], r["distance"]) for r in dedup.near_pairs(dedup.representatives(df, [], "i"), [], d, hot=hot).collect())  # noqa: B023, E731
        got = set(pairs(2000))
        assert pairs(3) == sorted(got)  # crowded bands are split and lose nothing
        dist = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
        assert got == {(i, j, dist(x, y)) for i, x in rows for j, y in rows if i < j and dist(x, y) <= d}
