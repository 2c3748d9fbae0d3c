import datetime
import random

import numpy as np
import pytest

from loomgrain.llm import encoding, languages, truncation

DE = "der Aushang im Flur nennt die Nummer des letzten Zuges"
EN = "the painted sign lists every price of the week"
FR = "le vieux reçu répète les règles de la salle de lecture"
DOCS = [(i, t, c) for i, (t, c) in enumerate([(DE, "de"), (EN, "en"), (FR, "fr"), ("vecchio cartello della stazione", "it"), ("el viejo recibo explica todo", "es")] * 4)]


def test_ids_equal_the_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{encoding.TOKENIZER_DIR}/{encoding.VOCABULARY}")
    t.encode_special_tokens = True
    rng = random.Random(1)
    texts = ["", " ", "a" * 50_000, "ab" * 999, "<|endoftext|>", "don't  stop\n\n", "面馆菜单 9.90 €", "🙂é́", "​�", "x\ty", None, None]
    texts += ["".join(rng.choice("ab ,'st\n9é字") for _ in range(rng.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame([(i, x, [1]) for i, x in enumerate(texts)], "doc_id bigint, text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in encoding.token_ids(df).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    sized = {r["doc_id"]: r["tokens"] for r in encoding.token_counts(df, ["doc_id"]).collect()}
    assert sized == {i: len(x) for i, x in got.items()}


def test_encoder_forgets_without_changing_ids():
    e = encoding.Encoder(f"{encoding.TOKENIZER_DIR}/{encoding.VOCABULARY}", memory=3)
    whole = encoding.Encoder(f"{encoding.TOKENIZER_DIR}/{encoding.VOCABULARY}")
    texts = [f"some words number {i} again" for i in range(50)]
    assert [e([x])[0] for x in texts] == whole(texts)


def test_ids_of_empty_table_and_repeats(spark):
    schema = "doc_id bigint, text string"
    assert encoding.token_ids(spark.createDataFrame([], schema)).collect() == []
    assert encoding.token_ids(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], schema)).count() == 3


def found(spark, ocr, quality):
    o = spark.createDataFrame([(*r, "x", "y") for r in ocr], "item_id bigint, texts array<string>, lang string, code string")
    q = spark.createDataFrame([(*r, "x") for r in quality], "item_id bigint, assessed_at timestamp_ntz, lang string, segments string")
    d = spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string")
    return sorted((r["item_id"], r["first_line"], r["lang"]) for r in languages.relabelled(o, q, d).collect())


NOW = datetime.datetime(2024, 1, 1)


def test_segments_of_missing_wrong_and_mixed_labels(spark):
    ocr = [
        (1, [EN, "12", EN]),
        (2, ["*", DE, "7:07", FR]),
        (3, [EN]),
        (4, [DE.upper()]),
        (5, ["1", "--"]),
        (6, []),
        (7, None),
        (8, [None, EN, None]),
        (3, [EN]),
        (9, ["第二栏的文字写着末班车的车次", "この手書きのメモは説明しています", "빛바랜 포스터는", "Выцветший плакат"]),
        (None, [EN]),
    ]
    late = NOW + datetime.timedelta(hours=1)
    quality = [(1, NOW, None), (2, NOW, "de"), (3, NOW, "fr"), (3, late, "English"), (4, NOW, "und"), (5, NOW, None), (8, None, "en"), (8, NOW, "zh-CN")]
    assert found(spark, ocr, quality) == [(1, 0, "en"), (2, 0, "de"), (2, 3, "fr"), (4, 0, "de"), (8, 0, "en"), (9, 0, "zh"), (9, 1, "ja"), (9, 2, "ko"), (9, 3, "ru")]


def test_names_of_another_language_do_not_switch(spark):
    assert found(spark, [(1, [DE + " OPEN", "In Zeile 7 steht WORKSHOP " + DE])], [(1, NOW, "de_AT")]) == []


def test_languages_of_empty_tables(spark):
    assert found(spark, [], []) == []


@pytest.mark.parametrize("text", [
    "القطار الأخير يغادر المحطة في المساء", "รถไฟขบวนสุดท้าย ออกจากสถานี ตอนเย็น",
    "Não havia ninguém naquela rua quando cheguei ontem à noitinha", "Dzisiaj wieczorem pójdziemy wszyscy razem zobaczyć przedstawienie",
])
def test_other_languages_are_undetermined(spark, sf, text):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang")
    ocr = spark.createDataFrame([(1, [text]), (2, ["Line 12 reads NOTICE in violet letters.", text])], "item_id bigint, texts array<string>")
    got = {r["item_id"]: [(s["first_line"], s["lang"]) for s in r["segments"]] for r in languages.record_segments(ocr, docs).collect()}
    assert got[1] == [(0, "und")] and got[2][0] == (0, "en")


def test_confidence_does_not_grow_to_one_with_length():
    score = np.tile(np.array([[-0.4] + [-1.1] * 9]), (400, 1))
    (_, _, lang, sure), = languages.segments(score, np.full(400, 1))
    assert lang == "en" and sure < 1 - 1e-6


def test_very_long_record(spark):
    assert found(spark, [(1, [EN] * 3000 + [DE] * 3000), (2, [" ".join([FR] * 4000)])], [(2, NOW, "fr")]) == [(1, 0, "en"), (1, 3000, "de")]


def test_language_codes(spark):
    names = {"EN": "en", "en_GB": "en", "zho": "zh", "Chinese": "zh", " ": None, "n/a": None, "und": None, None: None, "pt-BR": "pt-br", "JA": "ja", "es_MX": "es"}
    df = spark.createDataFrame([(k,) for k in names], "c string")
    assert [r[0] for r in df.select(languages.language_code(df.c)).collect()] == list(names.values())


def test_viterbi_matches_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(40):
        s = rng.normal(0, 2, (5, 3))
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(value(p) for p in itertools.product(range(3), repeat=5))
        assert value(tuple(languages.viterbi(s, 1.5))) == pytest.approx(best)


def test_held_out_accuracy(spark, sf):
    d = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet").where("lang IS NOT NULL AND length(text) > 40")
    counts = languages.train(docs.where("doc_id % 5 <> 0"))
    scorer = languages.Scorer(counts)
    rows = docs.where("doc_id % 5 = 0").select("text", "lang").collect()
    right = total = 0
    for r in rows:
        score, ok, _ = scorer.lines([r["text"]])
        if ok[0]:
            total += 1
            right += languages.LANGS[int(score[0].argmax())] == r["lang"]
    assert right / total > 0.97


def cut(spark, docs):
    d = spark.createDataFrame([(*r, "x", 0.5) for r in docs], "doc_id bigint, text string, source string, h string, terminality double")
    return sorted(r[0] for r in truncation.found_cut(d).collect())


BASE = [(i, f"The painted sign lists price {i % 7 + 10}. Nobody could say who wrote the missing words.\nPear tart {i % 5 + 1}.50\nRye bread {i % 9 + 1}.90", "a") for i in range(40)]


def test_cut_within_word_sentence_entry_and_character(spark):
    rows = [
        (101, "The painted sign lists price 12. Nobody could say who wr", "b"),
        (102, "The painted sign lists price 12. Nobody could say who", "b"),
        (103, "The painted sign lists price 12. Nobody could say who wrote the missing words.", "b"),
        (104, "Tarte\nPear tart 3.50\nRye bread 4.9", "b"),
        (105, "Tarte\nPear tart 3.50\nRye bread 4.90", "b"),
        (106, "The painted sign lists pr�", "b"),
        (107, "Nobody could say who wrote the miss&quo", "b"),
        (108, None, "b"), (109, "", "b"), (110, " \t\n", "b"), (111, "...", None),
        (112, "The painted sign lists price 12. Nobody could say who wr", "c"),
        (113, "The painted sign lists price 12. Nobody could say who wr \n", None),
        (None, "The painted sign li", "b"),
        (114, "a" * 300_000 + ".", "b"),
        (115, "Nobody could say who wrote the mis…", "b"),
        (116, "Nobody could say who wrote the missing words! \U0001f642", "b"),
    ]
    assert cut(spark, BASE + rows) == [101, 102, 104, 106, 107, 112, 113, 115]


def test_near_copy_shows_the_cut(spark):
    whole = " ".join(f"word{i} goes here and there." for i in range(30)) + "\nLast entry 4711"
    rows = [(1, whole, "a"), (2, whole[:-3], "a"), (3, whole[:-16], "a"), (4, whole + "\nOne more line 12", "a")]
    t = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id bigint, text string")
    got = {r["doc_id"]: r["cut"] for r in truncation.aligned(t).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_many_copies_with_the_same_cut_meet_the_whole_text(spark):
    """More copies than bands: equal in length, each with a misreading of its own, and one whole text."""
    words = [f"word{i:03d}" for i in range(300)]
    whole = " ".join(words) + " and the last words of it are here."
    end = " ".join(words) + " and the last words of i"
    rows = [(k, end.replace(f"word{k:03d}", f"w0rd{k:03d}")) for k in range(10, 70)] + [(1000, whole)]
    got = {r["doc_id"]: r["cut"] for r in truncation.aligned(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {k: True for k in range(10, 70)}


def test_a_copy_longer_than_the_whole_text_does_not_stand_for_it(spark):
    """Both have the same words before the closing one; the cut copy is longer by its misreading."""
    words = [f"word{i:03d}" for i in range(100)]
    whole = " ".join(words) + " and the last words of it are here."
    rows = [(1, whole), (2, whole[:-2].replace("word050", "woooooord050"))]
    got = {r["doc_id"]: r["cut"] for r in truncation.aligned(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {2: True}


def test_a_line_that_ends_in_one_copy_does_not_hide_the_cut_that_others_show(spark):
    """The longest copy, asked first, has a line's end where the text was cut; of eighty others one goes on within the word."""
    words = [f"word{i:03d}" for i in range(300)]
    end = " ".join(words) + " and the last words of i"
    rows = [(1, end), (2, end + "\n" + "more " * 30)]
    rows += [(k, end.replace(f"word{k:03d}", f"w0rd{k:03d}") + ("t are here." if k == 20 else f"\nmore{k} of{k} it{k} here")) for k in range(10, 90)]
    got = {r["doc_id"]: r["cut"] for r in truncation.aligned(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] is True


def test_texts_with_the_same_end_tell_each_other_nothing():
    """What is left out of the pairs: same end, the answering text has its last shingle once, the asking one has no mark."""
    rng = random.Random(4)
    skipped = 0
    for _ in range(3000):
        texts = [" ".join(rng.choice(["ab", "Cd", "the", "efg hi.", "x,", "\u4e2d\u6587", "...", "%2"]) for _ in range(rng.randrange(5, 40))) for _ in range(2)]
        e = " " + " ".join(rng.choice(["ab", "Cd", "the", "efghij", "klm", "nop", "qrs"]) for _ in range(rng.randrange(6, 14))) + rng.choice(["", ".", "..."])
        a, b = texts[0] + e, texts[1] + e
        (ask, _), (_, end) = truncation._end(a), truncation._end(b)
        if ask is not None and ask == end:
            skipped += 1
            assert truncation.ends_early(a, b) is None
    assert skipped > 500


def test_alignment():
    assert truncation.ends_early("the price of the wee", "the price of the week.") is True
    assert truncation.ends_early("the price", "the price of the week.") is True
    assert truncation.ends_early("the price.", "the price. And more.") is False
    assert truncation.ends_early("it is 80.", "it is 80.50 by now.") is True
    assert truncation.ends_early("one line", "one line\nanother") is False
    assert truncation.ends_early("something else", "the price of the week.") is None


def test_alignment_with_differences_at_the_cut():
    whole = " ".join(f"word{i} goes here and there." for i in range(30)) + "\nThe last entry of the evening menu is 4711 and no more"
    a = whole[:-14]  # "... evening menu is 4"
    assert truncation.ends_early(a.replace("evening", "evenlng"), whole) is True
    assert truncation.ends_early(a.replace("evening", "Evening"), whole) is True
    assert truncation.ends_early(a.replace("the evening", "the\nevening"), whole) is True
    assert truncation.ends_early(a.replace("evening", "evenning"), whole) is True
    assert truncation.ends_early(whole[:-17] + "…", whole) is True
    assert truncation.ends_early(whole[:-18] + "�", whole) is True
    assert truncation.ends_early(whole.replace("evening", "evenlng"), whole) is None
    assert truncation.ends_early(whole.replace("evening", "evenlng"), whole + "\nOne more") is False
    assert truncation.ends_early(whole[:-8] + "nobody", whole) is None


def test_no_evidence_is_no_cut(spark):
    """A closing word that no other text has in any form tells nothing."""
    assert cut_ids(spark, ["a b", "A-b", "zq vx", "Ügh"]) == []


def test_planted_prefixes_are_found(spark, sf):
    """Recall of the near-copies: texts cut at 30 to 95 percent, clean or with a misread word in twenty-five, beside their whole copies."""
    rng = random.Random(5)
    texts = sorted({r[0].strip() for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r[0] and len(r[0].split()) > 25})[:60]
    rows, cut = [], []
    for i, t in enumerate(texts):
        rows.append((i, t))
        for k, share in enumerate((0.3, 0.5, 0.6, 0.8, 0.95)):
            at = int(len(t) * share)
            while not (t[at - 1].isalnum() and t[at].isalnum()):
                at -= 1
            words = t[:at].split(" ")
            if k % 2:
                words = [w[:-1] + "ø" if j % 25 == rng.randrange(25) and len(w) > 3 else w for j, w in enumerate(words)]
            if len(words) > 8:
                cut.append(1000 + 10 * i + k)
                rows.append((cut[-1], " ".join(words)))
    got = {r["doc_id"]: r["cut"] for r in truncation.aligned(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(got.get(i, False) for i in cut) >= 0.9 * len(cut) > 100
    assert not any(got.get(i, False) for i in range(len(texts)))


def test_copies_with_one_end_do_not_all_meet(spark, monkeypatch):
    """Of 300 near-copies with the same end each meets their longest, not all others."""
    base = " ".join(f"the {w} of the market opens at dawn and" for w in ("door", "gate", "stall", "shop", "bell", "clock"))
    rows = [(i, f"{base} number {i} of them all closes late in the evening") for i in range(300)]
    met = []
    run = truncation.staged

    def seen(df, name):
        out = run(df, name)
        met.extend([out.count()] if "-pairs-" in name else [])
        return out

    monkeypatch.setattr(truncation, "staged", seen)
    truncation.aligned(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sum(met) < 300 * 20


def test_very_long_words_count_by_their_full_length(spark):
    word = "x" * 100 + ".y" * 50_000
    got = truncation._turns(word)
    assert len(got) == 100_000 and truncation._turns("abc") is None
    assert cut_ids(spark, [f"a {word}\nb {word}"] * 2 + [f"c {word}", f"d {word[:-2]}"] + [f"e{i} {word}\nlast line." for i in range(4)]) == [4]


def cut_ids(spark, texts):
    rows = [(i + 1, t, "s") for i, t in enumerate(texts)]
    return sorted(r[0] for r in truncation.found_cut(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect())


def test_cut_of_empty_table_and_rates(spark):
    assert cut(spark, []) == []
    d = spark.createDataFrame([*BASE, (200, "Nobody could say who wro", None)], "doc_id bigint, text string, source string")
    got = {r["source"]: tuple(r)[1:] for r in truncation.cut_rates(d).collect()}
    assert got == {"a": (40, 0, 0.0), None: (1, 1, 1.0)}
