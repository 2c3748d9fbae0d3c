"""Texts that were cut off by field limits or on the way (problem 9).

A text that was cut has the beginning of its whole copy.  Near-copies are found by
min-hash bands over windows of five-word shingles: a text asks with the window at its end and that at its
beginning, any text answers with all its windows; pairs that hold at least 0.8 of the asking
text's shingles are aligned, and the copy whose alignment ends early, within a word, sentence or
entry, is cut.  Texts without such a partner are judged by the terminality of
their closing word: how often, over the whole corpus, the word ends a line or a
sentence, against how often it goes on.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.llm.ranked import range_cumulated
from loomgrain.runtime import arrow_map, staged

SHINGLE, SIMILARITY = 5, 0.8
BANDS, WINDOW = 5, 16  # bands of three min-hashes: of the text up to a place, of its first and its last so many shingles
STEP = 8  # so many near-copies are asked first, then times as many
# A cut may fall anywhere and a whole text only ends where lines do: an end that is but rare is a whole one.
THRESHOLD = 0.04

_CJK = "぀-ヿ㐀-鿿豈-﫿"
_TOKEN = re.compile(rf"[{_CJK}]|[^\s{_CJK}]+")
_DIGIT = re.compile(r"\d")
_ELLIPSIS = re.compile(r"(?:…|\.{3,})$")
_TERMINAL = re.compile("(?:[.!?。！？…‥؟।][\"'”’»」』)\\]]*|[\"”»」』)\\]}]|[\U0001f300-\U0001faff☀-➿]️?)$")
# A piece of a character, or of an HTML entity, percent or backslash escape
_FRAGMENT = re.compile(r"(?:�|&(?:#x?[0-9A-Fa-f]{0,6}|[A-Za-z]{1,8})|%(?:[0-9A-F](?![0-9A-F]))|\\u[0-9A-Fa-f]{0,3}|\\)$")


def shape(word: str, first: bool) -> str:
    """What a word looks like, for words that are too rare to be counted: ~ and ^ for the first of its line, then A, Aa, a, or itself."""
    if word.isalpha():
        word = "a" if word.islower() else "A" if word.isupper() else "Aa"
    return ("~^" if first else "~") + word


def closing(text: str) -> tuple[str, str, str, str]:
    """(kind, word before, its shape, closing word) of a text without trailing white space; digits are masked.

    Kinds: ``frag`` (ends in a piece of a character or escape), ``term`` (ends
    with a closing mark), ``dots`` (ends with an ellipsis), ``plain``.
    """
    line = text[text.rfind("\n") + 1 :]
    words = _TOKEN.findall(line[-400:])
    if len(line) > 400:  # the end of a long line: all but its first, broken word, if that leaves enough
        words = words[1:] if len(words) > 5 else _TOKEN.findall(line)
    words = [_DIGIT.sub("9", w) for w in words[-4:]]
    end = text[-200:]
    kind = "frag" if _FRAGMENT.search(end) else "dots" if _ELLIPSIS.search(end) else "term" if _TERMINAL.search(end) else "plain"
    if kind == "dots" and words and not _ELLIPSIS.sub("", words[-1]):
        kind = "plain"  # an ellipsis of its own: the word before it is the closing word
        words.pop()
    if not words:
        return "term", "^", "^", ""
    before = words[-2] if len(words) > 1 else "^"
    return kind, before, shape(before, len(words) == 2) if len(words) > 1 else "^", words[-1]


_TURN = re.compile(r"(?<=[^\W_])(?=[\W_])|(?<=[\W_])(?=[^\W_])")


def _turns(word: str) -> list[int] | None:
    """Hashes of the beginnings of a word behind which letters and digits give way to other characters, or these to them.

    They are the engine's ``xxhash64`` of the beginnings, taken on the way, so that the work is linear in the length.
    """
    if word.isalnum():
        return None
    import xxhash

    h, at, out = xxhash.xxh64(seed=42), 0, []
    for m in _TURN.finditer(word):
        h.update(word[at : m.start()].encode())
        at = m.start()
        x = h.intdigest()
        out.append(x - (1 << 64) if x >> 63 else x)
    return out


_MID = (0, 1, *([2] * 100_000))  # first word of a line, second, further


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (word before, word) at the end of lines and within them; with the word's shape before, and '*' for any word."""

    def out(counts: Counter) -> pa.RecordBatch:
        n: dict[tuple[str, str], list[int]] = {}
        for (before, word, place), k in counts.items():
            at, place = divmod(place, 3)
            contexts = (before, "*") if place == 0 else (before, "*", shape(before, place == 1))
            for c in contexts:
                n.setdefault((c, word), [0, 0])[at] += k
        keys = list(n)
        turns = {w: _turns(w) for w in {k[1] for k in keys}}
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([v[1] for v in n.values()], pa.int64()), pa.array([v[0] for v in n.values()], pa.int64()), pa.array([turns[k[1]] for k in keys], pa.list_(pa.int64()))],
            names=["before", "word", "n_end", "n_mid", "turns"],
        )

    counts: Counter = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            for line in _DIGIT.sub("9", text).split("\n"):
                words = _TOKEN.findall(line)
                if not words:
                    continue
                last = len(words) - 1
                if last:
                    for k in range(0, last, 100_000):  # a line of any length, in slices
                        places = _MID if not k else repeat(2)
                        counts.update(zip(islice(chain(("^",), words), k, None), words[k : min(last, k + 100_000)], places))
                counts[words[last - 1] if last else "^", words[last], min(last, 2) + 3] += 1
        if len(counts) > 200_000:
            yield out(counts)
            counts = Counter()
    yield out(counts)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each text is judged by, in one pass: its closing, its window keys (see ``_keys``) and its end (see ``_end``)."""
    known: dict[str, int] = {}
    for b in batches:
        texts = b.column(1).to_pylist()
        x = [closing(t) for t in texts]
        cols = [pa.array([r[i] for r in x], pa.string()) for i in range(4)]
        stem = pa.array([_ELLIPSIS.sub("", r[3]) if r[0] == "dots" else r[3] for r in x], pa.string())
        words = [_WORD.findall(t.lower()) for t in texts]
        keys = [_keys(w, known) for w in words]
        ends = [_end(t) for t in texts]
        longs = pa.list_(pa.int64())
        more = [pa.array([len(t) for t in texts], pa.int64()), pa.array([e[0] for e in ends], pa.int64()), pa.array([e[1] for e in ends], pa.int64())]
        more += [pa.array([k[0] for k in keys], pa.int64()), pa.array([max(1, len(w) - SHINGLE + 1) for w in words], pa.int64()), pa.array([k[1] for k in keys], longs), pa.array([k[2] for k in keys], longs)]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols, stem, *more], names=["doc_id", "kind", "before", "shape", "word", "stem", "size", "ask_end", "end", "n_ask", "n_all", "asks", "keys"])


_FEATURES = "doc_id bigint, kind string, before string, shape string, word string, stem string, size bigint, ask_end bigint, end bigint, n_ask bigint, n_all bigint, asks array<bigint>, keys array<bigint>"


def features(texts: DataFrame, name: str = "features") -> DataFrame:
    """The features of distinct ``texts`` (doc_id, text), staged."""
    return staged(arrow_map(texts.select("doc_id", "text"), _features, _FEATURES), name)


def _going_on(counts: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    """(before, word, n_longer, n_on) of the words ``asked``: occurrences of longer words that begin so; ``n_on``: with a letter or digit next.

    In the order of words those that begin with a word follow it directly: sums up to the word and up to the
    end of its range are taken in one range sort, whatever the length of words.
    """
    n = (F.col("n_end") + F.col("n_mid")).alias("n")
    end = F.concat("word", F.lit("\U0010ffff"))
    marks = asked.select("before", F.explode(F.array(F.struct(F.col("word").alias("at"), F.lit(1).alias("mark")), F.struct(end.alias("at"), F.lit(2).alias("mark")))).alias("x"), "word")
    marks = marks.select("before", "x.at", "x.mark", "word", F.lit(0).cast("bigint").alias("n"))
    rows = counts.select("before", F.col("word").alias("at"), F.lit(0).alias("mark"), F.lit(None).cast("string").alias("word"), n).unionByName(marks)
    summed = range_cumulated(rows, [F.col(c).asc() for c in ("before", "at", "mark")], [], "n", name + "-sums").where(F.col("mark") > 0)
    at = lambda m: F.max(F.when(F.col("mark") == m, F.col("total")))
    longer = summed.groupBy("before", "word").agg((at(2) - at(1)).alias("n_longer"))
    # of a word that ends in a letter or digit the turns go on with something else, of another with a letter or digit
    turns = counts.select("before", n, F.explode("turns").alias("h")).groupBy("before", "h").agg(F.sum("n").alias("n_turn"))
    at = longer.withColumn("h", F.xxhash64("word")).join(turns, ["before", "h"], "left").withColumn("n_turn", F.coalesce("n_turn", F.lit(0)))
    on = F.when(F.col("word").rlike(r"[\p{L}\p{N}]\z"), F.col("n_longer") - F.col("n_turn")).otherwise(F.col("n_turn"))
    return at.select("before", "word", "n_longer", on.alias("n_on"))


def terminality(texts: DataFrame, ends: DataFrame | None = None, name: str = "terminality") -> DataFrame:
    """(doc_id, terminality) of distinct ``texts`` (doc_id, text): the share, 0 to 1, of occurrences of the closing word that end there.

    Ends: ends of lines, for a closing mark also of sentences within them.
    Against it count the occurrences that go on within the line, and those where
    a longer word begins with the closing word.  The text's own occurrence does
    not count.  Occurrences are counted after the same word before; where there
    are fewer than three, or none ends and that may be chance, after any word of
    the same shape; where there are none, the word alone is looked at, and at last a closing mark decides.
    Without any of it, that is for a word that no other text has in any form, there is no evidence: null.
    ``ends`` are the ``features`` of the texts, if there already.
    """
    ends = ends or features(texts, name + "-ends")
    counts = staged(arrow_map(texts.select("text"), _count_words, "before string, word string, n_end bigint, n_mid bigint, turns array<bigint>").groupBy("before", "word").agg(F.sum("n_end").alias("n_end"), F.sum("n_mid").alias("n_mid"), F.any_value("turns").alias("turns")), name + "-words")
    asked = ends.where(F.col("kind") != "frag")
    asked = asked.select("before", F.explode(F.array("word", "stem")).alias("word")).union(asked.select("shape", "word")).union(asked.select(F.lit("*"), "word")).distinct()
    asked = staged(asked, name + "-asked")
    longer = _going_on(counts, asked, name)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    stats = asked.join(counts.drop("turns"), ["before", "word"], "left").join(longer, ["before", "word"], "left")
    stats = staged(stats.select("before", "word", *[zero(c).alias(c) for c in ("n_end", "n_mid", "n_longer", "n_on")]), name + "-stats")

    def at(prefix: str, before, word: str):
        s = stats.select(F.col("before").alias(f"{prefix}_b"), F.col("word").alias(f"{prefix}_w"), *[F.col(c).alias(f"{prefix}_{c}") for c in ("n_end", "n_mid", "n_longer", "n_on")])
        return s, (before == F.col(f"{prefix}_b")) & (F.col(word) == F.col(f"{prefix}_w"))

    rows = ends.select("doc_id", "kind", "before", "shape", "word", "stem")
    for prefix, before, word in (("c", F.col("before"), "word"), ("s", F.col("before"), "stem"), ("l", F.col("shape"), "word"), ("a", F.lit("*"), "word")):
        s, on = at(prefix, before, word)
        rows = rows.join(s, on, "left").drop(f"{prefix}_b", f"{prefix}_w")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = lambda e, m, least, other: F.when(e + m >= least, e / (e + m)).otherwise(other)
    own = lambda c: F.greatest(n(c) - 1, F.lit(0))
    ends_here, goes_on = own("c_n_end"), n("c_n_mid") + n("c_n_longer")
    alike = share(own("l_n_end"), n("l_n_mid") + n("l_n_longer"), 3, share(own("a_n_end"), n("a_n_mid") + n("a_n_longer"), 1, F.lit(None)))
    # none of so many ended: by chance (with a probability over one in a hundred), or this word is not like those of its shape
    plain = F.when((ends_here + goes_on >= 3) & ((ends_here > 0) | alike.isNull() | (goes_on * alike > 4.6)), ends_here / F.greatest(ends_here + goes_on, F.lit(1))).otherwise(alike)
    score = (
        F.when(F.col("kind") == "frag", 0.0)
        .when(F.col("kind") == "term", share(ends_here + n("c_n_mid"), n("c_n_on"), 3, F.lit(1.0)))
        .when(F.col("kind") == "dots", share(ends_here + n("c_n_mid"), n("s_n_mid") + n("s_n_end") + n("s_n_on"), 3, F.lit(0.0)))
        .otherwise(plain)
    )
    return rows.select("doc_id", score.alias("terminality"))


_WORD = re.compile(rf"[{_CJK}]{{1,2}}|[^\W{_CJK}]+")  # without spaces two characters make a word


@lru_cache(maxsize=2_000)
def _shingles(text: str) -> set[int]:
    words = _WORD.findall(text.lower())
    return {hash(tuple(words[i : i + SHINGLE])) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


_RNG = np.random.default_rng(9)
_MUL = (_RNG.integers(1, 1 << 63, 3 * BANDS, dtype=np.uint64) | np.uint64(1))[:, None]
_ADD = _RNG.integers(0, 1 << 63, 3 * BANDS, dtype=np.uint64)[:, None]
_BAND = np.arange(BANDS, dtype=np.uint64)[:, None]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _shingle_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of five-word shingles in their order, the same in every process; ``known`` remembers those of words."""
    import xxhash

    if len(known) > 500_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    a = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out = np.zeros(max(0, len(a) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + a[i : i + len(out)]
        out ^= out >> np.uint64(29)
    return out


def _keys(words: list[str], known: dict[str, int]) -> tuple[int | None, np.ndarray | None, np.ndarray | None]:
    """(n, asks, keys) of a text: its number of distinct shingles, its own keys, and those of all its beginnings.

    A key is made of three min-hashes of a band: over all shingles up to a place, over the first ``WINDOW`` of them and over the last.  So a text that goes on behind a place has the same keys there as one that was cut at it, and one with
    misreadings has them in a band with the third power of the similarity.  The keys of neighbouring places mostly
    are the same: a text has about one for six words and band.  The closing word may be
    broken and takes no part.  Texts of fewer than six words have no keys.
    """
    x = _shingle_hashes(words[:-1], known)
    if not len(x):
        return None, None, None
    low = _mixed(x[None, :] * _MUL + _ADD)
    so_far, window, first = np.minimum.accumulate(low[BANDS : 2 * BANDS], axis=1), low[:BANDS], low[2 * BANDS :]
    first[:, :WINDOW] = np.minimum.accumulate(first[:, :WINDOW], axis=1)
    first[:, WINDOW:] = first[:, WINDOW - 1 : WINDOW]
    step = 1
    while step < WINDOW:  # minima over 2, 4, ... shingles
        window[:, step:] = np.minimum(window[:, step:], window[:, :-step].copy())
        step *= 2
    keys = _mixed(_mixed(_mixed(so_far + _BAND) + first) + window).view(np.int64)
    return len(np.unique(x)), keys[:, -1].copy(), np.unique(keys)


def _end(text: str) -> tuple[int | None, int | None]:
    """Hashes of the end of a text, as one that asks and as one that answers: from its last shingle on that leaves 32 characters.

    There ``ends_early`` lays its anchor in two texts with the same end: it aligns the end with itself and the answering text does
    not go on behind it, so the alignment does not tell.  This is not sure, and the hash is null, for an asking text with
    a mark of the cut, which is not aligned, and for an answering one that has the shingle at other places too.
    """
    import xxhash

    words = [(m.group().lower(), m.start()) for m in _WORD.finditer(text)]
    i = next((i for i in range(len(words) - SHINGLE, -1, -1) if words[i][1] <= len(text) - 32), None)
    if i is None:
        return None, None
    end = xxhash.xxh64_intdigest(text[words[i][1] :]) - (1 << 63)
    first, last = words[i][0], [w for w, _ in words[i : i + SHINGLE]]
    once = sum(w == first and [x for x, _ in words[k : k + SHINGLE]] == last for k, (w, _) in enumerate(words)) == 1
    return None if _ELLIPSIS.search(text) or _FRAGMENT.search(text) else end, end if once else None


def _codes(text: str) -> np.ndarray:
    """Code points to be compared: case, digits and kinds of white space do not count."""
    return np.array([32 if c.isspace() else 57 if c.isdigit() else ord(x) if len(x := c.lower()) == 1 else ord(c) for c in text], np.int64)


def _distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The edit distance of ``a`` to each beginning of ``b``; once all of them are over ``most`` it stops."""
    at = np.arange(len(b) + 1)
    d = at.copy()
    for i, c in enumerate(a, 1):
        if not i % 64 and d.min() > most:
            break
        e = np.empty_like(d)
        e[0] = i
        e[1:] = np.minimum(d[:-1] + (b != c), d[1:] + 1)
        d = np.minimum.accumulate(e - at) + at
    return d


def _last_anchor(a: str, b: str) -> tuple[int, int]:
    """Where the last shingle in common begins that leaves 32 characters of ``a``, else the first in common, in both; (0, 0) if there is none."""
    x, y = [[(m.group(), m.start()) for m in _WORD.finditer(t)] for t in (a, b)]
    where: dict[tuple[str, ...], list[int]] = {}
    for i in range(len(y) - SHINGLE + 1):
        where.setdefault(tuple(w.lower() for w, _ in y[i : i + SHINGLE]), []).append(y[i][1])
    found, shift = None, 0
    for i in range(len(x) - SHINGLE + 1):
        at = x[i][1]
        if found and at > len(a) - 32:
            break
        if places := where.get(tuple(w.lower() for w, _ in x[i : i + SHINGLE])):
            k = bisect_left(places, at + shift)  # of repeats the one that goes on from the anchor before
            to = min(places[max(0, k - 1) : k + 1], key=lambda p: abs(p - at - shift))
            found, shift = (at, to), to - at
    return found or (0, 0)


def ends_early(a: str, b: str) -> bool | None:
    """Whether text ``a`` is cut, as its near-copy ``b`` shows; None if their alignment does not tell.

    From the last shingle in common near the end of ``a`` on, the rest of ``a`` is aligned with the
    beginning of the rest of ``b`` that has the least edit distance: at most a fifth of the characters
    may differ, and a third of those of the closing word.  If ``b`` goes on there with the same word,
    sentence or entry, ``a`` is cut; if a line ends there, or ``a`` has a closing mark, it is whole.
    A mark of the cut itself (ellipsis, piece of a character) at the end of ``a`` is not aligned.
    """
    own = _ELLIPSIS.sub("", a) if _ELLIPSIS.search(a) else _FRAGMENT.sub("", a)
    marked = own != a
    if not own.strip():
        return None
    i, j = _last_anchor(own, b)
    x = _codes(own[i:])
    y = _codes(b[j : j + len(x) + len(x) // 4 + 8])
    d = _distances(x, y, len(x) // 5)
    at = min(range(len(d)), key=lambda k: (d[k], abs(k - len(x))))
    word = len(_TOKEN.findall(own[-400:])[-1])
    end = _distances(x[::-1][:word], y[:at][::-1], word)
    if d[at] > len(x) // 5 or end.min() > word // 3 or j + at >= len(b):
        return None
    rest = b[j + at :]
    if own[-1].isalnum() and rest[0].isalnum() or own[-1] in ".,," and rest[0].isdigit():
        return True
    if rest[0] == "\n" or rest.isspace():
        return False
    return marked or not _TERMINAL.search(own)


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        ids, cut = [], []
        for i, a, b in zip(*(x.column(k).to_pylist() for k in range(3))):
            words = _WORD.findall(a.lower())[:-1]
            s = {hash(tuple(words[k : k + SHINGLE])) for k in range(len(words) - SHINGLE + 1)}
            if s and len(s & _shingles(b)) >= SIMILARITY * len(s) and (verdict := ends_early(a, b)) is not None:
                ids.append(i), cut.append(verdict)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cut, pa.bool_())], names=["doc_id", "cut"])


def aligned(texts: DataFrame, ends: DataFrame | None = None, name: str = "aligned") -> DataFrame:
    """(doc_id, cut) of distinct ``texts`` that a near-copy shows to be cut or whole.

    A text asks all others that answer to one of its keys, but for those whose alignment is known to tell nothing: texts with the same
    end (see ``_end``) and those with too few shingles.  So copies with one end do not all meet each other.  Of those of
    one key a text asks the longest and about 8 others first, then about 64, 512 and so on: it goes on until an alignment shows
    it to be cut, or to the last.  It is cut if any near-copy shows it, whole if some tell and none shows a cut.
    """
    ends = ends or features(texts, name + "-ends")
    asks = ends.select(F.col("doc_id").alias("a"), "ask_end", "n_ask", F.explode("asks").alias("key"))
    answers = ends.select(F.col("doc_id").alias("b"), "size", "end", "n_all", F.explode("keys").alias("key"))
    answers = staged(answers.join(asks.select("key").distinct(), "key", "left_semi"), name + "-answers")
    per = answers.groupBy("key", "end").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("size", "b")).alias("top"))
    per = per.groupBy("key").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.max(F.when(F.col("end").isNotNull(), F.struct("n", "end"))).alias("most")).where(F.col("n") > 1)
    # the end that most of a key's answers have: those with it are not even joined with each other
    per = staged(per.select("key", "n", F.col("top.b").alias("top"), F.coalesce("most.n", F.lit(0)).alias("n_most"), F.col("most.end").alias("most")), name + "-crowded")
    has = lambda c: F.coalesce(F.col(c) == F.col("most"), F.lit(False))
    asking = staged(asks.join(per, "key").select("key", has("ask_end").alias("side"), "a", "ask_end", "n_ask"), name + "-asks")
    # about so many of the key's answers come before this one; those with the commonest end come last
    place, others = F.xxhash64("b", "key") / F.lit(2.0**64) + 0.5, F.col("n") - F.col("n_most")
    rank = F.when(F.col("b") == F.col("top"), 0).when(has("end"), others + place * F.col("n_most")).otherwise(place * others)
    level = lambda x: F.coalesce(F.floor(F.log(float(STEP), x * (STEP - 1) / STEP + 1)), F.lit(0)).cast("int")
    sides = F.explode(F.when(has("end"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("side")
    answers = staged(answers.join(per, "key").select("key", sides, "b", "end", "n_all", level(rank).alias("level")), name + "-ranked")
    a, b = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    may_tell = (F.col("a") != F.col("b")) & F.coalesce(F.col("ask_end") != F.col("end"), F.lit(True)) & (F.col("n_all") >= SIMILARITY * F.col("n_ask"))
    found = None
    for k in range(per.agg(level(F.max("n"))).first()[0] + 1):
        pairs = asking.join(answers.where(F.col("level") == k), ["key", "side"]).where(may_tell).select("a", "b").distinct()
        now = arrow_map(staged(pairs, f"{name}-pairs-{k}").join(a, "a").join(b, "b").select("a", "ta", "tb"), _align, "doc_id bigint, cut boolean")
        now = staged(now.groupBy("doc_id").agg(F.max("cut").alias("cut")), f"{name}-{k}")
        found = now if found is None else found.unionByName(now)
        asking = asking.join(now.where("cut").select(F.col("doc_id").alias("a")), "a", "left_anti")
    return found.groupBy("doc_id").agg(F.max("cut").alias("cut"))


def cut_texts(docs: DataFrame, threshold: float = THRESHOLD, name: str = "cut") -> DataFrame:
    """(doc_id, source, cut) of every row of ``docs`` (doc_id, text, source) with a doc_id.

    Null and blank texts, and texts without a letter or digit, are not cut.  Equal
    texts (but for white space at the end) are judged once and all have the same
    verdict; other columns are ignored.  An alignment decides before terminality.
    """
    text = F.regexp_replace(F.col("text"), r"(?U)[\s\p{Z}]+$", "")
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "source", text.alias("text"))
    real = rows.where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    keyed = real.select("doc_id", F.md5("text").alias("h"), "text")
    one = staged(keyed.groupBy("h").agg(F.min(F.struct("doc_id", "text")).alias("x")).select("h", "x.doc_id", "x.text"), name + "-texts")
    texts = one.select("doc_id", "text")
    ends = features(texts, name + "-ends")
    verdict = one.select("h", "doc_id").join(terminality(texts, ends, name + "-t"), "doc_id").join(aligned(texts, ends, name + "-a"), "doc_id", "left")
    verdict = verdict.select("h", F.coalesce("cut", F.col("terminality") < threshold).alias("cut"))
    out = rows.select("doc_id", "source", F.when(F.col("text").rlike(r"[\p{L}\p{N}]"), F.md5("text")).alias("h")).join(verdict, "h", "left")
    return out.select("doc_id", "source", F.coalesce("cut", F.lit(False)).alias("cut"))


def found_cut(docs: DataFrame) -> DataFrame:
    """The doc_id of every cut text."""
    return cut_texts(docs).where("cut").select("doc_id")


def cut_rates(docs: DataFrame) -> DataFrame:
    """(source, n_docs, n_cut, rate) per source; documents without a source are a group of their own (null)."""
    n = F.count(F.lit(1))
    return cut_texts(docs).groupBy("source").agg(n.alias("n_docs"), F.count_if("cut").alias("n_cut"), (F.count_if("cut") / n).alias("rate"))
