"""Languages of recognised texts and of their mixed segments (problem 5).

The script of each word narrows its candidate languages; a word then scores each
candidate by a small model of words and letter groups; Viterbi over the lines of
a record, with a penalty for each switch, labels the runs.  A line keeps one
language (names and sign words of another do not change it), so switches lie
between lines and a line's score is the sum of its words' scores.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrain.runtime import arrow_map

LANGS = ("en", "zh", "de", "ja", "fr", "es", "ru", "ko", "it")
OTHER = "und"  # none of them: another script, or words that none of the labelled documents has
LABELS = (*LANGS, OTHER)
# Other names and codes of the languages, and what stands for "not known".
NAMES = {
    "en": ("en", "eng", "english"), "zh": ("zh", "zho", "chi", "chinese", "cmn"), "de": ("de", "deu", "ger", "german"),
    "ja": ("ja", "jpn", "jp", "japanese"), "fr": ("fr", "fra", "fre", "french"), "es": ("es", "spa", "spanish"),
    "ru": ("ru", "rus", "russian"), "ko": ("ko", "kor", "kr", "korean"), "it": ("it", "ita", "italian"),
}
UNKNOWN = ("", "und", "unknown", "n/a", "na", "none", "null", "nan", "mul", "mis", "zxx", "?", "-", "--", "other", "auto", "undefined", "not known")
CLIP, FOREIGN, SWITCH = -6.0, -8.0, 3.0
PER_LANGUAGE = 3_000
LATIN = (0, 2, 4, 5, 8)  # languages whose script is that of many others
LEAST_KNOWN, LEAST_WORDS = 0.3, 6  # of so many words and more in a segment of these, this share is known in its language

_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ々]+")


def language_code(c: Column) -> Column:
    """Two-letter code of a language name or code; null for null, blank and stand-ins; else the text as it stands, in lower case."""
    low = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    base = F.regexp_extract(low, r"^([^\-_ (]+)", 1)
    table = F.create_map(*[F.lit(x) for code, names in NAMES.items() for n in names for x in (n, code)])
    return F.when(low.isin(*UNKNOWN) | low.isNull(), None).otherwise(F.coalesce(F.try_element_at(table, low), F.try_element_at(table, base), low))


def tokens(line: str) -> list[str]:
    """Words of a line in lower case; of Han and kana runs the pairs of neighbouring characters."""
    if not line.isascii():
        line = unicodedata.normalize("NFC", line)
    words = _WORD.findall(line.lower())
    if line.isascii():
        return words
    out = []
    for w in words:
        at = 0
        for m in _CJK.finditer(w):
            if m.start() > at:
                out.append(w[at : m.start()])
            run = m.group()
            out += [run[i : i + 2] for i in range(max(1, len(run) - 1))]
            at = m.end()
        if at < len(w):
            out.append(w[at:])
    return out


def candidates(token: str) -> tuple[int, ...]:
    """Indexes of the languages written in the token's script; none, for a script of none of them."""
    o = max(map(ord, token))
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return LATIN
    if 0x400 <= o < 0x530:
        return (6,)
    if 0x1100 <= o < 0x1200 or 0x3130 <= o < 0x3190 or 0xAC00 <= o < 0xD7B0:
        return (7,)
    if any(0x3040 <= ord(x) < 0x3100 or 0xFF66 <= ord(x) < 0xFFA0 for x in token):
        return (3,)
    if 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00 or token == "々":
        return (1, 3)
    return ()


def _grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


class Scorer:
    """Scores of words, by language: log posterior under equal priors, clipped, plus a penalty outside the script's candidates.

    A word in a script of none of the languages is penalised in all, any other in ``OTHER``. Beside the scores stands
    whether the labelled documents have the word in that language.
    """

    def __init__(self, counts: dict[str, np.ndarray], memory: int = 1_000_000):
        self.counts, self.memory = counts, memory
        n = len(LANGS)
        total, grams = np.zeros(n), defaultdict(lambda: np.zeros(n))
        for word, c in counts.items():
            total += c
            if not _CJK.match(word):
                for g in _grams(word):
                    grams[g] += np.sqrt(c)
            elif len(word) == 2:
                for ch in word:
                    grams[ch] += c
        self.total, self.grams = total + 1.0, grams
        self.gram_total = sum(grams.values(), np.zeros(n)) + 1.0
        self.known: dict[str, int] = {}
        self.rows = np.zeros((4096, 2 * n + 1), np.float32)

    def _row(self, word: str) -> np.ndarray:
        allowed = candidates(word)
        if not allowed:
            return np.concatenate([np.full(len(LANGS), FOREIGN), np.zeros(len(LANGS) + 1)])
        c = self.counts.get(word)
        return np.concatenate([self._score(word, c, allowed), [FOREIGN], np.zeros(len(LANGS)) if c is None else c > 0])

    def _score(self, word: str, c: np.ndarray | None, allowed: tuple[int, ...]) -> np.ndarray:
        if c is not None and c.sum() >= 2:
            logp = np.log((c + 0.05) / self.total)
        else:
            parts = list(word) if _CJK.match(word) else _grams(word)
            zero = np.zeros(len(LANGS))
            logp = 0.6 * sum(np.log((self.grams.get(g, zero) + 0.3) / self.gram_total) for g in parts)
            logp[LANGS.index("ja")] -= 1.0  # Han without kana: of no other weight where the script decides
        mask = np.full(len(LANGS), FOREIGN)
        mask[list(allowed)] = 0.0
        best = logp[list(allowed)]
        norm = best.max() + np.log(np.exp(best - best.max()).sum())
        return np.where(mask < 0, FOREIGN, np.maximum(logp - norm, CLIP))

    def index(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.memory:
            known.clear()
        for w in set(words).difference(known):
            i = len(known)
            if i >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[i] = self._row(w)
            known[w] = i
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def lines(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores by line and label, words in each line, those of them known in each language)."""
        split = [tokens(x) for x in lines]
        n = np.fromiter(map(len, split), np.int64, len(split))
        at = self.index(list(chain.from_iterable(split)))
        out = np.zeros((len(lines), self.rows.shape[1]), np.float32)
        full = np.flatnonzero(n)
        if len(full):
            starts = (np.cumsum(n) - n)[full]
            # in slices, so that the gathered scores stay small
            for k in range(0, len(full), 50_000):
                f, lo = full[k : k + 50_000], starts[k]
                hi = starts[k + 50_000] if k + 50_000 < len(full) else len(at)
                out[f] = np.add.reduceat(self.rows[at[lo:hi]], starts[k : k + 50_000] - lo, axis=0)
        return out[:, : len(LABELS)], n, out[:, len(LABELS) :]


def viterbi(score: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best path over the rows of ``score``; a change of column costs ``switch``.  Ties: stay, then the first column."""
    best = score.argmax(1)
    if (best == best[0]).all():
        return best
    n, path = len(score), np.zeros_like(best)
    back = np.zeros(score.shape, np.int64)
    v = score[0].astype(np.float64)
    stay = np.arange(score.shape[1])
    for i in range(1, n):
        top = int(v.argmax())
        move = v[top] - switch
        back[i] = np.where(v >= move, stay, top)
        v = np.maximum(v, move) + score[i]
    path[-1] = int(v.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def segments(score: np.ndarray, words: np.ndarray, known: np.ndarray | None = None, switch: float = SWITCH) -> list[tuple[int, int, str, float]]:
    """(first line, lines, language, confidence) of the runs of a record; none without letters.

    ``words`` and ``known`` count the words of each line, and those known in each language.  Scores of words that
    stand together are not independent: the confidence is the share of the language when the sum of n words counts as
    that of their square root.  A run in Latin letters whose words are hardly known in its language is ``OTHER``, with the share that is not known.
    """
    rows = np.flatnonzero(words)
    if not len(rows):
        return []
    path = viterbi(score[rows], switch)
    cut = np.flatnonzero(np.diff(path)) + 1
    first = np.concatenate([[0], cut])
    out = []
    for k, i in enumerate(first):
        j = first[k + 1] if k + 1 < len(first) else len(rows)
        at = 0 if k == 0 else int(rows[i])  # lines without letters belong to the segment before
        end = int(rows[j]) if k + 1 < len(first) else len(words)
        n, lang = int(words[rows[i:j]].sum()), int(path[i])
        total = score[rows[i:j]].sum(0).astype(np.float64) / np.sqrt(n)
        e = np.exp(total - total.max())
        sure = float(e[lang] / e.sum())
        if known is not None and lang in LATIN and n >= LEAST_WORDS and (share := float(known[rows[i:j], lang].sum()) / n) < LEAST_KNOWN:
            lang, sure = len(LANGS), 1 - share
        if out and out[-1][2] == LABELS[lang]:  # two runs of other languages are one
            out[-1] = (out[-1][0], end - out[-1][0], LABELS[lang], min(sure, out[-1][3]))
        else:
            out.append((at, end - at, LABELS[lang], sure))
    return out


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Counts of words by language from labelled documents: at most ``per_language`` of each language, by hash of doc_id."""
    code = language_code(F.col("lang"))
    rows = docs.select("doc_id", "text", code.alias("lang")).where(F.col("lang").isin(*LANGS) & F.col("text").isNotNull())
    # the smallest hashes of a language: a bounded heap per task, no ranking of the whole table in one
    picked = rows.withColumn("h", F.xxhash64("doc_id"))
    sizes = picked.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(per_language)) * 1.2 / F.col("n"))
    bounds = F.broadcast(sizes.select("lang", ((share - 0.5) * F.lit(2.0**64)).alias("upto")))  # a row per language
    picked = picked.join(bounds, "lang").where(F.col("h").cast("double") <= F.col("upto"))
    picked = picked.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], int] = defaultdict(int)
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for t in tokens(text):
                    n[lang, t] += 1
        keys = list(n)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(n.values()), pa.int64())], names=["lang", "word", "n"])

    table = arrow_map(picked.select("text", "lang"), count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    out: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGS)))
    for r in table.toLocalIterator():  # bounded by the sample
        out[r["word"]][LANGS.index(r["lang"])] = r["n"]
    return dict(out)


_SEGMENT = "item_id bigint, segments array<struct<first_line:int,n_lines:int,lang:string,confidence:double>>"


def detect(ocr: DataFrame, counts: dict[str, np.ndarray], switch: float = SWITCH) -> DataFrame:
    """(item_id, segments) of each row of ``ocr`` (item_id, texts); rows without letters have none.

    A null line is a line without letters.  Repeated rows stay repeated.
    """
    model = ocr.sparkSession.sparkContext.broadcast(counts)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        kind = pa.list_(pa.struct([("first_line", pa.int32()), ("n_lines", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))
        for b in batches:
            records = [x or [] for x in b.column(1).to_pylist()]
            score, words, known = scorer.lines([x or "" for x in chain.from_iterable(records)])
            out, at = [], 0
            for r in records:
                found = segments(score[at : at + len(r)], words[at : at + len(r)], known[at : at + len(r)], switch)
                out.append([dict(zip(("first_line", "n_lines", "lang", "confidence"), s)) for s in found])
                at += len(r)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["item_id", "segments"])

    return arrow_map(ocr.select("item_id", "texts"), label, _SEGMENT)


def latest_language(quality: DataFrame) -> DataFrame:
    """(item_id, code) of the latest assessment; without a time it is the earliest, at the same time the greatest code holds."""
    at = F.coalesce(F.col("assessed_at"), F.lit("0001-01-01").cast("timestamp_ntz"))
    rows = quality.where(F.col("item_id").isNotNull()).select("item_id", at.alias("at"), F.coalesce(language_code(F.col("lang")), F.lit("")).alias("code"))
    last = rows.groupBy("item_id").agg(F.max(F.struct("at", "code")).alias("x"))
    return last.select("item_id", F.nullif(F.col("x.code"), F.lit("")).alias("code"))


def record_segments(ocr: DataFrame, docs: DataFrame, per_language: int = PER_LANGUAGE, switch: float = SWITCH) -> DataFrame:
    """(item_id, segments), one row per item with letters; of differing rows of an item the one with the most lines holds, then the surest, then the greatest."""
    found = detect(ocr.where(F.col("item_id").isNotNull()), train(docs, per_language), switch).where(F.size("segments") > 0)
    best = F.struct(F.aggregate("segments.n_lines", F.lit(0), lambda x, y: x + y), F.array_min("segments.confidence"), "segments")
    return found.groupBy("item_id").agg(F.max(best).alias("x")).select("item_id", "x.segments")


def relabelled(ocr: DataFrame, quality: DataFrame, docs: DataFrame, per_language: int = PER_LANGUAGE, switch: float = SWITCH) -> DataFrame:
    """(item_id, first_line, n_lines, lang, confidence) of the records whose label is missing, wrong or too narrow.

    That is: the latest ``lang`` is missing, names a language that is not among
    the segments, or there are several languages.  ``language_ok`` is not used.
    Texts are scored before the join, so only segments are exchanged.
    """
    rows = record_segments(ocr, docs, per_language, switch).join(latest_language(quality), "item_id", "left")
    langs = F.array_distinct(F.col("segments.lang"))
    bad = F.col("code").isNull() | ~F.array_contains(langs, F.col("code")) | (F.size(langs) > 1)
    return rows.where(bad).select("item_id", F.inline("segments"))
