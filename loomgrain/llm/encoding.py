"""Encoding of texts with a public byte-level BPE vocabulary (problem 7).

Corpus-level merge replay: the distinct words of a slice of the corpus are laid
out as one sequence of symbols; an inverted index maps each pair of neighbouring
symbols to its positions; merges are applied in rank order to all positions of
their pair at once, and only the touched neighbours are entered anew.  Words are
encoded once per slice, however often they occur, and texts need no shuffle.
"""

from __future__ import annotations

import heapq
import json
import os
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.runtime import arrow_map

TOKENIZER_DIR = os.environ.get("LOOMGRAIN_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"

# Fixed value: the public split pattern of this vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, as letter -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeReplay:
    """The merge table of a vocabulary file, and its replay over a list of words."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab: dict[str, int] = model["vocab"]
        self.byte_id = [0] * 256
        for letter, byte in _byte_letters().items():
            self.byte_id[byte] = vocab[letter]
        # (left id, right id) -> (rank, id of the merged token)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word."""
        ids: list[int] = []  # -1 ends a word
        for w in words:
            ids += [self.byte_id[b] for b in w]
            ids.append(-1)
        n, merges = len(ids), self.merges
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        index: dict[tuple[int, int], list[int]] = defaultdict(list)  # pair -> positions of its left symbol
        for i in range(n - 1):
            pair = (ids[i], ids[i + 1])
            if pair in merges:
                index[pair].append(i)
        due = [(*merges[p], p) for p in index]  # a pair is listed once, when its first position comes
        heapq.heapify(due)
        while due:
            _, merged, pair = heapq.heappop(due)
            a, b = pair
            at = index.pop(pair)
            if a == b:
                at.sort()  # overlapping occurrences are taken from the left
            for i in at:
                if ids[i] != a:
                    continue
                j = right[i]
                if j >= n or ids[j] != b:
                    continue
                ids[i], ids[j] = merged, -2  # -2: absorbed
                k = right[i] = right[j]
                if k < n:
                    left[k] = i
                h = left[i]
                for new, pos in (((ids[h], merged), h), ((merged, ids[k]), i)) if k < n and h >= 0 else (((merged, ids[k]), i),) if k < n else ():
                    if new in merges:
                        if new not in index:
                            heapq.heappush(due, (*merges[new], new))
                        index[new].append(pos)
        out: list[list[int]] = []
        word: list[int] = []
        for x in ids:
            if x >= 0:
                word.append(x)
            elif x == -1:
                out.append(word)
                word = []
        return out


@lru_cache(maxsize=4)
def _replay(path: str) -> MergeReplay:
    return MergeReplay(path)


class Encoder:
    """Encodes batches of texts; remembers the words it has met, up to ``memory`` of them at a time."""

    def __init__(self, path: str, memory: int = 500_000):
        import regex

        self.replay, self.known, self.memory = _replay(path), {}, memory
        self.split = regex.compile(SPLIT).findall

    def __call__(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        known = self.known
        new = [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in known]
        if len(known) + len(new) > self.memory:
            known.clear()
            new = list(dict.fromkeys(chain.from_iterable(split)))
        known.update(zip(new, self.replay.encode([w.encode("utf-8") for w in new])))
        return [list(chain.from_iterable(map(known.__getitem__, words))) for words in split]


def _path(vocabulary: str, folder: str | None) -> str:
    return os.path.join(folder or TOKENIZER_DIR, vocabulary)


def token_ids(docs: DataFrame, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of each text without special tokens.

    ``docs``: doc_id, text; other columns are ignored.  A null text and an empty
    text have the empty list; the names of special tokens are ordinary text.
    Rows keep their number and repeats.
    """
    path = _path(vocabulary, folder)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for b in batches:
            ids = encoder(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), encode, "doc_id bigint, ids array<int>")


def token_counts(docs: DataFrame, keep: list[str], vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``tokens``, the number of ids of ``text``."""
    path, kept = _path(vocabulary, folder), docs.select(*keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for b in batches:
            n = [len(x) for x in encoder(b.column(b.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", tokens bigint"
    return arrow_map(docs.select(*keep, F.col("text").cast("string").alias("__text")), count, schema)
