"""What external models and services must offer, and deterministic stand-ins for tests.

Providers are plain objects that can be pickled; they are called from
``mapInPandas`` so that a task creates its client once per partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain import schemas
from loomgrain.functions import ocrparse
from loomgrain.runtime import pandas_map


class Search(Protocol):
    def page(self, query: str, offset: int, size: int) -> list[str]: ...


class Fetch(Protocol):
    def get(self, url: str) -> tuple[str, bytes]: ...


class Ocr(Protocol):
    def read(self, path: str) -> list: ...


class Image(Protocol):
    def image(self, prompt: str, seed: int) -> str: ...


class Embed(Protocol):
    def vector(self, text: str) -> list[float]: ...


class Llm(Protocol):
    def answer(self, prompt: str) -> str: ...


class Caption(Protocol):
    def caption(self, path: str, topic: str, subtopic: str) -> str: ...


@dataclass(frozen=True)
class FakeSearch:
    """``total`` numbered URLs per query."""

    total: int = 100

    def page(self, query: str, offset: int, size: int) -> list[str]:
        return [f"dry://{query}/{i}" for i in range(offset, min(offset + size, self.total))]


@dataclass(frozen=True)
class FakeFetch:
    """Answers every URL with its own bytes, repeated to ``size``."""

    size: int = 2048

    def get(self, url: str) -> tuple[str, bytes]:
        b = url.encode()
        return "image/jpeg", (b * (self.size // len(b) + 1))[: self.size]


@dataclass(frozen=True)
class FakeEmbed:
    """A vector from the digest of the text."""

    size: int = 16

    def vector(self, text: str) -> list[float]:
        d = hashlib.sha256(text.encode()).digest()
        return [(d[i % 32] - 127.5) / 127.5 for i in range(self.size)]


@dataclass(frozen=True)
class FakeLlm:
    """Answers from a table of fixed answers, by the words a prompt holds."""

    answers: tuple[tuple[str, str], ...] = ()
    default: str = "[]"

    def answer(self, prompt: str) -> str:
        return next((a for word, a in self.answers if word in prompt), self.default)


def mapped(df: DataFrame, inputs: list[str], output: str, make: Callable[[], Callable], schema: str) -> DataFrame:
    """Adds column ``output`` of type ``schema``: ``make()`` gives the function, once per partition, of the ``inputs``.

    A row for which the function raises has a null; the other rows go on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = make()

        def safe(*x):
            try:
                return f(*x)
            except Exception:
                return None

        for b in batches:
            yield b.assign(**{output: [safe(*r) for r in b[inputs].itertuples(index=False)]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return pandas_map(df, run, f"{fields}, `{output}` {schema}")


def embedded(df: DataFrame, text: str, provider: Embed, output: str = "embedding") -> DataFrame:
    """M1, M2: vectors of a text column."""
    return mapped(df, [text], output, lambda: provider.vector, "array<double>")


def captioned(df: DataFrame, provider: Caption, path: str = "path") -> DataFrame:
    """Captions; where the provider fails the caller falls back to a template."""
    return mapped(df, [path, "topic", "subtopic"], "caption", lambda: provider.caption, "string")


def recognised(df: DataFrame, provider: Ocr, path: str = "path") -> DataFrame:
    """An ``ocr`` record for each image; where the provider fails, an empty one with its error."""

    def make():
        def read(p: str) -> dict:
            try:
                return ocrparse.record(provider.read(p))
            except Exception as e:
                return ocrparse.record(None, type(e).__name__)

        return read

    kind = "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schemas.record("ocr")) + ">"
    return mapped(df, [path], "ocr", make, kind)


def generated(prompts: DataFrame, provider: Image, seed: int = 0) -> DataFrame:
    """``path`` of the image of each prompt, null where none came; the seed is ``seed`` + idx."""
    return mapped(prompts.withColumn("__seed", F.col("idx") + seed), ["prompt", "__seed"], "path", lambda: provider.image, "string").drop("__seed")
