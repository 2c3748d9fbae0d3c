"""Perceptual hashes as signed 64-bit numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from loomgrain.runtime import ship_active


def from_hex(c: Column) -> Column:
    """16 hex digits as a bigint; null if it is anything else."""
    h = F.lower(F.trim(c))
    return F.when(h.rlike(r"^[0-9a-f]{16}\z"), F.conv(h, 16, -10).cast("bigint"))


def to_hex(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    """X6."""
    return F.bit_count(a.bitwiseXOR(b))


def dct_hash(gray: np.ndarray) -> int | None:
    """64-bit hash of a grey image of 32 x 32 or more: signs of the low DCT block against its median.

    The image is reduced to 32 x 32 by block means; bits are not those of other libraries.
    """
    if gray.ndim != 2 or min(gray.shape) < 32:
        return None
    rows = np.linspace(0, gray.shape[0], 33).astype(int)
    cols = np.linspace(0, gray.shape[1], 33).astype(int)
    small = np.add.reduceat(np.add.reduceat(gray.astype(float), rows[:-1], 0), cols[:-1], 1)
    small /= np.outer(np.diff(rows), np.diff(cols))
    k, n = np.arange(8)[:, None], np.arange(32)[None, :]
    basis = np.cos(np.pi * k * (2 * n + 1) / 64)
    low = basis @ small @ basis.T
    bits = (low > np.median(low)).ravel()
    return int(np.packbits(bits).view(">i8")[0])


@F.pandas_udf(LongType())
def _phash(image: pd.DataFrame) -> pd.Series:

    def one(h: int, w: int, c: int, data: bytes) -> int | None:
        if h is None or h <= 0 or not data:
            return None
        x = np.frombuffer(data, np.uint8).reshape(h, w, c)
        gray = x[..., :3] @ np.array([0.114, 0.587, 0.299]) if c >= 3 else x[..., 0]
        return dct_hash(gray)

    return pd.Series([one(*r) for r in zip(image["height"], image["width"], image["nChannels"], image["data"])], dtype="Int64")


def phash(image: Column) -> Column:
    """X5 over Spark's image struct (height, width, nChannels, data in BGR); null where there are no pixels."""
    ship_active()
    return _phash(image)
