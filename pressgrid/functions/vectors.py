"""Vectors and 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def hamming64(a: Column, b: Column) -> Column:
    """Share of the 64 bits that differ."""
    return F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b of unit vectors (P25)."""
    return F.lit(1.0) - dot(a, b)


def l2_normalize(a: Column) -> Column:
    """Length 1; a zero vector stays."""
    size = F.sqrt(dot(a, a))
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(a.cast("array<double>"))


def median_bits(values: Column) -> Column:
    """64 numbers to 64 bits: bit i (from 0, the lowest) is set where number i exceeds the median of all but the first (V1)."""
    def bits(median: Column) -> Column:
        each = F.transform(F.slice(values, 1, 63), lambda x, i: F.when(x.cast("double") > median, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
        low = F.aggregate(each, F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))
        return low.bitwiseOR(F.when(values[63].cast("double") > median, F.lit(-(1 << 63))).otherwise(F.lit(0).cast("bigint")))

    # The list of one binds the median, which would else be sorted for anew for each bit.
    return F.transform(F.array(F.sort_array(F.slice(values, 2, 63))[31].cast("double")), bits)[0]


def _dct_rows(n: int, keep: int) -> np.ndarray:
    k, x = np.arange(keep)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


@F.pandas_udf(T.LongType())
def phash(gray: pd.Series) -> pd.Series:
    """64-bit perceptual hash of a 32x32 grey image given as 1024 numbers, row by row: its 8x8 lowest frequencies by :func:`median_bits` (V1)."""
    rows = _dct_rows(32, 8)

    def bits(g) -> int | None:
        if g is None or len(g) != 1024:
            return None
        low = (rows @ np.asarray(g, float).reshape(32, 32) @ rows.T).ravel()
        return int(np.packbits(low > np.median(low[1:]), bitorder="little").view("<i8")[0])

    return gray.map(bits).astype("Int64")
