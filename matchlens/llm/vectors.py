"""Vectors of whole numbers from a column of arrays, shared by operators 11 and 12."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A component x becomes floor(SCALE * x).
SCALE = 256
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    def finite(x):
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))

    return F.col(vector).isNotNull() & F.forall(vector, finite)


def widest(df: DataFrame, vector: str) -> int:
    """Components of the longest vector; 0 without vectors."""
    return df.agg(F.max(F.size(vector))).first()[0] or 0


def whole(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of floor(SCALE * x), filled up with zeros to ``width``.

    As float64, where each is exact: a power of two only shifts a number.
    """
    values = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.zeros((len(sizes), width))
    with np.errstate(over="ignore"):  # past the largest double: as the largest
        scaled = np.nan_to_num(np.floor(SCALE * values))
    if len(sizes):
        rows[np.arange(width) < sizes[:, None]] = scaled
    return rows


def exact(rows: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python integers, for sums beyond 64 bits."""
    out = np.empty(rows.shape, dtype=object)
    out.ravel()[:] = [int(v) for v in rows.ravel()]
    return out


def as_longs(values: np.ndarray) -> np.ndarray:
    """Whole numbers as longs; beyond their range, the nearest long."""
    if values.dtype != object:
        return values.astype(np.int64)
    return np.array([min(max(int(v), LEAST), MOST) for v in values.ravel()], dtype=np.int64).reshape(
        values.shape
    )
