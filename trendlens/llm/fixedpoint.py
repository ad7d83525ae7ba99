"""Vectors as whole numbers: floor(scale * component), exactly."""
from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG = (1 << 63) - 1


def finite_vectors(df: DataFrame, column: str) -> Column:
    """Whether the vector is there and holds neither nulls nor non-finite components."""
    v = F.col(column).cast("array<double>")
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column whose vectors all have ``dim`` components."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def floors(x: np.ndarray, scale: int, safe: int) -> np.ndarray:
    """floor(scale * x), the product in double precision: as int64 where every result is below ``safe`` in size, else as
    Python integers, which are slower and have no limit."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < safe:
        return y.astype(np.int64)
    out = np.empty(x.shape, object)
    out.ravel()[:] = [math.floor(p) if math.isfinite(p) else math.floor(Fraction(v) * scale)
                      for p, v in zip(y.ravel().tolist(), x.ravel().tolist())]
    return out


def held_in_long(values) -> list[int]:
    """Whole numbers, those beyond a long at its ends."""
    return [max(-LONG - 1, min(LONG, int(v))) for v in values]
