"""Approximate equality of floating-point columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def within(a: Column, b: Column, tolerance: float) -> Column:
    """By absolute difference."""
    return F.abs(a - b) <= tolerance


def sequences_within(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two arrays have as many elements, pair by pair no farther apart than the tolerance."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: within(x, y, tolerance)), lambda x: F.coalesce(x, F.lit(False)))


def ulp_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Representable numbers between two arrays, as unsigned integers; not a number is farthest from all."""
    kind = np.uint64 if a.dtype == np.float64 else np.uint32
    top = kind(1) << kind(a.dtype.itemsize * 8 - 1)

    def ordered(x: np.ndarray) -> np.ndarray:
        u = x.view(kind)
        return np.where(u & top != 0, ~u + kind(1), u | top)

    p, q = ordered(np.ascontiguousarray(a)), ordered(np.ascontiguousarray(b))
    d = np.where(p > q, p - q, q - p)
    return np.where(np.isnan(a) | np.isnan(b), np.iinfo(kind).max, d)


def almost_equal(steps: int = 4):
    """A function of two double columns: are they at most ``steps`` representable numbers apart?"""

    @F.pandas_udf("boolean")
    def check(a, b):
        import pandas as pd

        return pd.Series(ulp_distance(a.to_numpy(np.float64, na_value=np.nan), b.to_numpy(np.float64, na_value=np.nan)) <= steps)

    return check
