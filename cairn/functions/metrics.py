"""Distances and similarities of numeric arrays of equal length, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def squared_euclidean(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """Similarity; null if either vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def angular(a: Column, b: Column) -> Column:
    """The angle in units of pi."""
    return F.acos(F.greatest(F.least(cosine(a, b), F.lit(1.0)), F.lit(-1.0))) / math.pi


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima; null if both are zero."""
    return F.try_divide(_sum(F.zip_with(a, b, lambda x, y: F.least(x, y))), _sum(F.zip_with(a, b, lambda x, y: F.greatest(x, y))))


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))
