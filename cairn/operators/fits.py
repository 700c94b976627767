"""Least-squares lines, segments and planes of groups of points, with or without weights.

A fit's quality is the ratio of the smaller to the larger spread: 0 is perfect, 1 is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import normals


def moments2(points: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """n, the total weight, the (weighted) centroid (cx, cy) and covariance (xx, xy, yy) of each group in the plane."""
    if weight is None:
        return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).cast("double").alias("w"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.covar_pop("x", "x").alias("xx"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("y", "y").alias("yy"))
    return normals.weighted_moments(points.withColumn("z", F.lit(0.0)), weight, keys).select(*keys, "n", "w", "cx", "cy", "xx", "xy", "yy")


def lines2(points: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Centroid, eigenvalues l1 >= l2, unit direction (dx, dy) and quality of each group's line; without any spread
    in a direction the line lies along x."""
    m = moments2(points, keys, weight)
    high, low = g.eigenvalues2(F.col("xx"), F.col("xy"), F.col("yy"))
    turn = F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2
    return m.select(*keys, "n", "w", "cx", "cy", high.alias("l1"), low.alias("l2"), F.cos(turn).alias("dx"), F.sin(turn).alias("dy"), normals.quality(low, high).alias("quality"))


def segments2(points: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """The part (ax, ay) - (bx, by) of each group's line that its points project onto, and the line's quality."""
    line = lines2(points, keys, weight)
    along: Column = (F.col("x") - F.col("cx")) * F.col("dx") + (F.col("y") - F.col("cy")) * F.col("dy")
    ends = points.join(line, keys).groupBy(*keys).agg(F.min(along).alias("_lo"), F.max(along).alias("_hi"))
    out = [(F.col(f"c{c}") + F.col(e) * F.col(f"d{c}")).alias(n + c) for n, e in (("a", "_lo"), ("b", "_hi")) for c in "xy"]
    return ends.join(line, keys).select(*keys, *out, "quality")


def planes3(points: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Centroid, normal (nx, ny, nz) and quality of each group's plane."""
    m = normals.moments(points, keys) if weight is None else normals.weighted_moments(points, weight, keys)
    p = normals.with_normal(normals.with_eigenvalues(m))
    return p.select(*keys, "n", "cx", "cy", "cz", "nx", "ny", "nz", normals.quality(F.col("l3"), F.col("l2")).alias("quality"))
