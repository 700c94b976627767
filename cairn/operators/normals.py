"""Second moments of groups of points, and what follows from them: principal axes, planes, lines, normals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..plans import storage
from . import neighbours

COVARIANCE = ("xx", "xy", "xz", "yy", "yz", "zz")


def moments(points: DataFrame, keys: list[str]) -> DataFrame:
    """n, centroid (cx, cy, cz) and population covariance of each group, in one aggregation."""
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"c{c}") for c in "xyz"], *[F.covar_pop(k[0], k[1]).alias(k) for k in COVARIANCE])


def weighted_moments(points: DataFrame, weight: str, keys: list[str]) -> DataFrame:
    """As moments, weighted; covariances are about the weighted centroid."""
    w = F.col(weight)
    s = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), *[F.sum(w * F.col(c)).alias(f"s{c}") for c in "xyz"], *[F.sum(w * F.col(k[0]) * F.col(k[1])).alias(f"s{k}") for k in COVARIANCE])
    s = s.withColumns({f"c{c}": F.try_divide(F.col(f"s{c}"), F.col("w")) for c in "xyz"})
    return s.withColumns({k: F.try_divide(F.col(f"s{k}"), F.col("w")) - F.col(f"c{k[0]}") * F.col(f"c{k[1]}") for k in COVARIANCE}).drop(*[f"s{c}" for c in "xyz"], *[f"s{k}" for k in COVARIANCE])


def _stepped(df: DataFrame, steps: list[dict[str, Column]]) -> DataFrame:
    for step in steps:
        df = df.withColumns(step)
    return df.drop("_q", "_p", "_det", "_phi", "_best", "_length", "_u", "_v", "_w", "_sign")


def with_eigenvalues(m: DataFrame) -> DataFrame:
    """l1 >= l2 >= l3 of the covariance."""
    return _stepped(m, g.eigenvalue_steps(g.vec(*COVARIANCE)))


def with_normal(m: DataFrame) -> DataFrame:
    """(nx, ny, nz): the unit direction of least spread, its largest component positive; (0, 0, 1) without any."""
    return _stepped(m, g.eigenvector_steps(g.vec(*COVARIANCE), F.col("l3"), ("nx", "ny", "nz")))


def with_axis(m: DataFrame) -> DataFrame:
    """(ax, ay, az): the unit direction of greatest spread."""
    return _stepped(m, g.eigenvector_steps(g.vec(*COVARIANCE), F.col("l1"), ("ax", "ay", "az")))


def planes(points: DataFrame, keys: list[str]) -> DataFrame:
    """Moments, eigenvalues and normal of each group."""
    return with_normal(with_eigenvalues(moments(points, keys)))


def point_normals(points: DataFrame, k: int = 45, near: DataFrame | None = None, pid: str = "pid") -> DataFrame:
    """The normal of each point's k nearest points, itself included (as many as there are)."""
    near = neighbours.knn_join(points, points, k, pid=pid) if near is None else near
    nb = near.select(pid, "nbr_id").join(points.select(F.col(pid).alias("nbr_id"), "x", "y", "z"), "nbr_id")
    return planes(nb, [pid]).select(pid, "n", "nx", "ny", "nz", "l1", "l2", "l3")


def oriented_normals(points: DataFrame, k: int = 45, pid: str = "pid") -> DataFrame:
    """Normals estimated again from the neighbours whose normals point the same way, keeping their signs.

    All points are re-estimated at once from the first normals, so the order of rows does not matter.
    """
    near = storage.stored(neighbours.knn_join(points, points, k, pid=pid).select(pid, "nbr_id"), "near")
    first = storage.stored(point_normals(points, k, near, pid), "normals")  # used twice
    a = first.select(pid, *[F.col(f"n{c}").alias(f"a{c}") for c in "xyz"])
    b = first.select(F.col(pid).alias("nbr_id"), *[F.col(f"n{c}").alias(f"b{c}") for c in "xyz"])
    kept = near.select(pid, "nbr_id").join(a, pid).join(b, "nbr_id").filter(g.dot(g.vec("ax", "ay", "az"), g.vec("bx", "by", "bz")) >= 0).select(pid, "nbr_id")
    nb = kept.join(points.select(F.col(pid).alias("nbr_id"), "x", "y", "z"), "nbr_id")
    new = planes(nb, [pid]).join(a, pid)
    sign = F.when(g.dot(g.vec("nx", "ny", "nz"), g.vec("ax", "ay", "az")) < 0, -1.0).otherwise(1.0)
    return new.select(pid, "n", *[(F.col(f"n{c}") * sign).alias(f"n{c}") for c in "xyz"])


def quality(smaller: Column, larger: Column) -> Column:
    """0 for a perfect fit, 1 for none: the ratio of two spreads."""
    return F.coalesce(F.try_divide(smaller, larger), F.lit(1.0))
