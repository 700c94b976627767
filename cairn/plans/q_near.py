"""Queries: nearest-neighbour joins and what is built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import filters, neighbours, normals, stats, voxels
from . import storage
from .registry import D2, PTS, SRC_TGT, eigen_sql, two_scans, knn_sql, moments_sql, normal_sql, pts, query, r, rounded


def _d2():
    return rounded("d2", 9).alias("d2")


_KNN_OUT = f"select pid, nbr_id, rank::int as rank, {r('d2', 'd2', 9)} from knn"


@query("knn_self_join", f"with {PTS}, {knn_sql('pts', 'pts', 45)} {_KNN_OUT}")
def knn_self_join(spark, sf):
    p = pts(spark, sf)
    return neighbours.knn_join(p, p, 45).select("pid", "nbr_id", "rank", _d2())


@query("knn_self_join_grid", f"with {PTS}, {knn_sql('pts', 'pts', 8)} {_KNN_OUT}")
def knn_self_join_grid(spark, sf):
    """The way that large targets take."""
    p = pts(spark, sf)
    return neighbours.knn_join(p, p, 8, small=0).select("pid", "nbr_id", "rank", _d2())


@query("nn_join", f"with {SRC_TGT}, {knn_sql('src', 'tgt', 1)} select pid, nbr_id, {r('d2', 'd2', 9)} from knn")
def nn_join(spark, sf):
    s, t = two_scans(spark, sf)
    return neighbours.nn_join(s, t).select("pid", "nbr_id", _d2())


@query("nearest_other", f"with {PTS}, {knn_sql('pts', 'pts', 1, 'a.pid <> b.pid')} select pid, nbr_id, {r('sqrt(d2)', 'd', 9)} from knn")
def nearest_other(spark, sf):
    p = pts(spark, sf)
    return neighbours.nn_join(p, p, include_self=False).select("pid", "nbr_id", rounded(F.sqrt("d2"), 9).alias("d"))


@query("knn_in_radius", f"with {PTS}, {knn_sql('pts', 'pts', 10, D2 + ' < 0.02')} {_KNN_OUT}")
def knn_in_radius(spark, sf):
    p = pts(spark, sf)
    return neighbours.knn_join(p, p, 10, below=0.02).select("pid", "nbr_id", "rank", _d2())


_MAN = "(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z))"


@query("knn_manhattan", f"with {PTS}, d as (select a.pid, b.pid as nbr_id, {_MAN} as d from pts a, pts b), k as (select *, row_number() over (partition by pid order by d * d, nbr_id) as rank from d) select pid, nbr_id, rank::int as rank, {r('d', 'd', 9)} from k where rank <= 6")
def knn_manhattan(spark, sf):
    """Nearest by the sum of the coordinates' differences, from columns of other names."""
    p = pts(spark, sf).toDF("number", "label", "east", "north", "up")
    near = neighbours.knn_join(p, p, 6, pid="number", xyz=("east", "north", "up"), metric=neighbours.manhattan)
    return near.select(F.col("number").alias("pid"), "nbr_id", "rank", rounded(F.sqrt("d2"), 9).alias("d"))


@query("radius_join", f"with {PTS} select a.pid, b.pid as nbr_id, {r(D2, 'd2', 9)} from pts a, pts b where {D2} < 0.01")
def radius_join(spark, sf):
    p = pts(spark, sf)
    return neighbours.radius_join(p, p, 0.01).select("pid", "nbr_id", _d2())


_CELLS = " and ".join(f"abs(floor(a.{c} / 0.05) - floor(b.{c} / 0.05)) <= 1" for c in "xyz")


@query("grid_radius_join", f"with {PTS} select a.pid, b.pid as nbr_id, {r(D2, 'd2', 9)} from pts a, pts b where {_CELLS} and {D2} <= 0.008")
def grid_radius_join(spark, sf):
    p = pts(spark, sf)
    return neighbours.grid_radius_join(p, p, 0.05, 0.008).select("pid", "nbr_id", _d2())


@query("mean_spacing", f"with {PTS}, {knn_sql('pts', 'pts', 1, 'a.pid <> b.pid')} select {r('avg(sqrt(d2))', 'spacing', 9)} from knn")
def mean_spacing(spark, sf):
    return filters.mean_spacing(pts(spark, sf)).select(rounded("spacing", 9).alias("spacing"))


def _sor_sql(k: int, m: float, name: str = "pts") -> str:
    return (
        knn_sql(name, name, k, "a.pid <> b.pid", "so")
        + f", md as (select pid, avg(sqrt(d2)) as m from so group by pid), lim as (select avg(m) + {m} * stddev_samp(m) as l from md), kept as (select {name}.* from {name} join md using (pid), lim where m <= l)"
    )


@query("sor_filter", f"with {PTS}, {_sor_sql(14, 2.7)} select pid, label from kept")
def sor_filter(spark, sf):
    return filters.remove_outliers(pts(spark, sf), 14, 2.7).select("pid", "label")


@query("sor_filter_series", f"with {PTS}, {_sor_sql(14, 5.0)} select pid, label from kept")
def sor_filter_series(spark, sf):
    return filters.remove_outliers(pts(spark, sf), 14, 5.0).select("pid", "label")


@query(
    "preprocess",
    f"with {PTS}, v as (select row_number() over () as pid, x, y, z from (select avg(x) as x, avg(y) as y, avg(z) as z from pts group by floor(x / 0.05), floor(y / 0.05), floor(z / 0.05))), {_sor_sql(14, 2.7, 'v')} select {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')} from kept",
)
def preprocess(spark, sf):
    return filters.preprocess(pts(spark, sf), 0.05).select(*[rounded(c).alias(c) for c in "xyz"])


@query("overlap_ratio", f"with {SRC_TGT}, {knn_sql('src', 'tgt', 1)} select {r('avg((sqrt(d2) < 0.05)::int)', 'ratio')} from knn")
def overlap_ratio(spark, sf):
    s, t = two_scans(spark, sf)
    return neighbours.nn_join(s, t).agg(rounded(F.avg((F.sqrt("d2") < 0.05).cast("int"))).alias("ratio"))


@query("percentile_distance", f"with {SRC_TGT}, {knn_sql('src', 'tgt', 1)}, o as (select sqrt(d2) as d, row_number() over (order by d2) - 1 as k, count(*) over () as n from knn) select {r('d', 'd75', 9)} from o where k = floor(n * 0.75)")
def percentile_distance(spark, sf):
    s, t = two_scans(spark, sf)
    d = neighbours.nn_join(s, t).select(F.sqrt("d2").alias("d"))
    return stats.percentile_element(d, "d", 0.75, name="d75").select(rounded("d75", 9).alias("d75"))


@query(
    "voxel_nearest_seed",
    f"with {PTS}, v as (select floor(x / 0.05)::bigint as kx, floor(y / 0.05)::bigint as ky, floor(z / 0.05)::bigint as kz, min(pid) as pid, avg(x) as x, avg(y) as y, avg(z) as z from pts group by 1, 2, 3), "
    "s as (select min(pid) as pid, avg(x) as x, avg(y) as y, avg(z) as z from pts group by floor(x / 0.2), floor(y / 0.2), floor(z / 0.2)), "
    f"{knn_sql('s', 'v', 1)} select pid as seed, nbr_id as voxel, {r('d2', 'd2', 9)} from knn",
)
def voxel_nearest_seed(spark, sf):
    p = pts(spark, sf)
    first = lambda leaf: voxels.cells(p, leaf).groupBy("kx", "ky", "kz").agg(F.min("pid").alias("pid"), *[F.avg(c).alias(c) for c in "xyz"])
    return neighbours.nn_join(first(0.2), first(0.05)).select(F.col("pid").alias("seed"), F.col("nbr_id").alias("voxel"), _d2())


_NBR = f"{knn_sql('pts', 'pts', 45)}, nb as (select k.pid, b.x, b.y, b.z from knn k join pts b on b.pid = k.nbr_id)"


@query("knn_normals", f"with {PTS}, {_NBR}, {moments_sql('nb', 'pid')}, {eigen_sql('mom')}, {normal_sql('eig')} select pid, {r('nx', 'nx', 5)}, {r('ny', 'ny', 5)}, {r('nz', 'nz', 5)}, {r('l3', 'l3')} from nrm")
def knn_normals(spark, sf):
    return normals.point_normals(pts(spark, sf), 45).select("pid", *[rounded(f"n{c}", 5).alias(f"n{c}") for c in "xyz"], rounded("l3").alias("l3"))


@query(
    "oriented_normals",
    f"with {PTS}, {_NBR}, {moments_sql('nb', 'pid')}, {eigen_sql('mom')}, {normal_sql('eig')}, "
    "ob as (select k.pid, p.x, p.y, p.z from knn k join pts p on p.pid = k.nbr_id join nrm a on a.pid = k.pid join nrm b on b.pid = k.nbr_id where a.nx * b.nx + a.ny * b.ny + a.nz * b.nz >= 0), "
    f"{moments_sql('ob', 'pid', 'mom2')}, {eigen_sql('mom2', 'eig2')}, {normal_sql('eig2', 'nrm2')}, "
    "s as (select b.pid, b.n, b.nx * g as nx, b.ny * g as ny, b.nz * g as nz from (select n2.*, case when n2.nx * n1.nx + n2.ny * n1.ny + n2.nz * n1.nz < 0 then -1.0 else 1.0 end as g from nrm2 n2 join nrm n1 using (pid)) b) "
    f"select pid, n, {r('nx', 'nx', 5)}, {r('ny', 'ny', 5)}, {r('nz', 'nz', 5)} from s",
)
def oriented_normals(spark, sf):
    p = pts(spark, sf)
    return normals.oriented_normals(p, 45).select("pid", "n", *[rounded(f"n{c}", 5).alias(f"n{c}") for c in "xyz"])


def _once(sql: str, name: str) -> str:
    """The CTE of that name, used more than once, is computed once."""
    return sql.replace(f"{name} as (", f"{name} as materialized (")


@query(
    "neighbour_patch_metric",
    f"with {PTS}, {_once(_NBR, 'knn')}, {moments_sql('nb', 'pid')}, {eigen_sql('mom')}, {_once(normal_sql('eig'), 'nrm')}, e as (select k.pid, k.nbr_id, k.d2, 1 - abs(a.nx * b.nx + a.ny * b.ny + a.nz * b.nz) as t from knn k join nrm a on a.pid = k.pid join nrm b on b.pid = k.nbr_id where k.rank between 2 and 6) "
    f"select pid, nbr_id, {r('t + 0.4 * sqrt(d2) / 0.05', 'patch_metric', 5)}, {r('t + 0.5 * sqrt(d2) / 0.2', 'seed_metric', 5)} from e",
)
def neighbour_patch_metric(spark, sf):
    p = pts(spark, sf)
    near = storage.stored(neighbours.knn_join(p, p, 45), "near")
    n = storage.stored(normals.point_normals(p, 45, near), "normals")  # used twice
    a, b = ("x", "y", "z", "nx", "ny", "nz"), ("x", "y", "z", "nx", "ny", "nz")
    one = p.join(n, "pid").select("pid", *[F.col(c).alias("a" + c) for c in a])
    two = p.join(n, "pid").select(F.col("pid").alias("nbr_id"), *[F.col(c).alias("b" + c) for c in b])
    e = near.filter("rank between 2 and 6").join(one, "pid").join(two, "nbr_id")
    args = [g.vec("nx", "ny", "nz", prefix="a"), g.vec("nx", "ny", "nz", prefix="b"), g.vec(prefix="a"), g.vec(prefix="b")]
    return e.select("pid", "nbr_id", rounded(g.patch_metric(*args, 0.05), 5).alias("patch_metric"), rounded(g.voxel_seed_metric(*args, 0.2), 5).alias("seed_metric"))
