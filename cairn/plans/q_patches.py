"""Queries: planar patches, their classification and the alignment's normal equations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment, classify, neighbours, normals, patches
from . import storage
from .registry import PTS, SRC_TGT, eigen_sql, two_scans, knn_sql, moments_sql, normal_sql, pts, query, r, rounded

_EIG = f"with {PTS}, {moments_sql('pts', 'label')}, {eigen_sql('mom')}"


@query("patch_features", f"{_EIG} select label, {r('l3 / (l1 + l2 + l3)', 'variation')}, {r('(l2 - l3) / l1', 'planarity', 5)}, {r('(l1 - l2) / l1', 'linearity', 5)} from eig")
def patch_features(spark, sf):
    f = patches.features(pts(spark, sf), ["label"])
    return f.select("label", rounded("variation").alias("variation"), rounded("planarity", 5).alias("planarity"), rounded("linearity", 5).alias("linearity"))


_REF = f"{_EIG}, {normal_sql('eig')}, d as (select p.*, abs((x - cx) * nx + (y - cy) * ny + (z - cz) * nz) as d from pts p join nrm using (label)), l as (select label, 2.0 * sqrt(avg(d * d)) as lim from d group by label), ref as (select d.* from d join l using (label) where d < lim)"


@query("patch_refine", f"{_REF} select pid, label from ref")
def patch_refine(spark, sf):
    return patches.refined(pts(spark, sf), ["label"]).select("pid", "label")


@query("patch_size_filter", f"with {PTS} select pid, label from pts where label in (select label from pts where x > 0 group by label having count(*) >= 25)")
def patch_size_filter(spark, sf):
    p = pts(spark, sf)
    return p.join(patches.enough(p.filter("x > 0"), ["label"], 25).select("label").distinct(), "label", "left_semi").select("pid", "label")


@query("patch_select", f"{_EIG} select label from eig where n >= 20 and not (l3 / (l1 + l2 + l3) > 0.25 or (l2 - l3) / l1 < 0.15)")
def patch_select(spark, sf):
    return patches.selected(pts(spark, sf), ["label"], most_variation=0.25, least_planarity=0.15)


@query("patch_std", f"{_EIG} select label, {r('sqrt(n * greatest(l3, 0) / (n - 1))', 'std_bp')}, {r('sqrt(n * greatest(l3, 0) / (n - 1)) / n', 'std_ct')} from eig")
def patch_std(spark, sf):
    return patches.table(pts(spark, sf), ["label"]).select("label", rounded("std_bp").alias("std_bp"), rounded("std_ct").alias("std_ct"))


def _ends(c: str, f: str) -> str:
    return f"arg_max(pid, ({c}, -pid))" if f == "max" else f"arg_min(pid, ({c}, pid))"


@query(
    "patch_boundary_points",
    f"with {PTS}, e as (select label, " + ", ".join(f"{_ends(c, f)} as i{k}" for k, (c, f) in enumerate(patches._EXTREMES)) + " from pts group by label), "
    "u as (" + " union all ".join(f"select label, {k} as k, i{k} as pid from e" for k in range(6)) + f") select u.label, u.k, {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')} from u join pts using (pid)",
)
def patch_boundary_points(spark, sf):
    t = patches.table(pts(spark, sf), ["label"]).select("label", F.posexplode("bp").alias("k", "p"))
    return t.select("label", "k", *[rounded(F.col(f"p.{c}")).alias(c) for c in "xyz"])


def _two(spark, sf):
    s, t = two_scans(spark, sf)
    return storage.stored(patches.table(s, ["label"]), "source"), storage.stored(patches.table(t, ["label"]), "target")


def _patch_sql(source: str, n: str) -> str:
    return f"{moments_sql(source, 'label', n + 'm')}, {eigen_sql(n + 'm', n + 'e')}, {normal_sql(n + 'e', n + 'n')}, {n}p as (select label, label as pid, n, cx as x, cy as y, cz as z, nx, ny, nz, sqrt(n * greatest(l3, 0) / (n - 1)) as sb, sqrt(n * greatest(l3, 0) / (n - 1)) / n as sc from {n}n)"


_TWO = f"with {SRC_TGT}, {_patch_sql('src', 's')}, {_patch_sql('tgt', 't')}, {knn_sql('sp', 'tp', 1, 'true', 'ct')}, m as (select s.*, t.label as t_label, t.x as tx, t.y as ty, t.z as tz, t.nx as tnx, t.ny as tny, t.nz as tnz, t.sc as tsc, d2, least(greatest(1.96 * sqrt(t.sc * t.sc + s.sb * s.sb), 0.0), 1e9) as raw from sp s join ct on ct.pid = s.pid join tp t on t.pid = ct.nbr_id), lo as (select *, greatest(least(raw, 0.2), 0.1) as lod from m)"


@query("lod_clamp", f"{_TWO} select label, t_label, {r('lod', 'lod')} from lo")
def lod_clamp(spark, sf):
    s, t = _two(spark, sf)
    m = classify.matched(s, t, "label")
    return m.select("label", "t_label", rounded(classify.lod(F.col("t_std_ct"), F.col("std_bp"), 0.1)).alias("lod"))


_CLS = (
    f"{_TWO}, e as (select label, " + ", ".join(f"{_ends(c, f)} as i{k}" for k, (c, f) in enumerate(patches._EXTREMES)) + " from src group by label), "
    "u as (" + " union all ".join(f"select label, label * 8 + {k} as pid, i{k} as p from e" for k in range(6)) + "), bp as (select u.label, u.pid, x, y, z from u join pts on pts.pid = u.p), "
    + knn_sql("bp", "tp", 1, "true", "bn")
    + ", bd as (select b.label, max(abs((b.x - t.x) * t.nx + (b.y - t.y) * t.ny + (b.z - t.z) * t.nz)) as bp_plane from bp b join bn on bn.pid = b.pid join tp t on t.pid = bn.nbr_id group by b.label), "
    "cl as (select lo.label, t_label, lod, abs((x - tx) * tnx + (y - ty) * tny + (z - tz) * tnz) as ct_plane, bp_plane, sqrt(d2) as ct_point, greatest(0.3, lod) as thr from lo join bd using (label)), "
    "st as (select *, ct_plane <= thr and bp_plane <= thr and ct_point < 0.3 + 0.01 as stable from cl)"
)


@query("stable_classification", f"{_CLS} select label, t_label, {r('lod', 'lod')}, {r('ct_plane', 'ct_plane', 5)}, {r('bp_plane', 'bp_plane', 5)}, {r('ct_point', 'ct_point')}, stable from st")
def stable_classification(spark, sf):
    s, t = _two(spark, sf)
    c = classify.classified(s, t, "label", 0.3, 0.1, 0.01)
    return c.select("label", "t_label", rounded("lod").alias("lod"), rounded("ct_plane", 5).alias("ct_plane"), rounded("bp_plane", 5).alias("bp_plane"), rounded("ct_point").alias("ct_point"), "stable")


@query("stable_ratio", f"{_CLS} select {r('sum(case when stable then n else 0 end) / sum(n)', 'ratio')}, {r('min(lod)', 'lod_min')}, {r('max(lod)', 'lod_max')} from st join (select label, count(*) as n from src group by label) using (label)")
def stable_ratio(spark, sf):
    s, t = _two(spark, sf)
    c = classify.classified(s, t, "label", 0.3, 0.1, 0.01).join(s.select("label", "n"), "label")
    return c.agg(rounded(F.try_divide(F.sum(F.when(F.col("stable"), F.col("n")).otherwise(0)).cast("double"), F.sum("n").cast("double"))).alias("ratio"), rounded(F.min("lod")).alias("lod_min"), rounded(F.max("lod")).alias("lod_max"))


def _pairs(spark, sf):
    """Source points with the nearest target point and the normal of its patch."""
    s, t = two_scans(spark, sf)
    plane = normals.planes(t, ["label"]).select("label", "nx", "ny", "nz")
    target = t.join(plane, "label").select(F.col("pid").alias("nbr_id"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), "nx", "ny", "nz")
    near = neighbours.nn_join(s, t).join(s.select("pid", F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("z").alias("qz")), "pid")
    return near.join(target, "nbr_id")


_ROW = ["q.y * nz - q.z * ny", "q.z * nx - q.x * nz", "q.x * ny - q.y * nx", "nx", "ny", "nz"]
_L = "nx * (p.x - q.x) + ny * (p.y - q.y) + nz * (p.z - q.z)"


@query(
    "normal_equations",
    f"with {SRC_TGT}, {moments_sql('tgt', 'label')}, {eigen_sql('mom')}, {normal_sql('eig')}, {knn_sql('src', 'tgt', 1)}, e as (select " + ", ".join(f"{e} as r{i}" for i, e in enumerate(_ROW)) + f", {_L} as l from knn k join src q on q.pid = k.pid join tgt p on p.pid = k.nbr_id join nrm n on n.label = p.label) select "
    + ", ".join([r(f"sum(r{i} * r{j})", f"a{i}{j}", 4) for i in range(6) for j in range(i, 6)] + [r(f"sum(r{i} * l)", f"b{i}", 4) for i in range(6)] + [r("sum(l * l)", "ll", 4)]) + ", count(*) as n from e",
)
def normal_equations(spark, sf):
    s = classify.normal_sums(_pairs(spark, sf))
    return s.select(*[rounded(c, 4).alias(c) for c in s.columns if c != "n"], "n")


@query("pose_vcm")
def pose_vcm(spark, sf):
    """The covariance of the six pose parameters, row by row."""
    return alignment.vcm_table(spark, classify.normal_sums(_pairs(spark, sf)))
