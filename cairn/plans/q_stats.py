"""Queries: means, order statistics, ranks, windows, moments and fits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import fits, normals, stats
from .registry import EV, LI, PTS, eigen_sql, ev, li, moments_sql, normal_sql, pts, query, r, rounded, table


def _element_sql(value: str, source: str, keys: str, rank: str, name: str) -> str:
    part = f"partition by {keys} " if keys else ""
    sel = f"{keys}, " if keys else ""
    over = f"over (partition by {keys})" if keys else "over ()"
    return f"select {sel}{value} as {name} from (select {sel}{value}, row_number() over ({part}order by {value}) - 1 as k, count(*) {over} as n from {source}) where k = {rank}"


@query("upper_median", f"with {EV} " + _element_sql("x", "ev", "event_type", "n // 2", "median"))
def upper_median(spark, sf):
    return stats.upper_median(ev(spark, sf), "x", ["event_type"])


@query("percentile_element", f"with {EV} " + _element_sql("x", "ev", "epoch", "floor(n * 0.75)", "value"))
def percentile_element(spark, sf):
    return stats.percentile_element(ev(spark, sf), "x", 0.75, ["epoch"])


@query("percentile_element_global", "with t as (select l_extendedprice as x from lineitem) " + _element_sql("x", "t", "", "floor(n * 0.75)", "value"))
def percentile_element_global(spark, sf):
    return stats.percentile_element(table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("x")), "x", 0.75)


@query("mad", f"with {EV}, m as ({_element_sql('x', 'ev', 'event_type', 'n // 2', 'm')}), d as (select event_type, abs(x - m) as d from ev join m using (event_type)) select event_type, {r('mad', 'mad')} from ({_element_sql('d', 'd', 'event_type', 'n // 2', 'mad')})")
def mad(spark, sf):
    return stats.median_absolute_deviation(ev(spark, sf), "x", ["event_type"]).select("event_type", rounded("mad").alias("mad"))


@query("mad_global", f"with {EV}, m as ({_element_sql('x', 'ev', '', 'n // 2', 'm')}), d as (select abs(x - m) as d from ev, m) select {r('mad', 'mad')} from ({_element_sql('d', 'd', '', 'n // 2', 'mad')})")
def mad_global(spark, sf):
    return stats.median_absolute_deviation(ev(spark, sf), "x").select(rounded("mad").alias("mad"))


_MEANS = ("arithmetic", "geometric", "harmonic", "contraharmonic", "square", "root_square")


@query(
    "means_all",
    "with t as (select o_orderpriority as k, o_totalprice / 1000 as x from orders) select k, " + ", ".join(r(e, f"{n}_mean", 5) for n, e in zip(_MEANS, ("avg(x)", "exp(avg(ln(x)))", "count(x) / sum(1 / x)", "sum(x * x) / sum(x)", "avg(x * x)", "sqrt(avg(x * x))"), strict=True)) + " from t group by k",
)
def means_all(spark, sf):
    t = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("k"), (F.col("o_totalprice") / 1000).alias("x"))
    return t.groupBy("k").agg(*[rounded(stats.mean_of(n, F.col("x")), 5).alias(f"{n}_mean") for n in _MEANS])


@query("rmsd", f"with {LI} select l_returnflag, {r('sqrt(avg((x - y) * (x - y)))', 'rmsd', 5)} from li group by 1")
def rmsd(spark, sf):
    d = F.col("x") - F.col("y")
    return li(spark, sf).groupBy("l_returnflag").agg(rounded(F.sqrt(F.avg(d * d)), 5).alias("rmsd"))


@query("covariance_pop", f"with {LI} select l_returnflag, l_linestatus, {r('covar_pop(x, y)', 'cxy', 4)}, {r('covar_pop(y, z)', 'cyz', 4)} from li group by 1, 2")
def covariance_pop(spark, sf):
    return li(spark, sf).groupBy("l_returnflag", "l_linestatus").agg(rounded(F.covar_pop("x", "y"), 4).alias("cxy"), rounded(F.covar_pop("y", "z"), 4).alias("cyz"))


@query("stddev_population", f"with {EV} select event_type, {r('stddev_pop(x)', 'sd')} from ev group by 1")
def stddev_population(spark, sf):
    return ev(spark, sf).groupBy("event_type").agg(rounded(F.stddev_pop("x")).alias("sd"))


def _ranked(spark, sf):
    return stats.ranks(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), "p_size", "p_partkey", ["p_brand"])


@query("rank_competition", "select p_partkey, rank() over (partition by p_brand order by p_size) - 1 as competition from part")
def rank_competition(spark, sf):
    return _ranked(spark, sf).select("p_partkey", "competition")


@query("rank_dense", "select p_partkey, dense_rank() over (partition by p_brand order by p_size) - 1 as dense from part")
def rank_dense(spark, sf):
    return _ranked(spark, sf).select("p_partkey", "dense")


@query("rank_ordinal", "select p_partkey, row_number() over (partition by p_brand order by p_size, p_partkey) - 1 as ordinal from part")
def rank_ordinal(spark, sf):
    return _ranked(spark, sf).select("p_partkey", "ordinal")


@query("rank_fractional", "select p_partkey, rank() over (partition by p_brand order by p_size) - 1 + (count(*) over (partition by p_brand, p_size) - 1) / 2.0 as fractional from part")
def rank_fractional(spark, sf):
    return _ranked(spark, sf).select("p_partkey", F.col("fractional").cast("double").alias("fractional"))


_DAYS = f"{EV}, days as (select epoch, avg(x) as m from ev group by epoch)"


def _days(spark, sf):
    return ev(spark, sf).groupBy("epoch").agg(F.avg("x").alias("m"))


# the windows below run over one row per epoch


@query("lag_ratio", f"with {_DAYS}, l as (select epoch, lag(m, 1) over (order by epoch) as b1, lag(m, 2) over (order by epoch) as b2 from days) select epoch, {r('abs(b1 / nullif(b2, 0))', 'alpha', 5)} from l")
def lag_ratio(spark, sf):
    w = Window.orderBy("epoch")
    d = _days(spark, sf).select("epoch", F.lag("m", 1).over(w).alias("b1"), F.lag("m", 2).over(w).alias("b2"))
    return d.select("epoch", rounded(F.abs(F.try_divide("b1", "b2")), 5).alias("alpha"))


@query("running_min_threshold", f"with {_DAYS} select epoch, {r('min(m) over (order by epoch rows unbounded preceding)', 'threshold', 5)} from days")
def running_min_threshold(spark, sf):
    w = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    return _days(spark, sf).select("epoch", rounded(F.min("m").over(w), 5).alias("threshold"))


@query("fixed_interval_pairs", f"with {_DAYS}, s as (select row_number() over (order by epoch) - 1 as scan_idx, epoch from days), f as (select min(scan_idx) as z from s) select scan_idx, case when scan_idx - 3 > 0 then scan_idx - 3 else 0 end as tgt_idx from s where scan_idx > 0")
def fixed_interval_pairs(spark, sf):
    w = Window.orderBy("epoch")
    s = _days(spark, sf).select((F.row_number().over(w) - 1).alias("scan_idx"))
    return s.select("scan_idx", F.coalesce(F.lag("scan_idx", 3).over(Window.orderBy("scan_idx")), F.lit(0)).alias("tgt_idx")).filter("scan_idx > 0")


def _groups(spark, sf):
    return pts(spark, sf)


_EIG = f"with {PTS}, {moments_sql('pts', 'label')}, {eigen_sql('mom')}"


@query("pca3d_eigenvalues", f"{_EIG} select label, n, {r('l1 * n', 's1', 5)}, {r('l2 * n', 's2', 5)}, {r('l3 * n', 's3', 5)} from eig")
def pca3d_eigenvalues(spark, sf):
    """Of the scatter matrix, which is not divided by n."""
    m = normals.with_eigenvalues(normals.moments(pts(spark, sf), ["label"]))
    return m.select("label", "n", *[rounded(F.col(f"l{i}") * F.col("n"), 5).alias(f"s{i}") for i in (1, 2, 3)])


@query("pca3d_axes", f"{_EIG}, {normal_sql('eig')} select label, {r('nx', 'nx', 5)}, {r('ny', 'ny', 5)}, {r('nz', 'nz', 5)} from nrm")
def pca3d_axes(spark, sf):
    return normals.planes(pts(spark, sf), ["label"]).select("label", *[rounded(f"n{c}", 5).alias(f"n{c}") for c in "xyz"])


_W = f"with {PTS}, w as (select *, 1 + abs(x) as w from pts)"
_WM = (
    "s as (select label, count(*) as n, sum(w) as w, "
    + ", ".join(f"sum(w * {c}) as s{c}" for c in "xyz")
    + ", "
    + ", ".join(f"sum(w * {k[0]} * {k[1]}) as s{k}" for k in normals.COVARIANCE)
    + " from w group by label), mom as (select label, n, w, "
    + ", ".join(f"s{k} / w - (s{k[0]} / w) * (s{k[1]} / w) as {k}" for k in normals.COVARIANCE)
    + " from s)"
)


@query("weighted_pca3d", f"{_W}, {_WM}, {eigen_sql('mom')} select label, {r('l1', 'l1', 6)}, {r('l2', 'l2', 6)}, {r('l3', 'l3', 6)} from eig")
def weighted_pca3d(spark, sf):
    p = pts(spark, sf).withColumn("w", 1 + F.abs("x"))
    return normals.with_eigenvalues(normals.weighted_moments(p, "w", ["label"])).select("label", *[rounded(f"l{i}").alias(f"l{i}") for i in (1, 2, 3)])


_TWO = "(a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b)", "(a + c) / 2 - sqrt(((a - c) / 2) * ((a - c) / 2) + b * b)"
_M2 = f"with {PTS}, m as (select label, count(*) as n, covar_pop(x, x) as a, covar_pop(x, y) as b, covar_pop(y, y) as c from pts group by label)"


def _m2(spark, sf):
    return pts(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("x", "x").alias("a"), F.covar_pop("x", "y").alias("b"), F.covar_pop("y", "y").alias("c"))


@query("pca2d", f"{_M2} select label, {r(f'({_TWO[0]}) * n', 's1', 5)}, {r(f'({_TWO[1]}) * n', 's2', 5)} from m")
def pca2d(spark, sf):
    high, low = g.eigenvalues2(F.col("a"), F.col("b"), F.col("c"))
    return _m2(spark, sf).select("label", rounded(high * F.col("n"), 5).alias("s1"), rounded(low * F.col("n"), 5).alias("s2"))


@query("fit_line2d_quality", f"{_M2} select label, {r(f'({_TWO[1]}) / ({_TWO[0]})', 'quality', 5)} from m")
def fit_line2d_quality(spark, sf):
    high, low = g.eigenvalues2(F.col("a"), F.col("b"), F.col("c"))
    return _m2(spark, sf).select("label", rounded(normals.quality(low, high), 5).alias("quality"))


@query("fit_line3d_quality", f"{_EIG} select label, {r('l2 / l1', 'quality', 5)} from eig")
def fit_line3d_quality(spark, sf):
    m = normals.with_eigenvalues(normals.moments(pts(spark, sf), ["label"]))
    return m.select("label", rounded(normals.quality(F.col("l2"), F.col("l1")), 5).alias("quality"))


@query("fit_plane_quality", f"{_EIG} select label, {r('l3 / l2', 'quality', 5)} from eig")
def fit_plane_quality(spark, sf):
    m = normals.with_eigenvalues(normals.moments(pts(spark, sf), ["label"]))
    return m.select("label", rounded(normals.quality(F.col("l3"), F.col("l2")), 5).alias("quality"))


_AXIS = normal_sql("(select * replace (l1 as l3) from eig)", "axs")


@query(
    "fit_segment3d",
    f"{_EIG}, {_AXIS}, t as (select p.label, (x - cx) * nx + (y - cy) * ny + (z - cz) * nz as t, cx, cy, cz, nx, ny, nz from pts p join axs using (label)) select label, "
    + ", ".join(f"{r(f'any_value(c{c}) + min(t) * any_value(n{c})', f'a{c}', 4)}, {r(f'any_value(c{c}) + max(t) * any_value(n{c})', f'b{c}', 4)}" for c in "xyz")
    + " from t group by label",
)
def fit_segment3d(spark, sf):
    p = pts(spark, sf)
    m = normals.with_axis(normals.with_eigenvalues(normals.moments(p, ["label"])))
    t = p.join(m, "label").withColumn("t", g.dot(g.sub(g.vec(), g.vec("cx", "cy", "cz")), g.vec("ax", "ay", "az")))
    e = t.groupBy("label").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).join(m, "label")
    return e.select("label", *[rounded(F.col(f"c{c}") + F.col(k) * F.col(f"a{c}"), 4).alias(f"{n}{c}") for c in "xyz" for n, k in (("a", "lo"), ("b", "hi"))])


def _weighted(spark, sf):
    return pts(spark, sf).withColumn("w", 1 + F.abs("x"))


_W2 = (
    f"{_W}, c as (select label, count(*) as n, sum(w) as sw, sum(w * x) / sum(w) as cx, sum(w * y) / sum(w) as cy from w group by label), "
    "m as (select label, any_value(n) as n, any_value(cx) as cx, any_value(cy) as cy, sum(w * (x - cx) * (x - cx)) / any_value(sw) as a, sum(w * (x - cx) * (y - cy)) / any_value(sw) as b, sum(w * (y - cy) * (y - cy)) / any_value(sw) as c from w join c using (label) group by label)"
)
_P2 = f"with {PTS}, m as (select label, count(*) as n, avg(x) as cx, avg(y) as cy, covar_pop(x, x) as a, covar_pop(x, y) as b, covar_pop(y, y) as c from pts group by label)"
_LINE2 = f"l as (select *, cos(atan2(2 * b, a - c) / 2) as dx, sin(atan2(2 * b, a - c) / 2) as dy, ({_TWO[1]}) / ({_TWO[0]}) as q from m)"
_SEG2 = (
    f"{_LINE2}, t as (select p.label, cx, cy, dx, dy, q, (x - cx) * dx + (y - cy) * dy as t from pts p join l using (label)) select label, "
    + ", ".join(r(f"any_value(c{c}) + {f}(t) * any_value(d{c})", n + c, 5) for n, f in (("a", "min"), ("b", "max")) for c in "xy")
    + f", {r('any_value(q)', 'quality', 5)} from t group by label"
)


def _ends(df):
    return df.select("label", *[rounded(c, 5).alias(c) for c in ("ax", "ay", "bx", "by", "quality")])


@query("weighted_pca2d", f"{_W2} select label, {r(_TWO[0], 'l1')}, {r(_TWO[1], 'l2')} from m")
def weighted_pca2d(spark, sf):
    return fits.lines2(_weighted(spark, sf), ["label"], "w").select("label", *[rounded(c).alias(c) for c in ("l1", "l2")])


@query("fit_weighted_line2d", f"{_W2}, {_LINE2} select label, {r('cx', 'cx')}, {r('cy', 'cy')}, {r('abs(dx)', 'dx', 5)}, {r('abs(dy)', 'dy', 5)}, {r('q', 'quality', 5)} from l")
def fit_weighted_line2d(spark, sf):
    l = fits.lines2(_weighted(spark, sf), ["label"], "w")  # noqa: E741
    return l.select("label", *[rounded(c).alias(c) for c in ("cx", "cy")], *[rounded(F.abs(c), 5).alias(c) for c in ("dx", "dy")], rounded("quality", 5).alias("quality"))


@query("fit_segment2d", f"{_P2}, {_SEG2}")
def fit_segment2d(spark, sf):
    return _ends(fits.segments2(pts(spark, sf), ["label"]))


@query("fit_weighted_segment2d", f"{_W2}, {_SEG2}")
def fit_weighted_segment2d(spark, sf):
    return _ends(fits.segments2(_weighted(spark, sf), ["label"], "w"))


@query("fit_weighted_plane", f"{_W}, {_WM}, {eigen_sql('mom')}, {normal_sql('eig')} select label, {', '.join(r(f'n{c}', f'n{c}', 5) for c in 'xyz')}, {r('l3 / l2', 'quality', 5)} from nrm")
def fit_weighted_plane(spark, sf):
    """The weighted normals, and how flat the groups are."""
    return fits.planes3(_weighted(spark, sf), ["label"], "w").select("label", *[rounded(c, 5).alias(c) for c in ("nx", "ny", "nz", "quality")])
