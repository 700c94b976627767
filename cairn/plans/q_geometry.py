"""Queries: distances, projections, angles, shapes, bits, colours, vectors of any length, matrices."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import equality
from ..functions import geometry as g
from ..functions import metrics as m
from ..operators import matrices
from .registry import LI, PTS, VECS, li, pts, query, r, rounded, table, vecs

_O, _N = (0.05, -0.02, 0.01), (0.3, -0.5, 0.8)
_V = lambda t: tuple(F.lit(x) for x in t)
_DOT = lambda a, b: " + ".join(f"({p}) * ({q})" for p, q in zip(a, b, strict=True))
_SUB = lambda a, b: tuple(f"({p}) - ({q})" for p, q in zip(a, b, strict=True))
_P = ("x", "y", "z")
_PO = _SUB(_P, _O)
_NN = math.fsum(x * x for x in _N)


def _cross(a, b):
    return (f"({a[1]}) * ({b[2]}) - ({a[2]}) * ({b[1]})", f"({a[2]}) * ({b[0]}) - ({a[0]}) * ({b[2]})", f"({a[0]}) * ({b[1]}) - ({a[1]}) * ({b[0]})")


@query("dist_plane", f"with {PTS} select pid, {r(f'abs({_DOT(_PO, _N)}) / sqrt({_DOT(_N, _N)})', 'd')} from pts")
def dist_plane(spark, sf):
    return pts(spark, sf).select("pid", rounded(g.plane_distance(g.vec(), _V(_O), _V(_N))).alias("d"))


_C = _cross(_PO, _N)


@query("dist_line", f"with {PTS} select pid, {r(f'sqrt({_DOT(_C, _C)}) / sqrt({_DOT(_N, _N)})', 'd')} from pts")
def dist_line(spark, sf):
    return pts(spark, sf).select("pid", rounded(g.line_distance(g.vec(), _V(_O), _V(_N))).alias("d"))


_B = tuple(o + n for o, n in zip(_O, _N, strict=True))
_BD = tuple(b - o for b, o in zip(_B, _O, strict=True))
_Q = tuple(f"x{i}" for i in range(3))


@query(
    "dist_segment",
    f"with {PTS}, t as (select *, least(greatest(({_DOT(_PO, _BD)}) / ({_DOT(_BD, _BD)}), 0), 1) as t from pts) select pid, "
    + r("sqrt(" + " + ".join(f"({c} - ({o} + {d} * t)) * ({c} - ({o} + {d} * t))" for c, o, d in zip(_P, _O, _BD, strict=True)) + ")", "d")
    + " from t",
)
def dist_segment(spark, sf):
    return pts(spark, sf).select("pid", rounded(g.segment_distance(g.vec(), _V(_O), _V(_B))).alias("d"))


@query("dist_points", f"with {PTS} select a.pid, {r('sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))', 'd')}, {r('(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)', 'd2')} from pts a join pts b on b.pid = a.pid + 1")
def dist_points(spark, sf):
    a, b = _next(spark, sf)
    return a.select("pid", rounded(g.distance(g.vec(), b)).alias("d"), rounded(g.squared_distance(g.vec(), b)).alias("d2"))


def _next(spark, sf):
    """Each point with the point of the next number."""
    p = pts(spark, sf)
    q = p.select((F.col("pid") - 1).alias("pid"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    return p.join(q, "pid"), g.vec("bx", "by", "bz")


@query("project_line", f"with {PTS}, t as (select *, ({_DOT(_PO, _N)}) / ({_DOT(_N, _N)}) as t from pts) select pid, {', '.join(r(f'{o} + {n} * t', c) for c, o, n in zip(_P, _O, _N, strict=True))} from t")
def project_line(spark, sf):
    q = g.project_on_line(g.vec(), _V(_O), _V(_N))
    return pts(spark, sf).select("pid", *[rounded(v).alias(c) for v, c in zip(q, "xyz", strict=True)])


@query("project_plane", f"with {PTS}, t as (select *, ({_DOT(_PO, _N)}) / ({_DOT(_N, _N)}) as t from pts) select pid, {', '.join(r(f'{c} - {n} * t', c) for c, n in zip(_P, _N, strict=True))} from t")
def project_plane(spark, sf):
    q = g.project_on_plane(g.vec(), _V(_O), _V(_N))
    return pts(spark, sf).select("pid", *[rounded(v).alias(c) for v, c in zip(q, "xyz", strict=True)])


@query(
    "project_sphere",
    f"with {PTS}, t as (select *, sqrt({_DOT(_PO, _PO)}) as n from pts) select pid, " + ", ".join(r(f"{o} + case when n = 0 then {u} else ({c} - {o}) / n end * 0.5", c) for c, o, u in zip(_P, _O, (0.0, 0.0, 1.0), strict=True)) + " from t",
)
def project_sphere(spark, sf):
    q = g.project_on_sphere(g.vec(), _V(_O), 0.5)
    return pts(spark, sf).select("pid", *[rounded(v).alias(c) for v, c in zip(q, "xyz", strict=True)])


@query(
    "vector_algebra",
    f"with {PTS} select a.pid, {r('a.x * b.x + a.y * b.y + a.z * b.z', 'dot')}, {r('a.y * b.z - a.z * b.y', 'cx')}, {r('a.z * b.x - a.x * b.z', 'cy')}, {r('a.x * b.y - a.y * b.x', 'cz')}, "
    f"{r('sqrt(a.x * a.x + a.y * a.y + a.z * a.z)', 'norm')}, {r('greatest(abs(a.x), abs(a.y), abs(a.z))', 'max_norm')}, {r('a.x + b.x * 2.5', 'sx')} from pts a join pts b on b.pid = a.pid + 1",
)
def vector_algebra(spark, sf):
    a, b = _next(spark, sf)
    v = g.vec()
    c = g.cross(v, b)
    return a.select("pid", rounded(g.dot(v, b)).alias("dot"), *[rounded(q).alias(n) for q, n in zip(c, ("cx", "cy", "cz"), strict=True)], rounded(g.norm(v)).alias("norm"), rounded(g.max_norm(v)).alias("max_norm"), rounded(g.add(v, g.scale(b, 2.5))[0]).alias("sx"))


@query(
    "angles",
    f"with {PTS}, t as (select a.pid, a.x, a.y, atan2(a.y, a.x) as t, a.x * b.x + a.y * b.y + a.z * b.z as d, sqrt(a.x * a.x + a.y * a.y + a.z * a.z) * sqrt(b.x * b.x + b.y * b.y + b.z * b.z) as n from pts a join pts b on b.pid = a.pid + 1) "
    f"select pid, {r('case when t < 0 then t + 2 * pi() else t end', 'angle')}, {r('degrees(t)', 'degrees')}, {r('t * 200 / pi()', 'gon', 5)}, {r('case when n = 0 then 0 else acos(greatest(least(d / n, 1), -1)) end', 'inner_angle')} from t",
)
def angles(spark, sf):
    a, b = _next(spark, sf)
    t = F.atan2("y", "x")
    return a.select("pid", rounded(g.angle_2d(g.vec("x", "y"))).alias("angle"), rounded(F.degrees(t)).alias("degrees"), rounded(t * 200 / math.pi, 5).alias("gon"), rounded(g.angle_between(g.vec(), b)).alias("inner_angle"))


# three points of successive numbers; e stands for the second, since its y would be a keyword
_TRI = f"with {PTS}, t as (select a.pid, a.x as ax, a.y as ay, a.z as az, b.x as ex, b.y as ey, b.z as ez, c.x as cx, c.y as cy, c.z as cz from pts a join pts b on b.pid = a.pid + 1 join pts c on c.pid = a.pid + 2)"


def _triangles(spark, sf):
    p = pts(spark, sf).drop("label")
    for i, n in enumerate("bc"):
        p = p.join(pts(spark, sf).select((F.col("pid") - 1 - i).alias("pid"), *[F.col(c).alias(n + c) for c in "xyz"]), "pid")
    return p.withColumns({f"a{c}": F.col(c) for c in "xyz"})


@query(
    "circumcenter",
    f"{_TRI}, d as (select *, 2 * (ax * (ey - cy) + ex * (cy - ay) + cx * (ay - ey)) as d, ax*ax+ay*ay as p, ex*ex+ey*ey as q, cx*cx+cy*cy as w from t where abs((ex - ax) * (cy - ay) - (ey - ay) * (cx - ax)) > 0.001) "
    f"select pid, {r('(p * (ey - cy) + q * (cy - ay) + w * (ay - ey)) / d', 'ux', 5)}, {r('(p * (cx - ex) + q * (ax - cx) + w * (ex - ax)) / d', 'uy', 5)} from d",
)
def circumcenter(spark, sf):
    a, b, c = (g.vec("x", "y", prefix=n) for n in "abc")
    ux, uy = g.circumcentre(a, b, c)
    t = _triangles(spark, sf).filter(F.abs(g.cross2(g.sub(b, a), g.sub(c, a))) > 0.001)
    return t.select("pid", rounded(ux, 5).alias("ux"), rounded(uy, 5).alias("uy"))


_X = _cross(("ex - ax", "ey - ay", "ez - az"), ("cx - ax", "cy - ay", "cz - az"))


@query("shapes_area", f"{_TRI} select pid, {r(f'abs({_X[2]}) / 2', 'area2')}, {r(f'sqrt({_DOT(_X, _X)}) / 2', 'area3')}, {r('pi() * (ex - ax) * (ex - ax)', 'disc')}, {r('4 * pi() * abs(ex - ax) ** 3 / 3', 'ball')} from t")
def shapes_area(spark, sf):
    a2, b2, c2 = (g.vec("x", "y", prefix=n) for n in "abc")
    a3, b3, c3 = (g.vec("x", "y", "z", prefix=n) for n in "abc")
    rad = F.col("bx") - F.col("ax")
    return _triangles(spark, sf).select("pid", rounded(g.triangle_area_2d(a2, b2, c2)).alias("area2"), rounded(g.triangle_area_3d(a3, b3, c3)).alias("area3"), rounded(math.pi * rad * rad).alias("disc"), rounded(4 * math.pi * F.pow(F.abs(rad), F.lit(3.0)) / 3).alias("ball"))


@query(
    "plane_from_points",
    f"{_TRI}, n as (select pid, {_X[0]} as nx, {_X[1]} as ny, {_X[2]} as nz, least((ax, ay, az), (ex, ey, ez)) as first_end, sqrt((ex-ax)*(ex-ax)+(ey-ay)*(ey-ay)+(ez-az)*(ez-az)) as length from t) select pid, {r('nx', 'nx')}, {r('ny', 'ny')}, {r('nz', 'nz')}, {r('first_end[1]', 'first_x')}, {r('length', 'length')} from n",
)
def plane_from_points(spark, sf):
    """The normal of three points, and the segment of the first two with its ends in lexicographic order."""
    a, b, c = (g.vec("x", "y", "z", prefix=n) for n in "abc")
    n = g.cross(g.sub(b, a), g.sub(c, a))
    first = F.least(F.struct(*a), F.struct(*[q.alias(k) for q, k in zip(b, ("ax", "ay", "az"), strict=True)]))
    return _triangles(spark, sf).select("pid", *[rounded(q).alias(k) for q, k in zip(n, ("nx", "ny", "nz"), strict=True)], rounded(first["ax"]).alias("first_x"), rounded(g.distance(a, b)).alias("length"))


_RING = f"with {PTS}, c as (select label, avg(x) as cx, avg(y) as cy from pts group by label), o as (select p.label, p.x, p.y, atan2(y - cy, x - cx) as t, pid from pts p join c using (label)), n as (select label, x, y, coalesce(lead(x) over w, first_value(x) over w) as qx, coalesce(lead(y) over w, first_value(y) over w) as qy from o window w as (partition by label order by t, pid))"


@query("polygon_area", f"{_RING} select label, {r('abs(sum(x * qy - y * qx)) / 2', 'area')}, sum(x * qy - y * qx) > 0 as counterclockwise from n group by label")
def polygon_area(spark, sf):
    """Of each label's points in the order of their direction from the centroid."""
    p = pts(spark, sf)
    c = p.groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    w = Window.partitionBy("label").orderBy("t", "pid")
    o = p.join(c, "label").withColumn("t", F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")))
    n = o.select("label", "x", "y", *[F.coalesce(F.lead(k).over(w), F.first(k).over(w)).alias("q" + k) for k in "xy"])
    s = F.sum(F.col("x") * F.col("qy") - F.col("y") * F.col("qx"))
    return n.groupBy("label").agg(rounded(F.abs(s) / 2).alias("area"), (s > 0).alias("counterclockwise"))


@query(
    "polygon_clean",
    f"with {PTS}, q as (select label, pid, round(x, 1) as x, round(y, 1) as y from pts), k as (select *, lag((x, y)) over (partition by label order by pid) as p, first_value((x, y)) over (partition by label order by pid) as f, lead(pid) over (partition by label order by pid) as nxt from q), "
    "d as (select label, pid, x, y, f from k where p is null or p <> (x, y)), e as (select *, row_number() over (partition by label order by pid desc) as back, count(*) over (partition by label) as n from d), "
    "c as (select label, pid, x, y from e where not (back = 1 and n > 1 and (x, y) = f)), s as (select *, count(*) over (partition by label) as m from c) select label, pid, x + 0.0 as x, y + 0.0 as y from s where m >= 3",
)
def polygon_clean(spark, sf):
    """Rings without consecutive repeats and without a closing vertex; under three vertices nothing."""
    q = pts(spark, sf).select("label", "pid", *[rounded(c, 1).alias(c) for c in "xy"])
    w, all_ = Window.partitionBy("label").orderBy("pid"), Window.partitionBy("label")
    v = F.struct("x", "y")
    k = q.select("*", F.lag(v).over(w).alias("p"), F.first(v).over(w).alias("f")).filter("p is null or p <> struct(x, y)")
    e = k.select("*", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("pid"))).alias("back"), F.count(F.lit(1)).over(all_).alias("n"))
    c = e.filter(~((F.col("back") == 1) & (F.col("n") > 1) & (v == F.col("f"))))
    return c.withColumn("m", F.count(F.lit(1)).over(all_)).filter("m >= 3").select("label", "pid", "x", "y")


_RINGS = f"with {PTS}, a as (select label, list(round(x, 2) + 0.0 order by pid) as a, list(round(x, 2) + 0.0 order by (pid + label) % 500, pid) as b from pts group by label), n as (select *, len(a) as n, case when label % 2 = 0 then a[2 :] || a[: 1] else b end as o from a)"


@query("cyclic_equality", f"{_RINGS} select label, n = len(o) and list_bool_or(list_transform(range(n), lambda k: a[k + 1 :] || a[: k] = o)) as same_ring, a = o as same_sequence from n")
def cyclic_equality(spark, sf):
    """Of each label's sequence and a turned (even labels) or otherwise ordered one: equal as rings, equal as sequences."""
    p = pts(spark, sf).select("label", "pid", rounded("x", 2).alias("x"))
    order = lambda *k: F.transform(F.array_sort(F.collect_list(F.struct(*k, "x"))), lambda s: s["x"])
    # a ring is a polygon: its vertices are one row
    both = p.groupBy("label").agg(order("pid").alias("a"), order(((F.col("pid") + F.col("label")) % 500).alias("m"), "pid").alias("b"))
    turned = F.concat(F.slice("a", F.lit(2), F.greatest(F.size("a") - 1, F.lit(0))), F.slice("a", 1, 1))
    o = both.withColumn("o", F.when(F.col("label") % 2 == 0, turned).otherwise(F.col("b")))
    return o.select("label", g.same_ring(F.col("a"), F.col("o")).alias("same_ring"), equality.sequences_within(F.col("a"), F.col("o"), 0.0).alias("same_sequence"))


def _vec_pairs(spark, sf):
    v = vecs(spark, sf)
    return v.join(v.select((F.col("pid") - 1).alias("pid"), F.col("v").alias("w")), "pid")


_VP = f"with {VECS}, p as (select a.pid, a.v, b.v as w from vecs a join vecs b on b.pid = a.pid + 1)"
_L = "list_sum(list_transform(list_zip(v, w), lambda q: {}))"


@query("metric_euclidean", f"{_VP} select pid, {r('sqrt(' + _L.format('(q[1] - q[2]) * (q[1] - q[2])') + ')', 'd')}, {r(_L.format('(q[1] - q[2]) * (q[1] - q[2])'), 'd2')} from p")
def metric_euclidean(spark, sf):
    return _vec_pairs(spark, sf).select("pid", rounded(m.euclidean(F.col("v"), F.col("w"))).alias("d"), rounded(m.squared_euclidean(F.col("v"), F.col("w"))).alias("d2"))


@query("metric_manhattan", f"{_VP} select pid, {r(_L.format('abs(q[1] - q[2])'), 'd')} from p")
def metric_manhattan(spark, sf):
    return _vec_pairs(spark, sf).select("pid", rounded(m.manhattan(F.col("v"), F.col("w"))).alias("d"))


_COS = "list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w)))"


@query("metric_cosine", f"{_VP} select pid, {r(_COS, 's')} from p")
def metric_cosine(spark, sf):
    return _vec_pairs(spark, sf).select("pid", rounded(m.cosine(F.col("v"), F.col("w"))).alias("s"))


@query("metric_angular", f"{_VP} select pid, {r(f'acos(greatest(least({_COS}, 1), -1)) / pi()', 'd')} from p")
def metric_angular(spark, sf):
    return _vec_pairs(spark, sf).select("pid", rounded(m.angular(F.col("v"), F.col("w"))).alias("d"))


@query("metric_jaccard", f"{_VP} select pid, {r(_L.format('least(abs(q[1]), abs(q[2]))') + ' / ' + _L.format('greatest(abs(q[1]), abs(q[2]))'), 's')} from p")
def metric_jaccard(spark, sf):
    a = F.transform("v", F.abs)
    return _vec_pairs(spark, sf).withColumn("w", F.transform("w", F.abs)).select("pid", rounded(m.weighted_jaccard(a, F.col("w"))).alias("s"))


@query(
    "set_jaccard",
    "with s as (select l_suppkey as k, list_distinct(list(l_linenumber * 10 + l_quantity::int % 10)) as v from lineitem group by 1) select a.k, round(len(list_intersect(a.v, b.v)) / len(list_distinct(list_concat(a.v, b.v))), 6) + 0.0 as s from s a join s b on b.k = a.k + 1",
)
def set_jaccard(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_set(F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int") % 10).alias("v"))
    return s.join(s.select((F.col("k") - 1).alias("k"), F.col("v").alias("w")), "k").select("k", rounded(m.set_jaccard(F.col("v"), F.col("w"))).alias("s"))


@query("bits_log2_pow2", "with b as (select p_partkey as n, len(bin(p_partkey)) - 1 as f, case when p_partkey = 1 then 0 else len(bin(p_partkey - 1)) end as c from part) select n, f::int as floor_log2, c::int as ceil_log2, (1::bigint << f::int) as floor_pow2, (1::bigint << c::int) as ceil_pow2 from b where n > 0")
def bits_log2_pow2(spark, sf):
    n = F.col("n")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("n")).filter("n > 0")
    return p.select("n", g.floor_log2(n).cast("int").alias("floor_log2"), g.ceil_log2(n).cast("int").alias("ceil_log2"), g.floor_power2(n).alias("floor_pow2"), g.ceil_power2(n).alias("ceil_pow2"))


@query(
    "rgb_pack_gray",
    "with c as (select p_partkey, p_partkey % 256 as r, p_size * 5 % 256 as g, p_partkey * 7 % 256 as b from part), p as (select *, (255::bigint << 24) | (r::bigint << 16) | (g::bigint << 8) | b::bigint as v from c) "
    "select p_partkey, (case when v >= 2147483648 then v - 4294967296 else v end)::int as packed, ((11 * r + 16 * g + 5 * b) // 32)::int as gray, r::int as r, g::int as g, b::int as b from p",
)
def rgb_pack_gray(spark, sf):
    c = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 256).alias("r"), (F.col("p_size") * 5 % 256).alias("g"), (F.col("p_partkey") * 7 % 256).alias("b"))
    c = c.select("*", g.pack_rgb(F.col("r"), F.col("g"), F.col("b")).alias("packed"), g.gray(F.col("r"), F.col("g"), F.col("b")).alias("gray"))
    _, red, green, blue = g.unpack_rgb(F.col("packed"))
    return c.select("p_partkey", "packed", "gray", red.alias("r"), green.alias("g"), blue.alias("b"))


# a small matrix as (i, j, v): covariances and counts of line items by return flag and status
_MAT = f"with {LI}, t as (select l_returnflag as f, x, y, z from li), a as (select ascii(f) % 7 as i, j, avg(case j when 0 then x when 1 then y else z end) as v from t, range(3) u(j) group by 1, 2)"


def _matrix(spark, sf):
    t = li(spark, sf).select((F.ascii("l_returnflag") % 7).alias("i"), F.posexplode(F.array("x", "y", "z")).alias("j", "v"))
    return t.groupBy("i", F.col("j").cast("long").alias("j")).agg(F.avg("v").alias("v"))


@query("matmul_coo", f"{_MAT} select a.i::int as i, b.i::int as j, {r('sum(a.v * b.v)', 'v', 4)} from a join a b on a.j = b.j group by 1, 2")
def matmul_coo(spark, sf):
    """A matrix times its own transpose."""
    a = _matrix(spark, sf)
    return matrices.multiply(a, matrices.transpose(a)).select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), rounded("v", 4).alias("v"))


@query("matrix_transpose_trace", f"{_MAT}, p as (select a.i, b.i as j, sum(a.v * b.v) as v from a join a b on a.j = b.j group by 1, 2) select (select {r('sum(v)', 't', 4).replace(' as t', '')} from p where i = j) as trace, (select round(sum(v), 4) + 0.0 from p where i < j) as upper, (select count(*) from a) as n")
def matrix_transpose_trace(spark, sf):
    a = _matrix(spark, sf)
    p = matrices.multiply(a, matrices.transpose(a))
    return p.agg(rounded(F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))), 4).alias("trace"), rounded(F.sum(F.when(F.col("i") < F.col("j"), F.col("v"))), 4).alias("upper")).crossJoin(F.broadcast(a.agg(F.count(F.lit(1)).alias("n"))))


@query("matvec", f"{_MAT} select i::int as i, {r('sum(v * (j + 1))', 'v', 4)} from a group by i")
def matvec(spark, sf):
    a = _matrix(spark, sf)
    x = a.select(F.col("j").alias("i")).distinct().withColumn("v", F.col("i") + 1.0)
    return matrices.times_vector(a, x).select(F.col("i").cast("int").alias("i"), rounded("v", 4).alias("v"))


@query("vecmat", f"{_MAT} select j::bigint as j, {r('sum(v * (i + 1))', 'v', 4)} from a group by j")
def vecmat(spark, sf):
    a = _matrix(spark, sf)
    x = a.select("i").distinct().withColumn("v", F.col("i") + 1.0)
    return matrices.vector_times(x, a).select("j", rounded("v", 4).alias("v"))


@query("matrix_swap_identity", f"{_MAT}, w as (select i, case j when 0 then 2 when 2 then 0 else j end as j, v from a union all select range as i, range as j, 1.0 as v from range(3)) select i::int as i, j::int as j, {r('sum(v)', 'v', 4)} from w group by 1, 2")
def matrix_swap_identity(spark, sf):
    """The matrix with its outer columns swapped, plus the identity."""
    m = matrices.add(matrices.swap_columns(_matrix(spark, sf), 0, 2), matrices.identity(spark, 3))
    return m.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), rounded("v", 4).alias("v"))


@query("symmetry_check", f"{_MAT}, p as (select a.i, b.i as j, sum(a.v * b.v) as v from a join a b on a.j = b.j group by 1, 2) select bool_and(abs(p.v - coalesce(t.v, 0)) <= 1e-6) as symmetric, bool_and(p.i <= p.j + 1 or p.v = 0) as hessenberg from p left join p t on t.i = p.j and t.j = p.i")
def symmetry_check(spark, sf):
    a = _matrix(spark, sf)
    return matrices.shape_tests(matrices.multiply(a, matrices.transpose(a)))


@query("matrix_add_scale", f"{_MAT} select i::int as i, j::int as j, {r('v * 2.5 + v', 'v', 4)} from a")
def matrix_add_scale(spark, sf):
    a = _matrix(spark, sf)
    return matrices.add(matrices.scaled(a, 2.5), a).select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), rounded("v", 4).alias("v"))


@query("symmetric_eigen_nxn")
def symmetric_eigen_nxn(spark, sf):
    """Eigenvalues of each label's 8x8 covariance, descending."""
    v = table(spark, sf, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(f"c{i}") for i in range(8)])
    cov = v.groupBy("label").agg(F.array(*[F.covar_pop(f"c{i}", f"c{j}") for i in range(8) for j in range(8)]).alias("a"))
    return matrices.eigenvalues(cov, "label", "a", 8)


@query("matrix_balance")
def matrix_balance(spark, sf):
    """The diagonal scaling that evens out rows and columns of each label's matrix of scaled second moments."""
    v = table(spark, sf, "embeddings").select("label", *[(F.col("embedding")[i].cast("double") * 10.0**i).alias(f"c{i}") for i in range(4)])
    cov = v.groupBy("label").agg(F.array(*[F.avg(F.col(f"c{i}") * F.col(f"c{j}") * (1 + i)) for i in range(4) for j in range(4)]).alias("a"))
    return matrices.balanced(cov, "label", "a", 4)
