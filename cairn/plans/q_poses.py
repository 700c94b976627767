"""Queries: pose chains, covariance propagation, angles and errors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import poses
from .registry import PTS, pts, query, r, rounded, table

# a pose for each nation but the first: small rotations about z, y and x, and a translation; its target is half its number
_SRC = "src as (select n_nationkey::bigint as src_idx, (n_nationkey // 2)::bigint as tgt_idx, 0.01 * n_nationkey as rz, -0.004 * n_nationkey as ry, 0.002 * n_regionkey as rx, 0.1 * n_regionkey as tx, 0.05 * n_nationkey as ty, -0.02 * n_nationkey as tz from nation where n_nationkey > 0)"
_T = """ps as (select src_idx, tgt_idx, [cos(rz) * cos(ry), cos(rz) * sin(ry) * sin(rx) - sin(rz) * cos(rx), cos(rz) * sin(ry) * cos(rx) + sin(rz) * sin(rx), tx,
  sin(rz) * cos(ry), sin(rz) * sin(ry) * sin(rx) + cos(rz) * cos(rx), sin(rz) * sin(ry) * cos(rx) - cos(rz) * sin(rx), ty,
  -sin(ry), cos(ry) * sin(rx), cos(ry) * cos(rx), tz, 0, 0, 0, 1] as t,
  list_transform(range(36), lambda i: case when i % 7 = 0 then 0.0001 * (1 + i // 7) + 0.00001 * src_idx else 0.000001 * (i % 6 + i // 6) end)::double[] as vcm from src)"""


def _mm(a: str, b: str, n: int) -> str:
    """The product of two row-major lists of n x n numbers, entry by entry."""
    return "[" + ", ".join(" + ".join(f"{a}[{i * n + k + 1}] * {b}[{k * n + j + 1}]" for k in range(n)) for i in range(n) for j in range(n)) + "]"


def _pairs(spark, sf):
    n = table(spark, sf, "nation").filter("n_nationkey > 0")
    k, reg = F.col("n_nationkey"), F.col("n_regionkey")
    s = n.select(k.cast("long").alias("src_idx"), F.floor(k / 2).cast("long").alias("tgt_idx"), (0.01 * k).alias("rz"), (-0.004 * k).alias("ry"), (0.002 * reg).alias("rx"), (0.1 * reg).alias("tx"), (0.05 * k).alias("ty"), (-0.02 * k).alias("tz"))
    c = {a: F.cos("r" + a) for a in "xyz"}
    d = {a: F.sin("r" + a) for a in "xyz"}
    rows = [
        c["z"] * c["y"], c["z"] * d["y"] * d["x"] - d["z"] * c["x"], c["z"] * d["y"] * c["x"] + d["z"] * d["x"], F.col("tx"),
        d["z"] * c["y"], d["z"] * d["y"] * d["x"] + c["z"] * c["x"], d["z"] * d["y"] * c["x"] - c["z"] * d["x"], F.col("ty"),
        -d["y"], c["y"] * d["x"], c["y"] * c["x"], F.col("tz"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0),
    ]
    vcm = [0.0001 * (1 + i // 7) + 0.00001 * F.col("src_idx") if i % 7 == 0 else F.lit(0.000001 * (i % 6 + i // 6)) for i in range(36)]
    return s.select("src_idx", "tgt_idx", F.array(*rows).alias("t"), F.array(*vcm).alias("vcm"))


_ANGLES = "-asin(greatest(least(t[9], 1), -1)) as ay"
_PAR = f"(select *, atan2(t[10] / cos(ay), t[11] / cos(ay)) as ax, atan2(t[5] / cos(ay), t[1] / cos(ay)) as az from (select *, {_ANGLES} from {{}}))"


@query("euler_from_pose", f"with {_SRC}, {_T} select src_idx, {r('ax', 'rx')}, {r('ay', 'ry')}, {r('az', 'rz')} from {_PAR.format('ps')}")
def euler_from_pose(spark, sf):
    p = poses.parameters(_pairs(spark, sf), "src_idx")
    return p.select("src_idx", *[rounded(F.col(c) * (math.pi / 200)).alias(c) for c in ("rx", "ry", "rz")])


@query("pose_parameters", f"with {_SRC}, {_T} select src_idx, {r('ax * 200 / pi()', 'rx', 5)}, {r('ay * 200 / pi()', 'ry', 5)}, {r('az * 200 / pi()', 'rz', 5)}, {r('t[4]', 'tx')}, {r('sqrt(vcm[1]) * 200 / pi() * 1000', 'std_rx', 4)}, {r('sqrt(vcm[36]) * 1000', 'std_tz', 4)} from {_PAR.format('ps')}")
def pose_parameters(spark, sf):
    p = poses.parameters(_pairs(spark, sf), "src_idx")
    return p.select("src_idx", *[rounded(c, 5).alias(c) for c in ("rx", "ry", "rz")], rounded("tx").alias("tx"), rounded("std_rx", 4).alias("std_rx"), rounded("std_tz", 4).alias("std_tz"))


_CHAIN = (
    f"with recursive {_SRC}, {_T}, ch as (select src_idx, t, vcm from ps where tgt_idx = 0 union all "
    f"select p.src_idx, {_mm('c.t', 'p.t', 4)} as t, list_transform(list_zip(c.vcm, {{}}), lambda q: q[1] + q[2]) as vcm from ps p join ch c on p.tgt_idx = c.src_idx)"
)
_R = lambda i, j: f"c.t[{4 * i + j + 1}]"
_S = (("0", "-c.t[12]", "c.t[8]"), ("c.t[12]", "0", "-c.t[4]"), ("-c.t[8]", "c.t[4]", "0"))
_AD = [[_R(i, j) if j < 3 else "0" for j in range(6)] for i in range(3)] + [["(" + " + ".join(f"({_S[i][k]}) * {_R(k, j)}" for k in range(3)) + ")" if j < 3 else _R(i, j - 3) for j in range(6)] for i in range(3)]
_ADV = "[" + ", ".join(" + ".join(f"({_AD[i][k]}) * p.vcm[{k * 6 + m + 1}] * ({_AD[j][m]})" for k in range(6) for m in range(6) if _AD[i][k] != "0" and _AD[j][m] != "0") for i in range(6) for j in range(6)) + "]"
_OUT = ", ".join(r(f"t[{i + 1}]", f"t{i}", 6) for i in range(12))


@query("pose_chain", f"{_CHAIN.format('p.vcm')} select src_idx, {_OUT} from ch")
def pose_chain(spark, sf):
    c = poses.chained(_pairs(spark, sf))
    return c.select("src_idx", *[rounded(F.get("t", F.lit(i))).alias(f"t{i}") for i in range(12)])


_VOUT = ", ".join(r(f"vcm[{i + 1}]", f"v{i}", 7) for i in range(36))


@query("vcm_propagation", f"{_CHAIN.format(_ADV)} select src_idx, {_VOUT} from ch")
def vcm_propagation(spark, sf):
    c = poses.chained(_pairs(spark, sf))
    return c.select("src_idx", *[rounded(F.get("vcm", F.lit(i)), 7).alias(f"v{i}") for i in range(36)])


@query("vcm_sum", f"{_CHAIN.format('p.vcm')} select src_idx, {_VOUT} from ch")
def vcm_sum(spark, sf):
    """Covariances added up, as for targets at a fixed interval."""
    c = poses.chained(_pairs(spark, sf), propagate=False)
    return c.select("src_idx", *[rounded(F.get("vcm", F.lit(i)), 7).alias(f"v{i}") for i in range(36)])


_ERR = ", ".join(r(f"abs(a.{p} - b.{p}) * {k}", f"err_{n}", 3) for p, n, k in (("ax", "rx", "200000 / pi()"), ("ay", "ry", "200000 / pi()"), ("az", "rz", "200000 / pi()"), ("t[4]", "tx", "1000"), ("t[8]", "ty", "1000"), ("t[12]", "tz", "1000")))


@query("pose_abs_error", f"with {_SRC}, {_T}, pr as (select * from {_PAR.format('ps')}) select a.src_idx as epoch, {_ERR} from pr a join pr b on b.src_idx = a.src_idx + 1")
def pose_abs_error(spark, sf):
    """Each pose against the next one's as the truth."""
    p = _pairs(spark, sf)
    e = poses.absolute_errors(p.select(F.col("src_idx").alias("epoch"), "t"), p.select((F.col("src_idx") - 1).alias("epoch"), "t"))
    return e.select("epoch", *[rounded(c, 3).alias(c) for c in e.columns if c != "epoch"])


_MOVE = [0.9998, -0.0150, 0.0132, 0.25, 0.0152, 0.9997, -0.0170, -0.125, -0.0129, 0.0172, 0.9998, 0.0625, 0.0, 0.0, 0.0, 1.0]


def _shift(n: str) -> str:
    rows = [f"({n}x * {_MOVE[4 * i]} + {n}y * ({_MOVE[4 * i + 1]}) + {n}z * ({_MOVE[4 * i + 2]}) + ({_MOVE[4 * i + 3]}) - {n}{c})" for i, c in enumerate("xyz")]
    return "sqrt(" + " + ".join(f"{x} * {x}" for x in rows) + ")"


@query("bbox_corner_change", f"with {PTS}, b as (select label, min(x) as lx, min(y) as ly, min(z) as lz, max(x) as hx, max(y) as hy, max(z) as hz from pts group by label) select label, {r('greatest(' + _shift('l') + ', ' + _shift('h') + ')', 'movement')} from b")
def bbox_corner_change(spark, sf):
    b = pts(spark, sf).groupBy("label").agg(*[f(c).alias(n + c) for n, f in (("l", F.min), ("h", F.max)) for c in "xyz"])
    return poses.box_movement(b, _MOVE).select("label", rounded("movement").alias("movement"))


@query("uncenter_pose", f"with {_SRC}, {_T}, {PTS}, c as (select avg(x) as cx, avg(y) as cy, avg(z) as cz from pts) select src_idx, " + ", ".join(r(f"t[{4 * i + 4}] + c{c} - (t[{4 * i + 1}] * cx + t[{4 * i + 2}] * cy + t[{4 * i + 3}] * cz)", f"t{c}") for i, c in enumerate("xyz")) + " from ps, c")
def uncenter_pose(spark, sf):
    """The translation of a pose found in coordinates reduced by a centroid."""
    centre = F.broadcast(pts(spark, sf).agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"]))
    one, zero = F.lit(1.0), F.lit(0.0)
    move = lambda s: F.array(one, zero, zero, s * F.col("cx"), zero, one, zero, s * F.col("cy"), zero, zero, one, s * F.col("cz"), zero, zero, zero, one)
    p = _pairs(spark, sf).crossJoin(centre)
    whole = poses.matmul(poses.matmul(move(1.0), F.col("t"), 4), move(-1.0), 4)
    return p.select("src_idx", whole.alias("w")).select("src_idx", *[rounded(F.get("w", F.lit(4 * i + 3))).alias(f"t{c}") for i, c in enumerate("xyz")])


_OV = f"{PTS}, sz as (select label, count(*) as n from pts group by label), h as (select a.label as s, b.label as t, count(distinct a.pid) as hits from pts a join pts b on b.label < a.label where sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) < 0.08 group by 1, 2), ov as (select a.label::bigint as src_idx, b.label::bigint as tgt_idx, coalesce(hits, 0) / a.n as ratio from sz a join sz b on b.label < a.label left join h on h.s = a.label and h.t = b.label)"


def _ratios(spark, sf):
    return poses.overlaps(pts(spark, sf).withColumn("scan_idx", F.col("label").cast("long")), 0.08)


@query("scan_overlaps", f"with {_OV} select src_idx, tgt_idx, {r('ratio', 'ratio')} from ov")
def scan_overlaps(spark, sf):
    return _ratios(spark, sf).select("src_idx", "tgt_idx", rounded("ratio").alias("ratio"))


@query(
    "adaptive_pairs",
    f"with recursive {_OV}, fold as (select 0::bigint as src_idx, 0::bigint as tgt_idx union all select src_idx + 1, coalesce((select min(o.tgt_idx) from ov o where o.src_idx = fold.src_idx + 1 and o.tgt_idx >= fold.tgt_idx and o.ratio > 0.7), fold.src_idx) from fold where src_idx < (select max(src_idx) from ov)) select src_idx, tgt_idx from fold where src_idx > 0",
)
def adaptive_pairs(spark, sf):
    return poses.adaptive_targets(_ratios(spark, sf), 0.7)
