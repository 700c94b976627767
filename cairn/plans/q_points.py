"""Queries: projections, filters, grids, sorts and set operations of point tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import voxels
from ..operators.order import numbered
from ..operators.stats import top_k
from .registry import EV, LI, PTS, TGT, ev, li, pts, query, r, rounded, table, two_scans

def _xyz(*extra):
    return [*extra, *[rounded(c).alias(c) for c in "xyz"]]


_RXYZ = ", ".join(r(c, c) for c in "xyz")


@query("center_cloud", f"with {PTS}, {TGT}, c as (select avg(x) as cx, avg(y) as cy, avg(z) as cz from tgt) select pid, {r('x - cx', 'x')}, {r('y - cy', 'y')}, {r('z - cz', 'z')} from pts, c")
def center_cloud(spark, sf):
    """Points about the centroid of the target scan."""
    p, target = two_scans(spark, sf)
    centre = F.broadcast(target.agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"]))  # one row
    return p.crossJoin(centre).select("pid", *[rounded(F.col(c) - F.col(f"c{c}")).alias(c) for c in "xyz"])


_M = [0.9998, -0.0150, 0.0132, 0.25, 0.0152, 0.9997, -0.0170, -0.125, -0.0129, 0.0172, 0.9998, 0.0625, 0.0, 0.0, 0.0, 1.0]


@query("rigid_transform", f"with {PTS} select pid, " + ", ".join(r(f"x * {_M[4 * i]} + y * ({_M[4 * i + 1]}) + z * ({_M[4 * i + 2]}) + ({_M[4 * i + 3]})", c) for i, c in enumerate("xyz")) + " from pts")
def rigid_transform(spark, sf):
    p = pts(spark, sf)
    return p.select("pid", *[rounded(v).alias(c) for v, c in zip(g.transform(g.vec(), _M), "xyz", strict=True)])


def _cell(leaf: float, c: str) -> str:
    return f"floor({c} / {leaf})::bigint"


_KEYS = lambda leaf: ", ".join(f"{_cell(leaf, c)} as k{c}" for c in "xyz")
_AVG = ", ".join(r(f"avg({c})", c) for c in "xyz")


@query("voxel_downsample", f"with {PTS} select {_KEYS(0.05)}, count(*) as n, {_AVG} from pts group by 1, 2, 3")
def voxel_downsample(spark, sf):
    return voxels.downsample(pts(spark, sf), 0.05).select("kx", "ky", "kz", "n", *_xyz())


@query("voxel_downsample_large", f"with {LI} select {_KEYS(5.0)}, count(*) as n, {', '.join(r(f'avg({c})', c, 5) for c in 'xyz')} from li group by 1, 2, 3")
def voxel_downsample_large(spark, sf):
    return voxels.downsample(li(spark, sf), 5.0).select("kx", "ky", "kz", "n", *[rounded(c, 5).alias(c) for c in "xyz"])


@query("grid_sample", f"with {PTS} select {_KEYS(0.1)}, min(pid) as representative from pts group by 1, 2, 3")
def grid_sample(spark, sf):
    return voxels.occupied(pts(spark, sf), 0.1)


@query("grid_sample_count", f"with {LI}, k as (select distinct {_KEYS(2.0)} from li) select count(*) as n_cells from k")
def grid_sample_count(spark, sf):
    return voxels.cells(li(spark, sf), 2.0).select("kx", "ky", "kz").distinct().agg(F.count(F.lit(1)).alias("n_cells"))


@query(
    "box_voxelize",
    f"with {PTS}, b as (select min(x) as lx, min(y) as ly, min(z) as lz, max(x) as hx, max(y) as hy, max(z) as hz from pts) select "
    + ", ".join(f"least(floor(({c} - l{c}) / 0.1)::bigint, greatest(floor((h{c} - l{c}) / 0.1)::bigint, 0)) as k{c}" for c in "xyz")
    + f", count(*) as n, {_AVG} from pts, b group by 1, 2, 3",
)
def box_voxelize(spark, sf):
    return voxels.box_voxels(pts(spark, sf), 0.1).select("kx", "ky", "kz", "n", *_xyz())


@query(
    "voxel_adjacency",
    f"with {PTS}, v as (select distinct {_KEYS(0.1)} from pts) select a.kx as akx, a.ky as aky, a.kz as akz, b.kx, b.ky, b.kz from v a join v b on abs(a.kx - b.kx) <= 1 and abs(a.ky - b.ky) <= 1 and abs(a.kz - b.kz) <= 1",
)
def voxel_adjacency(spark, sf):
    return voxels.adjacent(voxels.cells(pts(spark, sf), 0.1))


@query("centroid", f"with {EV} select epoch, count(*) as n, {_AVG} from ev group by epoch")
def centroid(spark, sf):
    return ev(spark, sf).groupBy("epoch").agg(F.count(F.lit(1)).alias("n"), *[rounded(F.avg(c)).alias(c) for c in "xyz"])


@query("weighted_centroid", f"with {LI} select l_returnflag, " + ", ".join(r(f"sum(x * {c}) / nullif(sum(x), 0)", c, 5) for c in "xyz") + " from li group by 1")
def weighted_centroid(spark, sf):
    return li(spark, sf).groupBy("l_returnflag").agg(*[rounded(F.try_divide(F.sum(F.col("x") * F.col(c)), F.sum("x")), 5).alias(c) for c in "xyz"])


@query("segment_midpoint", f"with {PTS} select a.pid, {', '.join(r(f'(a.{c} + b.{c}) / 2', c) for c in 'xyz')} from pts a join pts b on b.pid = a.pid + 1")
def segment_midpoint(spark, sf):
    p = pts(spark, sf)
    b = p.select((F.col("pid") - 1).alias("pid"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    return p.join(b, "pid").select("pid", *[rounded((F.col(c) + F.col(f"b{c}")) / 2).alias(c) for c in "xyz"])


_BOX = ", ".join(r(f"{f}({c})", f"{c}_{f}") for c in "xyz" for f in ("min", "max"))


@query("bbox", f"with {EV} select epoch, {_BOX}, {', '.join(r(f'max({c}) - min({c})', f'{c}_length') for c in 'xyz')} from ev group by epoch")
def bbox(spark, sf):
    return ev(spark, sf).groupBy("epoch").agg(
        *[rounded(f(c)).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))], *[rounded(F.max(c) - F.min(c)).alias(f"{c}_length") for c in "xyz"]
    )


@query(
    "bbox_join_intersect",
    f"with {PTS}, b as (select label, {', '.join(f'min({c}) as l{c}, max({c}) as h{c}' for c in 'xyz')} from pts group by label) select a.label, "
    + ", ".join(f"{r(f'least(a.l{c}, b.l{c})', f'join_l{c}')}, {r(f'greatest(a.h{c}, b.h{c})', f'join_h{c}')}, {r(f'greatest(a.l{c}, b.l{c})', f'meet_l{c}')}, {r(f'least(a.h{c}, b.h{c})', f'meet_h{c}')}" for c in "xyz")
    + " from b a join b on b.label = a.label + 1",
)
def bbox_join_intersect(spark, sf):
    b = pts(spark, sf).groupBy("label").agg(*[f(c).alias(n + c) for c in "xyz" for n, f in (("l", F.min), ("h", F.max))])
    o = b.select((F.col("label") - 1).alias("label"), *[F.col(f"{n}{c}").alias(f"o{n}{c}") for c in "xyz" for n in "lh"])
    out = []
    for c in "xyz":
        out += [rounded(F.least(f"l{c}", f"ol{c}")).alias(f"join_l{c}"), rounded(F.greatest(f"h{c}", f"oh{c}")).alias(f"join_h{c}")]
        out += [rounded(F.greatest(f"l{c}", f"ol{c}")).alias(f"meet_l{c}"), rounded(F.least(f"h{c}", f"oh{c}")).alias(f"meet_h{c}")]
    return b.join(o, "label").select("label", *out)


@query("clamp", f"with {PTS} select pid, {', '.join(r(f'greatest(least({c}, 0.1), -0.1)', c) for c in 'xyz')} from pts")
def clamp(spark, sf):
    return pts(spark, sf).select("pid", *[rounded(g.clamp(F.col(c), -0.1, 0.1)).alias(c) for c in "xyz"])


@query("order_along_direction", f"with {PTS} select pid, row_number() over (order by x * 0.6 + y * 0.8 - z * 0.1, pid) - 1 as along, row_number() over (order by z, pid) - 1 as by_z from pts")
def order_along_direction(spark, sf):
    p = pts(spark, sf).withColumn("a", F.col("x") * 0.6 + F.col("y") * 0.8 - F.col("z") * 0.1)
    return numbered(numbered(p, ["a", "pid"], "along"), ["z", "pid"], "by_z").select("pid", "along", "by_z")


@query("lexicographic_compare", f"with {PTS} select a.pid, (a.x, a.y, a.z) < (b.x, b.y, b.z) as less, (a.x, a.y, a.z) <= (b.x, b.y, b.z) as at_most, (a.x, a.y, a.z) = (b.x, b.y, b.z) as same from pts a join pts b on b.pid = a.pid + 1")
def lexicographic_compare(spark, sf):
    p = pts(spark, sf)
    b = p.select((F.col("pid") - 1).alias("pid"), F.struct("x", "y", "z").alias("b"))
    a = F.struct("x", "y", "z")
    return p.join(b, "pid").select("pid", (a < F.col("b")).alias("less"), (a <= F.col("b")).alias("at_most"), (a == F.col("b")).alias("same"))


@query("approximate_equality", f"with {PTS} select a.pid, abs(a.x - b.x) <= 0.02 as near_x, abs(a.x - b.x) <= 0.02 and abs(a.y - b.y) <= 0.02 and abs(a.z - b.z) <= 0.02 as near from pts a join pts b on b.pid = a.pid + 1")
def approximate_equality(spark, sf):
    p = pts(spark, sf)
    b = p.select((F.col("pid") - 1).alias("pid"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    near = [F.abs(F.col(c) - F.col(f"b{c}")) <= 0.02 for c in "xyz"]
    return p.join(b, "pid").select("pid", near[0].alias("near_x"), (near[0] & near[1] & near[2]).alias("near"))


@query("argsort", f"with {PTS} select pid, row_number() over (order by x, pid) - 1 as place from pts")
def argsort(spark, sf):
    return numbered(pts(spark, sf), ["x", "pid"], "place").select("pid", "place")


@query("sort_scans", f"with {EV} select epoch, row_number() over (order by epoch) - 1 as scan_idx, n from (select epoch, count(*) as n from ev group by epoch)")
def sort_scans(spark, sf):
    # one row per scan
    return ev(spark, sf).groupBy("epoch").agg(F.count(F.lit(1)).alias("n")).select("epoch", (F.row_number().over(Window.orderBy("epoch")) - 1).alias("scan_idx"), "n")


@query("topk_global", f"with {EV} select event_id, {r('x', 'x')} from ev order by ev.x desc, event_id limit 25")
def topk_global(spark, sf):
    return ev(spark, sf).orderBy(F.desc("x"), "event_id").limit(25).select("event_id", rounded("x").alias("x"))


@query("topk_per_key", f"with {EV} select event_type, event_id, {r('x', 'x')} from (select *, row_number() over (partition by event_type order by x desc, event_id) as k from ev) where k <= 5")
def topk_per_key(spark, sf):
    return top_k(ev(spark, sf), 5, ["event_type"], [F.desc("x"), "event_id"]).select("event_type", "event_id", rounded("x").alias("x"))


@query("argmin_by_direction", f"with {PTS} select label, arg_min(pid, (x * 0.6 + y * 0.8, pid)) as first_pid, arg_max(pid, (x * 0.6 + y * 0.8, pid)) as last_pid from pts group by label")
def argmin_by_direction(spark, sf):
    along = F.struct(F.col("x") * 0.6 + F.col("y") * 0.8, F.col("pid"))
    return pts(spark, sf).groupBy("label").agg(F.min_by("pid", along).alias("first_pid"), F.max_by("pid", along).alias("last_pid"))


@query("union_all", f"with {PTS}, u as (select * from pts where label < 4 union all select * from pts where label > 2) select label, count(*) as n, {r('sum(x)', 'sx')} from u group by label")
def union_all(spark, sf):
    p = pts(spark, sf)
    return p.filter("label < 4").unionByName(p.filter("label > 2")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("x")).alias("sx"))


@query("complement", f"with {PTS} select pid, label from pts where pid not in (select pid from pts where x > 0)")
def complement(spark, sf):
    p = pts(spark, sf)
    return p.join(p.filter("x > 0").select("pid"), "pid", "left_anti").select("pid", "label")


@query("semi_members", f"with {PTS} select pid, label from pts where label in (select label from pts group by label having avg(x) > 0)")
def semi_members(spark, sf):
    p = pts(spark, sf)
    return p.join(p.groupBy("label").agg(F.avg("x").alias("m")).filter("m > 0"), "label", "left_semi").select("pid", "label")


@query("dedup_cells", f"with {LI} select distinct {_KEYS(10.0)} from li")
def dedup_cells(spark, sf):
    return voxels.cells(li(spark, sf), 10.0).select("kx", "ky", "kz").dropDuplicates()


@query("lookup_join", f"with {PTS}, c as (select label, avg(x) as cx, avg(y) as cy, avg(z) as cz from pts group by label) select pid, {', '.join(r(f'{k} - c{k}', f'd{k}') for k in 'xyz')} from pts join c using (label)")
def lookup_join(spark, sf):
    p = pts(spark, sf)
    c = p.groupBy("label").agg(*[F.avg(k).alias(f"c{k}") for k in "xyz"])
    return p.join(c, "label").select("pid", *[rounded(F.col(k) - F.col(f"c{k}")).alias(f"d{k}") for k in "xyz"])


@query("zip_by_id", f"with {PTS}, a as (select pid, x from pts), b as (select pid, y, z from pts) select pid, {_RXYZ} from a join b using (pid)")
def zip_by_id(spark, sf):
    p = pts(spark, sf)
    return p.select("pid", "x").join(p.select("pid", "y", "z"), "pid").select(*_xyz("pid"))


_NAME = "'scan_Epoch_' || lpad((p_partkey % 997)::varchar, 3, '0') || '_' || p_partkey || '.pcd'"


@query("parse_epoch", f"with f as (select p_partkey, {_NAME} as path from part) select p_partkey, path, substr(path, instr(path, 'Epoch_') + 6, 3)::bigint as epoch from f")
def parse_epoch(spark, sf):
    from ..sources.catalog import epoch_of

    p = table(spark, sf, "part")
    path = F.concat(F.lit("scan_Epoch_"), F.lpad((F.col("p_partkey") % 997).cast("string"), 3, "0"), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".pcd"))
    return p.select("p_partkey", path.alias("path")).withColumn("epoch", epoch_of(F.col("path")))


@query(
    "scan_catalog",
    f"with {EV}, f as (select distinct 'data/Epoch_' || lpad((epoch % 1000)::varchar, 3, '0') || '.pcd' as path from ev), e as (select path, substr(path, instr(path, 'Epoch_') + 6, 3)::bigint as epoch from f) "
    "select (row_number() over (order by epoch, path) - 1)::int as scan_idx, epoch, path from e",
)
def scan_catalog(spark, sf):
    from ..sources.catalog import catalog

    paths = ev(spark, sf).select(F.concat(F.lit("data/Epoch_"), F.lpad((F.col("epoch") % 1000).cast("string"), 3, "0"), F.lit(".pcd")).alias("path")).distinct()
    return catalog(paths)


@query("format_message", "select s_suppkey, format('{:05d} {:s} {:.2f}', s_suppkey, s_name, s_acctbal) as message from supplier")
def format_message(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.format_string("%05d %s %.2f", "s_suppkey", "s_name", "s_acctbal").alias("message"))
