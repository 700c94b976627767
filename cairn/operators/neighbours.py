"""Exact nearest-neighbour joins of point tables.

Points are rows (id, x, y, z).  Of equal distances the smaller id is the nearer.  There are
two ways.  A target of at most ``SMALL`` points (counted first) is broadcast, and every Arrow
batch of source points is compared with it in blocks.  A larger one is bucketed into a grid:
each unresolved source point looks at the 27 cells around it, which hold everything nearer
than one cell; points whose k-th neighbour is nearer than that are done, the rest go on
with cells of twice the size.  Both are exact.  Cells meet in blocks of ``ACROSS`` cells a side: a
target point goes to every block within a cell of it, a source point to its own, and a block is one task's group
(one of many source points is parted among several).  Blocks of many points are dealt out in turns, so that the files of
one exchange stay bounded.  ``with_nearest`` makes something of each point's neighbours in those tasks, so that the pairs are
never written.

The distance is Euclidean, or any ``metric`` of two places that is never less than the largest difference of a
coordinate; such a one is an expression and takes the second way, by an equi-join on cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from ..plans import storage

SMALL = 20_000
ACROSS = 16  # cells of a block's side
MOST_IN_BLOCK = 30_000  # source points of a block that one task takes
AT_ONCE = 4_000_000  # points dealt out in one exchange: some 300 MB of files
_BLOCK = 1 << 21  # distances held at once


Metric = Callable[[g.Vec, g.Vec], Column]


def manhattan(a: g.Vec, b: g.Vec) -> Column:
    return sum((F.abs(p - q) for p, q in zip(a[1:], b[1:], strict=True)), F.abs(a[0] - b[0]))


def chebyshev(a: g.Vec, b: g.Vec) -> Column:
    return F.greatest(*[F.abs(p - q) for p, q in zip(a, b, strict=True)])


def _squared(metric: Metric | None) -> Column:
    """The squared distance of (x, y, z) and (tx, ty, tz), added in the order x, y, z."""
    if metric is not None:
        d = metric(g.vec(), g.vec(prefix="t"))
        return d * d
    return (F.col("x") - F.col("tx")) * (F.col("x") - F.col("tx")) + (F.col("y") - F.col("ty")) * (F.col("y") - F.col("ty")) + (F.col("z") - F.col("tz")) * (F.col("z") - F.col("tz"))


def _points(df: DataFrame, pid: str, xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    return df.select(F.col(pid).cast("long").alias("id"), *[F.col(own).cast("double").alias(c) for own, c in zip(xyz, "xyz", strict=True)]).filter("id is not null and x is not null and y is not null and z is not null")


def knn_join(source: DataFrame, target: DataFrame, k: int, *, pid: str = "pid", below: float | None = None, include_self: bool = True, small: int = SMALL, cell: float | None = None, metric: Metric | None = None, xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """(pid, nbr_id, rank from 1, d2) of the k nearest target points of each source point.

    ``pid`` and ``xyz`` name the columns of both tables.  ``below``: only squared distances under it.  Without ``include_self`` target points of
    the same id are left out.  Points with a null id or coordinate take no part.
    """
    s, t = _points(source, pid, xyz), _points(target, pid, xyz)
    n = t.count()
    if n <= small and (metric is None or not n):
        found = _broadcast_knn(s, t, k, below, include_self)
    else:
        found = _grid_knn(s, t, n, k, below, include_self, cell, metric, same=source is target)
    return found.select(F.col("id").alias(pid), "nbr_id", "rank", "d2")


def _broadcast_knn(s: DataFrame, t: DataFrame, k: int, below: float | None, include_self: bool) -> DataFrame:
    rows = sorted(tuple(r) for r in t.collect())
    ids = np.array([r[0] for r in rows], np.int64)
    xyz = np.array([r[1:] for r in rows], np.float64).reshape(-1, 3)
    bc = s.sparkSession.sparkContext.broadcast((ids, xyz))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xyz = bc.value
        step = max(1, _BLOCK // max(1, len(ids)))
        for b in batches:
            own = b.column("id").to_numpy()
            p = np.column_stack([b.column(c).to_numpy() for c in "xyz"])
            for lo in range(0, len(own), step):
                q = p[lo : lo + step]
                d = sum_squares(q, xyz)
                if not include_self:
                    d[own[lo : lo + step, None] == ids[None, :]] = np.inf
                m = min(k, len(ids))
                if not m:
                    continue
                # candidates up to the m-th smallest distance, with all its ties; the ids are ascending
                edge = np.partition(d, m - 1, axis=1)[:, m - 1 : m]
                r, c = np.nonzero((d <= edge) & np.isfinite(d))
                v = d[r, c]
                order = np.lexsort((c, v, r))
                r, c, v = r[order], c[order], v[order]
                rank = np.arange(len(r)) - np.searchsorted(r, r) + 1
                keep = rank <= m
                if below is not None:
                    keep &= v < below
                yield pa.RecordBatch.from_pydict({"id": pa.array(own[lo : lo + step][r[keep]]), "nbr_id": pa.array(ids[c[keep]]), "rank": pa.array(rank[keep].astype(np.int32)), "d2": pa.array(v[keep])})

    return s.mapInArrow(run, "id long, nbr_id long, rank int, d2 double")


def sum_squares(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Squared distances, added in the order x, y, z as the SQL form does."""
    d = (q[:, None, 0] - t[None, :, 0]) ** 2
    d += (q[:, None, 1] - t[None, :, 1]) ** 2
    d += (q[:, None, 2] - t[None, :, 2]) ** 2
    return d


def cells(df: DataFrame, size: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """The rows with integer cell numbers kx, ky, kz."""
    return df.withColumns({f"k{c}": F.floor((F.col(c) - F.lit(float(o))) / F.lit(float(size))).cast("long") for c, o in zip("xyz", origin, strict=True)})


def around(df: DataFrame) -> DataFrame:
    """Each row once for each of the 27 cells around its own."""
    for c in "xyz":
        df = df.withColumn(f"k{c}", F.explode(F.array(*[F.col(f"k{c}") + i for i in (-1, 0, 1)])))
    return df


def _first_cell(t: DataFrame, n: int, k: int, most: int, cell: float | None) -> tuple[float, list, float]:
    """(the size of the first cells, the box of the target, its greatest width)."""
    box = t.agg(*[f(c) for c in "xyz" for f in (F.min, F.max)]).first()
    spans = [max(box[2 * i + 1] - box[2 * i], 0.0) for i in range(3)]
    wide = max([*spans, 1e-12])
    if cell is None:
        volume = np.prod([max(x, wide * 1e-3) for x in spans])
        cell = float(max((volume * (k + 1) / n) ** (1 / 3), wide * 1e-6))
        # points on surfaces fill few of the box's cells
        held = lambda size: cells(t, size).select("kx", "ky", "kz").distinct().count()
        used, finer = held(cell), cell / 2
        while n > most * used and finer > wide * 1e-6 and (more := held(finer)) > used:
            cell, used, finer = finer, more, finer / 2
    return cell, box, wide


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out


def _grid_knn(s: DataFrame, t: DataFrame, n: int, k: int, below: float | None, include_self: bool, cell: float | None, metric: Metric | None = None, same: bool = False) -> DataFrame:
    cell, box, wide = _first_cell(t, n, k, 2 * max(k + 1, 8) if metric is None else k + 1, cell)
    want = min(k, n)
    left, done = s, []
    while True:
        last = cell > 2 * wide and _inside(left, box, cell) or (below is not None and cell * cell >= below)
        if metric is None:
            own = same and not done
            run = _pairs_in_block(cell, k, below, include_self, 0 if last else want, own)
            met = _by_blocks(left, None if own else t, cell, run, "id long, nbr_id long, rank int, d2 double, x double, y double, z double", few=bool(done))
            done.append(met.filter("nbr_id is not null").select("id", "nbr_id", "rank", "d2"))
            rest = met.filter("nbr_id is null").select("id", *"xyz")
        else:
            met = storage.stored(_joined_knn(left, t, cell, k, below, include_self, metric), "near")
            # strict, so that ties at exactly one cell are looked at again
            full = met.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.max("d2").alias("m")).filter((F.col("c") >= want) & (F.col("m") < cell * cell)).select("id")
            done.append(met if last else met.join(full, "id", "left_semi"))
            rest = None if last else storage.stored(left.join(full, "id", "left_anti"), "left")
        if last or not rest.limit(1).count():
            break
        left, cell = rest, 2 * cell
    return _all(done)


Made = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], list[pa.Array]]


def with_nearest(points: DataFrame, k: int, made: Made, kinds: str, *, target: DataFrame | None = None, pid: str = "pid", include_self: bool = True, carry: bool = True, cell: float | None = None) -> DataFrame:
    """The points with the columns ``kinds`` that ``made`` gives of the k nearest target points of each (without ``target``, of the points themselves).

    ``made``: (rows of points in ascending order, and of each one's neighbours, nearest first, the ids, places and squared
    distances; the number of points) -> columns.  It runs where the neighbours are found, so that one row a point is written.
    Points with a null id or coordinate take no part.  Without ``carry`` only the new columns are given.
    """
    kinds = T._parse_datatype_string(kinds)
    others = [c for c in points.columns if c not in (pid, *"xyz")] if carry else []
    s = _points(points, pid) if not others else points.select(F.col(pid).cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in "xyz"], *[F.col(c).alias(f"_c{i}") for i, c in enumerate(others)]).dropna(subset=["id", *"xyz"])
    t = s.select("id", *"xyz") if target is None else _points(target, pid)
    out = [*([F.col(c) if c in "xyz" else F.col("id").alias(pid) if c == pid else F.col(f"_c{others.index(c)}").alias(c) for c in points.columns] if carry else []), *[F.col(f"_m{i}").alias(f.name) for i, f in enumerate(kinds)]]
    names = [f"_m{i}" for i in range(len(kinds))]
    n = t.count()
    if not n:
        return s.withColumns({m: F.lit(None).cast(f.dataType) for m, f in zip(names, kinds, strict=True)}).select(*out)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in s.schema] + [T.StructField(m, f.dataType) for m, f in zip(names, kinds, strict=True)]).add("_sure", "boolean")
    cell, box, wide = _first_cell(t, n, k, 2 * max(k + 1, 8), cell)
    # a point is not among its own neighbours, if it is left out
    want, left, done = min(k, n if include_self else n - 1), s, []
    while True:
        last = cell > 2 * wide and _inside(left, box, cell)
        own = target is None and not done
        run = _made_in_block(cell, k, include_self, 0 if last else want, own, made, s.columns, names, carry)
        met = _by_blocks(left, None if own else t, cell, run, schema, few=bool(done))
        done.append(met.filter("_sure"))
        rest = met.filter("not _sure").select(*s.columns)
        if last or not rest.limit(1).count():
            break
        left, cell = rest, 2 * cell
    return _all(done).select(*out)


def _joined_knn(s: DataFrame, t: DataFrame, cell: float, k: int, below: float | None, include_self: bool, metric: Metric) -> DataFrame:
    """(id, nbr_id, rank, d2): the k nearest in the 27 cells around each source point."""
    near = cells(t, cell).select(F.col("id").alias("nbr_id"), *[F.col(c).alias(f"t{c}") for c in "xyz"], "kx", "ky", "kz")
    met = around(cells(s, cell)).join(near, ["kx", "ky", "kz"])
    if not include_self:
        met = met.filter("id <> nbr_id")
    met = met.withColumn("d2", _squared(metric))
    if below is not None:
        met = met.filter(F.col("d2") < below)
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d2", "nbr_id"))).filter(F.col("rank") <= k).select("id", "nbr_id", "rank", "d2")


_AT = ["bx", "by", "bz"]


def _by_blocks(s: DataFrame, t: DataFrame | None, cell: float, run: Callable[[pa.Table], pa.Table], schema: T.StructType | str, few: bool) -> DataFrame:
    """What ``run`` makes of each block: its source points (``asks``) and the target points in the cells around them; written.

    Without ``t`` the source points are the targets, too, and each is in its own block once.  ``few``: target points that no block
    needs are left out before the exchange.
    """
    block = lambda k, i=0: F.floor((F.col(k) + i) / ACROSS)
    own = cells(s, cell).withColumns({f"b{c}": block(f"k{c}") for c in "xyz"})
    near = own if t is None else cells(t, cell)
    for c in "xyz":
        near = near.withColumn(f"b{c}", F.explode(F.array_distinct(F.array(*[block(f"k{c}", i) for i in (-1, 0, 1)]))))
    with storage.scratch() as tables:
        sizes = storage.stored(own.groupBy(*_AT).agg(F.count(F.lit(1)).alias("_n")), "blocks")
        large = sizes.filter(F.col("_n") > MOST_IN_BLOCK).select(*_AT, F.ceil(F.col("_n") / MOST_IN_BLOCK).cast("int").alias("_parts"))
        if few:
            near = storage.stored(near.join(sizes, _AT, "left_semi"), "near_few")
        n = (sizes.agg(F.sum("_n")).first()[0] or 0) + (0 if t is None else near.count() if few else t.count())
        part = F.lit(0)
        if large.limit(1).count():  # at most one for MOST_IN_BLOCK source points
            part = F.pmod(F.xxhash64("id"), F.coalesce("_parts", F.lit(1))).cast("int")
            own = own.join(F.broadcast(large), _AT, "left")
            near = near.join(F.broadcast(large), _AT, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        else:
            near = near.withColumn("part", F.lit(0))
        place, more = ["id", *"xyz", *_AT], [f for f in s.schema if f.name not in ("id", *"xyz")]
        if t is None:
            asks = F.col("part") == part
            for c in "xyz":
                asks = asks & (F.col(f"b{c}") == block(f"k{c}"))
            rows = near.withColumn("asks", asks).select(*place, "part", "asks", *[F.when(F.col("asks"), F.col(f.name)).alias(f.name) for f in more])
        else:
            none = [F.lit(None).cast(f.dataType).alias(f.name) for f in more]
            rows = own.select(*place, part.alias("part"), F.lit(True).alias("asks"), *[f.name for f in more]).unionByName(near.select(*place, "part", F.lit(False).alias("asks"), *none))
        made, turns = [], max(1, -(-n // AT_ONCE))
        for i in range(turns):
            now = rows if turns == 1 else rows.filter(F.pmod(F.xxhash64(*_AT), F.lit(turns)) == i)
            made.append(storage.stored(now.groupBy(*_AT, "part").applyInArrow(run, schema), "near"))
        tables.keep(*made)
    return _all(made)


def _met_in_block(rows: pa.Table, cell: float, k: int, include_self: bool, own: bool):
    """(mask of the source rows, ids and places of the targets; and of the pairs the source, the target, the squared distance and the rank)."""
    ids, asks = rows.column("id").to_numpy(), rows.column("asks").to_numpy()
    xyz = np.column_stack([rows.column(c).to_numpy() for c in "xyz"])
    at = np.floor(xyz / cell).astype(np.int64)
    met = slice(None) if own else ~asks
    r, c, d2 = _near_in_cells(ids[asks], xyz[asks], at[asks], ids[met], xyz[met], at[met], k, include_self)
    return asks, ids[met], xyz[met], r, c, d2, np.arange(len(r)) - np.searchsorted(r, r) + 1


def _sure(r: np.ndarray, d2: np.ndarray, cell: float, want: int, n: int) -> np.ndarray:
    """Which of n points have ``want`` neighbours nearer than a cell (strictly, so that ties at exactly one cell are looked at again)."""
    return np.bincount(r[d2 < cell * cell], minlength=n) >= want


def _pairs_in_block(cell: float, k: int, below: float | None, include_self: bool, want: int, own: bool) -> Callable[[pa.Table], pa.Table]:
    """(id, nbr_id, rank, d2, x, y, z) of the k nearest; a point that is not sure of ``want`` of them is one row with its place instead."""

    def run(rows: pa.Table) -> pa.Table:
        asks, other, _, r, c, d2, rank = _met_in_block(rows, cell, k, include_self, own)
        ids, xyz = rows.column("id").to_numpy()[asks], np.column_stack([rows.column(c).to_numpy()[asks] for c in "xyz"])
        keep = rank <= k
        if below is not None:
            keep &= d2 < below
        r, c, d2, rank = r[keep], c[keep], d2[keep], rank[keep]
        sure = _sure(r, d2, cell, want, len(ids))
        keep = sure[r]
        r, c, d2, rank = r[keep], c[keep], d2[keep], rank[keep]
        more = np.flatnonzero(~sure)
        none = lambda kind: pa.nulls(len(more), kind)
        both = lambda a, kind: pa.chunked_array([pa.array(a, kind), none(kind)])
        place = [pa.chunked_array([pa.nulls(len(r), pa.float64()), pa.array(xyz[more, i])]) for i in range(3)]
        return pa.table([pa.chunked_array([pa.array(ids[r]), pa.array(ids[more])]), both(other[c], pa.int64()), both(rank, pa.int32()), both(d2, pa.float64()), *place], names=["id", "nbr_id", "rank", "d2", *"xyz"])

    return run


def _made_in_block(cell: float, k: int, include_self: bool, want: int, own: bool, made: Made, columns: list[str], names: list[str], carry: bool) -> Callable[[pa.Table], pa.Table]:
    """The source rows with what ``made`` gives of the k nearest; where a point is not sure of ``want`` of them, that is null and ``_sure`` false."""

    def run(rows: pa.Table) -> pa.Table:
        asks, other, place, r, c, d2, rank = _met_in_block(rows, cell, k, include_self, own)
        rows = rows.select(columns).filter(pa.array(asks))
        r, c, d2 = r[rank <= k], c[rank <= k], d2[rank <= k]
        sure = _sure(r, d2, cell, want, len(rows))
        keep = sure[r]
        number = np.cumsum(sure) - 1
        got = made(number[r[keep]], other[c[keep]], place[c[keep]], d2[keep], int(sure.sum()))
        spot = pa.array(np.where(sure, number, 0), mask=~sure)
        held = [rows.column(c) for c in columns]
        if not carry:  # only what is looked at again keeps its place
            held = [pc.if_else(pa.array(~sure), x, pa.scalar(None, x.type)) for x in held]
        return pa.table([*held, *[x.take(spot) for x in got], pa.array(sure)], names=[*columns, *names, "_sure"])

    return run


def _near_in_cells(sid: np.ndarray, q: np.ndarray, q_at: np.ndarray, tid: np.ndarray, t: np.ndarray, t_at: np.ndarray, k: int, include_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source row, target row, squared distance) of the k nearest in the 27 cells around each source, with all ties of the
    k-th; ordered by source row, distance and target id."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(q) or not len(t):
        return none
    low = np.minimum(q_at.min(axis=0), t_at.min(axis=0)) - 1
    size = np.maximum(q_at.max(axis=0), t_at.max(axis=0)) - low + 2
    name = lambda a: ((a[:, 0] - low[0]) * size[1] + a[:, 1] - low[1]) * size[2] + a[:, 2] - low[2]
    order = np.argsort(t_name := name(t_at), kind="stable")
    t, t_name = t[order], t_name[order]
    asked = np.argsort(q_name := name(q_at), kind="stable")
    here, first = np.unique(q_name[asked], return_index=True)
    first = np.append(first, len(q))
    # three cells along z follow each other
    column = here[:, None] + np.array([(i * size[1] + j) * size[2] for i in (-1, 0, 1) for j in (-1, 0, 1)])
    lo, hi = np.searchsorted(t_name, column - 1), np.searchsorted(t_name, column + 1, "right")
    found = []
    for n in range(len(here)):
        cand = np.concatenate([np.arange(a, b) for a, b in zip(lo[n], hi[n], strict=True) if b > a] or [none[0]])
        if not len(cand):
            continue
        p, m = t[cand], min(k, len(cand))
        for a in range(first[n], first[n + 1], step := max(1, _BLOCK // len(cand))):
            rows = asked[a : min(a + step, first[n + 1])]
            d = sum_squares(q[rows], p)
            if not include_self:
                d[sid[rows, None] == tid[order[cand]][None, :]] = np.inf
            edge = d.min(axis=1, keepdims=True) if m == 1 else np.partition(d, m - 1, axis=1)[:, m - 1 : m]
            r, c = np.nonzero((d <= edge) & np.isfinite(d))
            found.append((rows[r], order[cand[c]], d[r, c]))
    if not found:
        return none
    r, c, d2 = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((tid[c], d2, r))
    return r[order], c[order], d2[order]


def _inside(left: DataFrame, box, cell: float) -> bool:
    """Whether the cells around every remaining point cover the whole box of the target."""
    own = left.agg(*[f(c) for c in "xyz" for f in (F.min, F.max)]).first()
    return all(own[2 * i] is None or (own[2 * i + 1] - box[2 * i] < cell and box[2 * i + 1] - own[2 * i] < cell) for i in range(3))


def nn_join(source: DataFrame, target: DataFrame, *, pid: str = "pid", **kw) -> DataFrame:
    """(pid, nbr_id, d2) of the nearest target point of each source point."""
    return knn_join(source, target, 1, pid=pid, **kw).drop("rank")


def radius_join(source: DataFrame, target: DataFrame, below: float, *, pid: str = "pid", metric: Metric | None = None) -> DataFrame:
    """(pid, nbr_id, d2) of all pairs with a squared distance under ``below``: an equi-join on cells of its root."""
    size = float(np.sqrt(below))
    near = cells(_points(target, pid), size).select(F.col("id").alias("nbr_id"), *[F.col(c).alias(f"t{c}") for c in "xyz"], "kx", "ky", "kz")
    met = around(cells(_points(source, pid), size)).join(near, ["kx", "ky", "kz"])
    return met.withColumn("d2", _squared(metric)).filter(F.col("d2") < below).select(F.col("id").alias(pid), "nbr_id", "d2")


def grid_radius_join(source: DataFrame, target: DataFrame, size: float, at_most: float, *, pid: str = "pid") -> DataFrame:
    """As radius_join, but only within the 27 cells of a given size, and with the bound included."""
    near = cells(_points(target, pid), size).select(F.col("id").alias("nbr_id"), *[F.col(c).alias(f"t{c}") for c in "xyz"], "kx", "ky", "kz")
    met = around(cells(_points(source, pid), size)).join(near, ["kx", "ky", "kz"])
    return met.withColumn("d2", _squared(None)).filter(F.col("d2") <= at_most).select(F.col("id").alias(pid), "nbr_id", "d2")
