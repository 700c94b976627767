"""Operators against numpy and hand-made cases."""

import math
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.functions import geometry as g
from cairn.operators import alignment, filters, matrices, neighbours, normals, order, patches, poses, series, stats, supervoxels
from cairn.operators.graph import connected_components
from cairn.plans import storage
from cairn.plans.q_cluster import facets
from cairn.sources import config, pcd, text

POINTS = "pid long, x double, y double, z double"


def table(spark, xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], POINTS)


@pytest.mark.parametrize("n, k", [(200, 5), (30, 45), (1, 3)])
@pytest.mark.parametrize("cell", [None, 0.05])
def test_grid_neighbours_equal_brute_force(spark, n, k, cell):
    xyz = np.round(np.random.default_rng(n).normal(size=(n, 3)), 1)  # many ties
    p = table(spark, xyz)
    brute = sorted(map(tuple, neighbours.knn_join(p, p, k).collect()))
    grid = sorted(map(tuple, neighbours.knn_join(p, p, k, small=0, cell=cell).collect()))
    d = neighbours.sum_squares(xyz, xyz)
    want = sorted((i, int(j), r + 1, float(d[i, j])) for i in range(n) for r, j in enumerate(np.lexsort((np.arange(n), d[i]))[:k]))
    assert brute == grid == want


def test_block_of_many_points_is_parted(spark, monkeypatch):
    """Each part of a block's points meets all targets around the block, and points without near targets go on."""
    monkeypatch.setattr(neighbours, "MOST_IN_BLOCK", 50)
    xyz = np.vstack([np.round(np.random.default_rng(5).random((200, 3)), 1), [(40, 0, 0), (0, -30, 2)]])
    p = table(spark, xyz)
    for k, kw in ((1, {}), (6, {"include_self": False}), (4, {"below": 0.02})):
        assert sorted(map(tuple, neighbours.knn_join(p, p, k, small=0, **kw).collect())) == sorted(map(tuple, neighbours.knn_join(p, p, k, **kw).collect()))


def test_neighbours_of_far_and_missing_points(spark):
    t = table(spark, [(0, 0, 0), (1, 0, 0)])
    s = spark.createDataFrame([(7, 100.0, 0.0, 0.0), (8, None, 0.0, 0.0)], POINTS)
    for small in (0, 100):
        assert [tuple(r) for r in neighbours.nn_join(s, t, small=small).collect()] == [(7, 1, 99.0**2)]
        assert neighbours.knn_join(s, t.limit(0), 3, small=small).count() == 0


def test_radius_is_strict_and_grid_radius_is_not(spark):
    p = table(spark, [(0, 0, 0), (0.5, 0, 0)])
    assert neighbours.radius_join(p, p, 0.25).count() == 2
    assert neighbours.grid_radius_join(p, p, 0.5, 0.25).count() == 4


def test_degenerate_normals(spark):
    clouds = {"line": [(i, 2 * i, 0) for i in range(6)], "same": [(1, 1, 1)] * 5, "one": [(3, 2, 1)], "plane": [(x, y, 0) for x in range(5) for y in range(5)]}
    rows = [(name, i, *map(float, p)) for name, pts in clouds.items() for i, p in enumerate(pts)]
    m = {r["k"]: r for r in normals.planes(spark.createDataFrame(rows, "k string, " + POINTS), ["k"]).collect()}
    for r in m.values():
        assert math.isclose(r["nx"] ** 2 + r["ny"] ** 2 + r["nz"] ** 2, 1)
    assert (m["same"]["nx"], m["same"]["ny"], m["same"]["nz"]) == (0, 0, 1)
    assert abs(m["plane"]["nz"]) == 1
    assert abs(m["line"]["nx"] + 2 * m["line"]["ny"]) < 1e-6


def test_a_perfect_plane_loses_all_points(spark):
    p = table(spark, [(x, y, 0) for x in range(6) for y in range(6)]).withColumn("k", F.lit(1))
    assert patches.refined(p, ["k"]).count() == 0


def test_eigenvalues_equal_numpy(spark):
    r = np.random.default_rng(2)
    rows = [(i, j, *map(float, p)) for i in range(20) for j, p in enumerate(r.normal(size=(30, 3)) * r.uniform(0.1, 3, 3))]
    got = normals.with_normal(normals.with_eigenvalues(normals.moments(spark.createDataFrame(rows, "k int, " + POINTS), ["k"]))).collect()
    for row in got:
        c = np.cov(np.array([q[2:] for q in rows if q[0] == row["k"]]).T, bias=True)
        v, w = np.linalg.eigh(c)
        assert np.allclose([row["l3"], row["l2"], row["l1"]], v)
        assert abs(abs(w[:, 0] @ [row["nx"], row["ny"], row["nz"]]) - 1) < 1e-8


@pytest.mark.parametrize("n", [1, 2, 4, 30_000])
def test_percentile_elements(spark, n):
    values = np.random.default_rng(n).permutation(n).astype(float)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for p in (0.0, 0.25, 0.75, 1.0):
        assert stats.percentile_element(df, "v", p).first()[0] == sorted(values)[min(int(n * p), n - 1)]
    assert stats.upper_median(df, "v").first()[0] == sorted(values)[n // 2]


def test_percentile_of_nothing(spark):
    assert stats.percentile_element(spark.createDataFrame([(None,)], "v double"), "v", 0.5).count() == 0


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(500)] + [(5000, 5000), (None, 3)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0, 1000, 5000} and sum(v == 0 for v in got.values()) == 301 and sum(v == 1000 for v in got.values()) == 501
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_edges_are_solved_at_once(spark, monkeypatch):
    """Both ways give the same rows; the one for few edges writes the edges and the result, however long the paths are."""
    rng = np.random.default_rng(8)
    ends = [(int(x), int(y)) for x, y in rng.integers(-60, 60, size=(70, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, None), (-2000, -2000)]
    edges = spark.createDataFrame(ends, "p long, q long")
    rounds = sorted(map(tuple, connected_components(edges, "p", "q", few=0).collect()))
    written, stored = [], storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, name="table": written.append(name) or stored(df, name))
    assert sorted(map(tuple, connected_components(edges, "p", "q").collect())) == rounds
    assert len(written) == 2 and len(rounds) == len({x for e in ends for x in e if None not in e})
    known = stored(edges.select("p", "q"))
    written.clear()
    assert sorted(map(tuple, connected_components(known, "p", "q").collect())) == rounds and len(written) == 1  # the edges are not written again


@pytest.mark.parametrize(
    "start, bb, lod, d75, want",
    [
        (dict(dt=0.05), 0.1, 0.004, 0.03, (0.03, False, False)),  # stage 1 lowers the threshold
        (dict(dt=0.02), 0.1, 0.004, 0.03, (0.02 * 0.8, True, False)),  # stage 2 begins inside stage 1: the ratio is 1
        (dict(dt=0.05), 0.001, 0.004, 0.03, (0.05 * 0.8, True, False)),  # little movement begins stage 2; B1 / B2 is 1
        (dict(dt=0.04, stage2=True, b1=0.3, b2=1.0), 0.1, 0.004, 0.0, (0.02, True, False)),
        (dict(dt=0.04, stage2=True, b1=0.6, b2=1.0), 0.1, 0.004, 0.0, (0.024, True, False)),
        (dict(dt=0.04, stage2=True, b1=0.6, b2=0.0), 0.1, 0.004, 0.0, (0.032, True, False)),
        (dict(dt=0.004, stage2=True), 0.1, 0.004, 0.0, (0.004, True, True)),
        (dict(dt=0.005, stage2=True, b1=0.1, b2=1.0), 0.1, 0.004, 0.0, (0.004, True, False)),
    ],
)
def test_threshold_steps(start, bb, lod, d75, want):
    s = alignment.Thresholds(dt_min=0.004, **start)
    s.update(bb, lod, lambda: d75)
    assert (round(s.dt, 9), s.stage2, s.stage3) == (round(want[0], 9), *want[1:])
    assert s.b1 == bb or s.stage3


def test_alignment_recovers_a_pose(spark, sf):
    f = facets(spark, sf)
    got = series.register_pair(f.filter("scan_idx = 1"), f.filter("scan_idx = 0"), key="label", dt=0.05, dt_min=0.004, sizes=0.2).first()
    t = np.array(got["t"]).reshape(4, 4)
    a = 0.002
    moved = np.array([[math.cos(a), -math.sin(a), 0, 0.003], [math.sin(a), math.cos(a), 0, -0.002], [0, 0, 1, 0.001], [0, 0, 0, 1]])
    assert np.abs(t @ moved - np.eye(4)).max() < 1e-3
    assert 0.7 < got["stable_ratio"] < 0.9
    v = np.array(got["vcm"]).reshape(6, 6)
    assert np.allclose(v, v.T) and np.linalg.eigvalsh(v).min() > -1e-12
    assert all(x >= y for x, y in zip(got["dt"][:-1], got["dt"][1:], strict=True))


def test_every_part_is_a_facet(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet").count()
    f = facets(spark, sf)
    n = f.groupBy("scan_idx", "label").count().collect()
    assert len(n) == 2 * parts and {r["count"] for r in n} == {36}
    spots = {(round(r["x"] / 0.2), round(r["y"] / 0.2)) for r in f.filter("scan_idx = 0 and pid = label * 100").collect()}
    assert len(spots) == parts and max(max(s) for s in spots) <= math.ceil(math.sqrt(parts))


def test_nearest_by_cells_equals_brute_force():
    r = np.random.default_rng(5)
    for t in (r.normal(size=(500, 3)), np.round(r.normal(size=(500, 3)), 1), r.normal(size=(400, 3)) * [30, 20, 0.01]):
        q = np.concatenate([t + r.normal(size=t.shape) * 0.1, t[:50], r.normal(size=(20, 3)) * 100])
        for a, b in zip(alignment.nearest(q, t), alignment.nearest(q, t, brute=0), strict=True):
            assert (a == b).all()


def test_too_few_patches(spark):
    p = table(spark, np.random.default_rng(1).normal(size=(50, 3))).withColumn("k", F.lit(1))
    with pytest.raises(alignment.AlignmentError):
        alignment.align(p, p, "k", dt=1.0, dt_min=0.1, sizes=1.0)


def test_chain_equals_products(spark):
    r = np.random.default_rng(3)
    target = {1: 0, 2: 0, 3: 1, 4: 3, 5: 4, 6: 2}
    t = {i: alignment.pose(r.normal(size=6) * 0.2) for i in target}
    v = {i: (lambda m: m @ m.T)(r.normal(size=(6, 6))) for i in target}
    df = spark.createDataFrame([(i, target[i], t[i].ravel().tolist(), v[i].ravel().tolist()) for i in target], "src_idx long, tgt_idx long, t array<double>, vcm array<double>")
    whole, spread = {0: np.eye(4)}, {0: np.zeros((6, 6))}
    for i in sorted(target):
        p = whole[target[i]]
        s = np.array([[0, -p[2, 3], p[1, 3]], [p[2, 3], 0, -p[0, 3]], [-p[1, 3], p[0, 3], 0]])
        ad = np.block([[p[:3, :3], np.zeros((3, 3))], [s @ p[:3, :3], p[:3, :3]]])
        whole[i], spread[i] = p @ t[i], spread[target[i]] + ad @ v[i] @ ad.T
    for row in poses.chained(df).collect():
        assert np.allclose(np.array(row["t"]).reshape(4, 4), whole[row["src_idx"]])
        assert np.allclose(np.array(row["vcm"]).reshape(6, 6), spread[row["src_idx"]])


def test_no_pose_without_a_target(spark):
    pose = [float(x) for x in np.eye(4).ravel()]
    pairs = spark.createDataFrame([(2, 1, pose, [0.0] * 36), (3, 2, pose, [0.0] * 36), (4, 0, pose, [0.0] * 36), (5, 4, pose, [0.0] * 36)], "src_idx long, tgt_idx long, t array<double>, vcm array<double>")
    assert sorted(r["src_idx"] for r in poses.chained(pairs).collect()) == [4, 5]


def test_failed_pairs_are_reported(spark, monkeypatch):
    def register(source, target, *_):
        if target.first()["x"] == 0:
            raise alignment.AlignmentError("fewer than four patches")
        return [float(x) for x in np.eye(4).ravel()], [0.0] * 36, 1.0, [0.1]

    monkeypatch.setattr(series, "_register", register)
    points = spark.createDataFrame([(k, k, float(k), 0.0, 0.0) for k in range(3)], "scan_idx int, " + POINTS)
    got = {r["src_idx"]: r for r in series.register_series(points, mode=1, dt_min=0.1, sizes=0.2).collect()}
    assert got[1]["t"] is None and got[1]["failed"] == "fewer than four patches"
    assert got[2]["t"] is None and got[2]["failed"].endswith("scan 1")


def test_alignment_on_tables(spark, sf, monkeypatch):
    f = storage.stored(facets(spark, sf).filter("label % 15 < 5 and label < 75"))
    s, t = (f.filter(F.col("scan_idx") == k).drop("scan_idx") for k in (1, 0))
    run = lambda: alignment.align(s, t, "label", dt=0.004, dt_min=0.004, sizes=0.2, rounds=2)
    want = run()
    monkeypatch.setattr(alignment, "MOST_PATCHES", 0)
    got = run()
    assert np.allclose(got.transform, want.transform, atol=1e-8) and np.allclose(got.vcm, want.vcm, rtol=1e-3, atol=1e-12)
    assert got.stable_ratio == want.stable_ratio and [h["stage"] for h in got.history] == [h["stage"] for h in want.history]


def test_adaptive_targets_never_go_back(spark):
    ratios = spark.createDataFrame([(1, 0, 0.9), (2, 0, 0.1), (2, 1, 0.9), (3, 0, 0.99), (3, 1, 0.2), (3, 2, 0.3), (4, 2, 0.9), (4, 3, 0.95)], "src_idx long, tgt_idx long, ratio double")
    assert [tuple(r) for r in poses.adaptive_targets(ratios, 0.8).collect()] == [(1, 0), (2, 1), (3, 2), (4, 2)]


def test_euler_angles_at_the_poles(spark):
    cases = [(0.1, 0.2, 0.3), (0.4, math.pi / 2, 0.0), (-0.4, -math.pi / 2, 0.0)]
    for c in cases:
        m = alignment.rotation(*c)
        if abs(abs(c[1]) - math.pi / 2) < 1e-12:
            m[2, 0] = -1.0 if c[1] > 0 else 1.0
        row = spark.range(1).select(*[v.alias(n) for v, n in zip(g.euler_angles([F.lit(float(x)) for x in m.ravel()]), "xyz", strict=True)]).first()
        assert np.allclose(list(row), c, atol=1e-9)


def _plain_supervoxels(xyz, nrm, near, size, groups):
    """The rounds of ``supervoxels.merged`` and ``supervoxels.settled`` over all pairs."""
    n = len(xyz)
    far = 1 - np.abs(nrm @ nrm.T) + 0.4 * np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2)) / size
    touching = {(i, j) for i in range(n) for j in near[i]} | {(j, i) for i in range(n) for j in near[i]}
    weight, into = {i: 1 for i in range(n)}, {}
    price = max(float(np.sort([min(far[i, j] for j in near[i]) for i in range(n)])[n // 2]), 1e-12)
    while len(weight) > groups:
        asked = {}
        for a, b in touching:
            asked[b] = min(asked.get(b, (math.inf, -1)), (weight[b] * far[a, b], a))
        if not asked:
            break
        least = min(asked.values())[0]
        if least >= price:
            price *= 2.0 ** max(1, math.floor(math.log2(least / price)) + 1)
        cheap = {b: x for b, x in asked.items() if x[0] < price}
        ahead = {b: (d, a) for b, (d, a) in cheap.items() if a not in cheap or (d, b) < (cheap[a][0], a)}
        granted = sorted((d, b, a) for b, (d, a) in ahead.items() if a not in ahead)[: len(weight) - groups]
        if len(granted) < 0.1 * len(weight):
            price *= 2
        for _, b, a in granted:
            into[b] = a
        for _, b, a in granted:
            weight[a] += weight.pop(b)
        touching = {(into.get(a, a) if a not in weight else a, into.get(b, b) if b not in weight else b) for a, b in touching}
        touching = {(a, b) for a, b in touching if a != b}

    def end(i):
        return end(into[i]) if i in into else i

    label = np.array([end(i) for i in range(n)])
    merged, fresh = label.copy(), set(range(n))
    while fresh:
        moves = {}
        for i in range(n):
            best = min(((far[label[j], i], label[j]) for j in near[i] if j in fresh), default=(math.inf, -1))
            if best[0] < far[label[i], i]:
                moves[i] = best[1]
        for i, to in moves.items():
            label[i] = to
        fresh = set(moves)
    return merged, label


def test_supervoxels_against_all_pairs(spark):
    r = np.random.default_rng(4)
    xyz = np.vstack([r.normal(size=(70, 3)) * 0.1, r.normal(size=(50, 3)) * [0.3, 0.3, 0.01] + 5])  # unconnected
    p = table(spark, xyz)
    held, near = supervoxels.oriented(p, 8)
    at = {x["pid"]: [x["nx"], x["ny"], x["nz"]] for x in held.collect()}
    nrm = np.array([at[i] for i in range(len(xyz))])
    beside = [[] for _ in xyz]
    for x in near.collect():
        beside[x["pid"]].append(x["nbr_id"])
    for size, groups in ((0.3, 12), (0.3, 1)):
        merged, label = _plain_supervoxels(xyz, nrm, beside, size, groups)
        found = storage.stored(supervoxels.merged(held, near, size, groups))
        assert {x["pid"]: x["sv_id"] for x in found.collect()} == dict(enumerate(merged.tolist()))
        assert len(set(merged.tolist())) == max(2, groups)  # the two parts do not connect
        assert {x["pid"]: x["sv_id"] for x in supervoxels.settled(held, near, found, size).collect()} == dict(enumerate(label.tolist()))


def test_supervoxels_of_few_edges_merge_at_once(spark, monkeypatch):
    """From every round on, one task goes on as the tables do; it writes one table for all its rounds."""
    r = np.random.default_rng(6)
    xyz = np.round(np.vstack([r.normal(size=(50, 3)) * 0.1, r.normal(size=(40, 3)) * [0.3, 0.3, 0.02] + 5]), 2)
    held, near = supervoxels.oriented(table(spark, xyz), 7)
    n = near.unionByName(near.select(F.col("nbr_id").alias("pid"), F.col("pid").alias("nbr_id"))).distinct().count()
    label = lambda groups, few: {x["pid"]: x["sv_id"] for x in supervoxels.merged(held, near, 0.3, groups, few=few).collect()}
    rounds = {groups: label(groups, 0) for groups in (9, 1)}
    assert label(9, n // 2) == rounds[9]
    written, stored = [], storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, name="table": written.append(name) or stored(df, name))
    assert {groups: label(groups, None) for groups in (9, 1)} == rounds
    assert written.count("granted") == 2 and "asked" not in written


def test_supervoxels_are_a_partition(spark):
    r = np.random.default_rng(4)
    xyz = np.vstack([r.normal(size=(60, 3)) * 0.1, r.normal(size=(60, 3)) * 0.1 + 5])  # unconnected
    got = supervoxels.fused(table(spark, xyz), 1.0, k=8).collect()
    label = {x["pid"]: x["sv_id"] for x in got}
    assert len(label) == 120 and not {label[i] for i in range(60)} & {label[i] for i in range(60, 120)}
    assert sorted(set(label.values())) == list(range(len(set(label.values()))))
    assert not supervoxels.fused(table(spark, np.zeros((0, 3))), 1.0).count()
    assert len({x["sv_id"] for x in supervoxels.fused(table(spark, np.ones((5, 3))), 1.0).collect()}) == 1


@pytest.mark.parametrize("n", [0, 1, 700])
def test_numbers_without_gaps(spark, n):
    rows = spark.range(n).select(F.col("id").alias("pid"), F.expr("id % 3").alias("v"))
    got = sorted((x["place"], x["v"], x["pid"]) for x in order.numbered(rows, ["v", F.desc("pid")], "place").collect())
    want = sorted(((i % 3, i) for i in range(n)), key=lambda x: (x[0], -x[1]))
    assert got == [(k, *x) for k, x in enumerate(want)]


def test_percentiles_of_ties(spark):
    for expr in ("id % 3", "0", "id", "case when id < 29000 then 7 else id end"):
        rows = spark.range(30_000).select(F.expr(expr).cast("double").alias("v"))
        values = np.sort([x["v"] for x in rows.collect()])
        for p in (0.0, 0.5, 0.75, 1.0):
            assert [x["value"] for x in stats.percentile_element(rows, "v", p).collect()] == [values[min(int(30_000 * p), 29_999)]]


def test_outliers(spark):
    xyz = np.vstack([np.random.default_rng(5).normal(size=(100, 3)), [[50, 50, 50]]])
    kept = {r["pid"] for r in filters.remove_outliers(table(spark, xyz), 5, 2.7).select("pid").collect()}
    assert 100 not in kept and len(kept) >= 95
    assert filters.remove_outliers(table(spark, xyz[:1]), 5, 2.7).count() == 1


def test_matrix_helpers(spark):
    a = np.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])
    coo = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(3) for j in range(2)], "i int, j int, v double")
    dense = lambda d, s: (lambda m: [m.__setitem__((r["i"], r["j"]), r["v"]) for r in d.collect()] and m)(np.zeros(s))
    assert np.allclose(dense(matrices.multiply(matrices.transpose(coo), coo), (2, 2)), a.T @ a)
    assert np.allclose(dense(matrices.swap_rows(coo, 0, 2), (3, 2)), a[[2, 1, 0]])
    assert np.allclose(dense(matrices.sub_matrix(coo, (1, 3), (0, 1)), (2, 1)), a[1:3, :1])
    skewed = np.array([[1.0, 1e4], [1e-4, 2.0]])
    d = matrices.balance(skewed)
    even = skewed * d[None, :] / d[:, None]
    assert abs(np.log2(abs(even[0, 1] / even[1, 0]))) <= 2


SETTINGS = "a: /data/scans\nb: /data/out/\nc: 1\nd: 0.005\ne: 0.005\nf: 0.05\ng: 0.05\nh: 1\ni: 0.05\nj: 0.004\nk: 0\n"


def test_settings(spark, tmp_path):
    s = config.parse(SETTINGS)
    assert (s.path1, s.size1, s.dt_least, s.visual) == ("/data/scans", 0.05, 0.004, False)
    (tmp_path / "s.txt").write_text(SETTINGS)
    assert config.load(spark, str(tmp_path / "s.txt")) == s
    for wrong in (SETTINGS.replace("d: 0.005", "d: 0"), SETTINGS.replace("f: 0.05", "f: 5"), SETTINGS.replace("i: 0.05", "i: 0.001"), SETTINGS.replace("c: 1", "c:"), "a: b"):
        with pytest.raises(ValueError):
            config.parse(wrong)


def test_pcd_formats(spark, tmp_path):
    head = "# a comment\nVERSION .7\nFIELDS x y z intensity\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA "
    (tmp_path / "a.pcd").write_text(head + "ascii\n1 2 3 9\n4 5 6 9\n")
    (tmp_path / "b.pcd").write_bytes((head + "binary\n").encode() + np.array([[7, 8, 9, 1], [1, 1, 1, 1]], "<f4").tobytes())
    pcd.register(spark)
    got = spark.read.format("pcd").load(str(tmp_path))
    assert sorted((r["x"], r["y"], r["z"]) for r in got.collect()) == [(1, 1, 1), (1, 2, 3), (4, 5, 6), (7, 8, 9)]
    assert {r["point_id"] for r in got.collect()} == {0, 1}
    with pytest.raises(ValueError):
        pcd.parse((head + "ascii\n1 2 3 9\n").encode())


def test_compressed_pcd(spark, tmp_path):
    head = b"VERSION .7\nFIELDS x y z\nSIZE 8 8 8\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 40\nHEIGHT 1\nPOINTS 40\nDATA binary_compressed\n"
    points = np.column_stack([np.zeros(40), np.arange(40.0), np.full(40, 7.5)])
    plain = points.T.astype("<f8").tobytes()
    packed = b"\x00\x00" + b"\xe0" + bytes([319 - 9]) + b"\x00" if 319 - 9 < 256 else b"\x00\x00\xe0\xff\x00" + b"\xe0" + bytes([319 - 264 - 9]) + b"\x00"
    rest = plain[320:]
    packed += b"".join(bytes([len(rest[i : i + 32]) - 1]) + rest[i : i + 32] for i in range(0, len(rest), 32))
    assert pcd.unpacked(packed, len(plain)) == plain
    (tmp_path / "c.pcd").write_bytes(head + np.array([len(packed), len(plain)], "<u4").tobytes() + packed)
    pcd.register(spark)
    got = spark.read.format("pcd").load(str(tmp_path)).orderBy("point_id").select("x", "y", "z").collect()
    assert np.array_equal(np.array(got), points)
    with pytest.raises(ValueError, match="before"):
        pcd.unpacked(b"\x20\x00", 3)


def test_malformed_points_fail(spark, tmp_path):
    (tmp_path / "p.xyz").write_text("1 2 3 extra\n\n4 5 6\n")
    assert text.read_points(spark, str(tmp_path / "p.xyz")).count() == 2
    (tmp_path / "q.xyz").write_text("1 2 3\n4 five 6\n")
    with pytest.raises(Exception, match="malformed"):
        text.read_points(spark, str(tmp_path / "q.xyz")).collect()


def test_pair_report():
    name, body = text.pair_report(7, -1, {"t": np.eye(4).ravel().tolist(), "vcm": np.eye(6).ravel().tolist()})
    assert name == "7_Adaptive_TransMatrix.txt" and body.count("\n") > 10


def _written(spark, monkeypatch):
    """(name, rows) of every table that is stored from now on, and the folders that still exist."""
    made, stored = [], storage.stored

    def keep(df, name="table"):
        out = stored(df, name)
        made.append((name, out.count(), out.columns, out._stored_at.removeprefix("file://")))
        return out

    monkeypatch.setattr(storage, "stored", keep)
    return made


def test_registration_writes_points_not_pairs(spark, sf, monkeypatch):
    """No table has more rows than a scan has points (the 14 neighbours of each point are not written), and all are deleted."""
    monkeypatch.setattr(neighbours, "SMALL", 100)
    f = storage.stored(facets(spark, sf).filter("label % 15 < 5 and label < 75"))
    run = lambda: series.register_pair(f.filter("scan_idx = 1"), f.filter("scan_idx = 0"), key="label", dt=0.05, dt_min=0.004, sizes=0.2).first()
    want = run()
    made = _written(spark, monkeypatch)
    monkeypatch.setattr(neighbours, "AT_ONCE", 400)  # exchanges in turns
    got = run()
    n = f.filter("scan_idx = 0").count()
    assert max(rows for _, rows, _, _ in made) <= n and {"near", "accepted"} <= {name for name, _, _, _ in made}
    assert not [at for *_, at in made if os.path.exists(at)]
    assert np.allclose(got["t"], want["t"], atol=1e-9) and got["stable_ratio"] == want["stable_ratio"] and np.allclose(got["dt"], want["dt"])


def test_series_deletes_a_scan_after_its_last_pair(spark, sf, monkeypatch):
    f = storage.stored(facets(spark, sf, 3).filter("label % 15 < 5 and label < 75"))
    run = lambda: sorted(map(tuple, series.register_series(f, key="label", mode=1, dt=0.05, dt_min=0.004, sizes=0.2).collect()))
    want, register, seen = run(), series._register, []
    made = _written(spark, monkeypatch)
    monkeypatch.setattr(series, "_register", lambda *a: seen.append(sum(os.path.exists(at) for name, *_, at in made if name == "prepared")) or register(*a))
    monkeypatch.setattr(neighbours, "AT_ONCE", 400)
    got = run()
    assert seen == [2, 2, 2]
    for a, b in zip(got, want, strict=True):
        assert a[0] == b[0] and np.allclose(a[1], b[1], atol=1e-9) and a[3] == b[3] is None
    assert not [at for name, *_, at in made if name != "chain" and os.path.exists(at)]


@pytest.mark.parametrize("many", [30_000, 50])
@pytest.mark.parametrize("turn", [4_000_000, 90])
def test_made_of_neighbours_equals_pairs(spark, monkeypatch, many, turn):
    """What is made in the blocks against the same of all pairs, with carried columns, far points and points without a place."""
    monkeypatch.setattr(neighbours, "MOST_IN_BLOCK", many)
    monkeypatch.setattr(neighbours, "AT_ONCE", turn)
    xyz = np.vstack([np.round(np.random.default_rng(5).random((200, 3)), 1), [(40, 0, 0), (0, -30, 2)]])
    p = table(spark, xyz).withColumn("part", F.concat(F.lit("p"), "pid")).unionByName(spark.createDataFrame([(900, None, 0.0, 0.0, "none")], POINTS + ", part string"))
    last = lambda row, ids, places, d2, n: [pa.array(ids[np.searchsorted(row, np.arange(n), "right") - 1]), pa.array(np.bincount(row, d2, minlength=n).astype(float))]
    for k, own in ((1, True), (6, False), (300, True)):
        got = {r["pid"]: (r["nbr"], round(r["total"], 9)) for r in neighbours.with_nearest(p, k, last, "nbr long, total double", include_self=own).collect() if r["part"] == f"p{r['pid']}"}
        pairs = neighbours.knn_join(p, p, k, include_self=own).groupBy("pid").agg(F.max_by("nbr_id", "rank").alias("nbr"), F.sum("d2").alias("total"))
        assert got == {r["pid"]: (r["nbr"], round(r["total"], 9)) for r in pairs.collect()} and len(got) == 202
    far = neighbours.with_nearest(p.filter("pid < 90"), 1, last, "nbr long, total double", target=p.filter("pid >= 90"), carry=False)
    want = neighbours.knn_join(p.filter("pid < 90"), p.filter("pid >= 90"), 1)
    assert far.columns == ["nbr", "total"] and sorted(map(tuple, far.collect())) == sorted((r["nbr_id"], r["d2"]) for r in want.collect())
    assert neighbours.with_nearest(p.limit(0), 3, last, "nbr long, total double").count() == 0


def test_outliers_by_blocks(spark, monkeypatch):
    xyz = np.vstack([np.random.default_rng(5).normal(size=(300, 3)), [[50, 50, 50]]])
    p = table(spark, xyz).unionByName(spark.createDataFrame([(900, None, 0.0, 0.0)], POINTS))
    want = sorted(r["pid"] for r in filters.remove_outliers(p, 5, 2.7).collect())
    monkeypatch.setattr(neighbours, "SMALL", 0)
    got = filters.remove_outliers(p, 5, 2.7)
    assert got.columns == p.columns and sorted(r["pid"] for r in got.collect()) == want and 300 not in want and 900 in want


def test_supervoxels_write_no_pairs(spark, monkeypatch):
    """Lists of neighbours instead of pairs, edges in turns, and tables of past rounds deleted; the same groups."""
    xyz = np.random.default_rng(7).random((150, 3)) * [3, 2, 0.3]
    p = table(spark, xyz)
    run = lambda: {x["pid"]: x["sv_id"] for x in supervoxels.fused(p, 0.6, 8).collect()}
    monkeypatch.setattr(supervoxels, "FEW_EDGES", 100)
    want, made = run(), _written(spark, monkeypatch)
    monkeypatch.setattr(neighbours, "SMALL", 50)
    monkeypatch.setattr(supervoxels, "AT_ONCE", 700)
    assert run() == want
    assert max(rows for name, rows, *_ in made if name == "near") <= 150 and len([1 for name, *_ in made if name == "touching"]) > 3
    assert not [name for name, *_, at in made if name in ("touching", "groups", "asked", "nearest") and os.path.exists(at)]
