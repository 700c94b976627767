"""Whole jobs over small scans of facets with a known motion."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn import jobs
from cairn.operators import alignment, series
from cairn.plans import storage
from cairn.plans.q_cluster import facets
from cairn.sources import pcd, text

SETTINGS = "a: {}\nb: {}\nc: 1\nd: 0.005\ne: 0.005\nf: 0.1\ng: 0.1\nh: 1\ni: 0.05\nj: 0.004\nk: 0\n"


def truth(k):
    """The pose that brings epoch k back to epoch 0."""
    a = 0.002 * k
    there = np.array([[math.cos(a), -math.sin(a), 0, 0.003 * k], [math.sin(a), math.cos(a), 0, -0.002 * k], [0, 0, 1, 0.001 * k], [0, 0, 0, 1]])
    return np.linalg.inv(there)


@pytest.fixture(scope="module")
def scans(spark, sf, tmp_path_factory):
    """Three epochs of 36 facets, a PCD file each with the facets' labels."""
    folder = tmp_path_factory.mktemp("scans")
    f = storage.stored(facets(spark, sf, 2).filter("label % 15 < 6 and label < 90"))
    for k in range(3):
        got = f.filter(F.col("scan_idx") == k).orderBy("pid").toPandas()
        (folder / f"scan_Epoch_{k + 1:03d}.pcd").write_bytes(pcd.render({c: got[c].to_numpy() for c in ("label", "x", "y", "z")}))
    return folder


def test_a_pair_without_labels(spark, tmp_path):
    """Three faces of a box, seen twice; patches are supervoxels; the report and the moved points are written."""
    r = np.random.default_rng(8)
    u, v = (x.ravel() for x in np.meshgrid(np.arange(18) * 0.05, np.arange(18) * 0.05))
    o = np.zeros_like(u)
    faces = np.vstack([np.column_stack(c) for c in ((u, v, o), (u, o, v), (o, u, v))]) + 0.02
    a = 0.008
    there = np.array([[math.cos(a), -math.sin(a), 0, 0.01], [math.sin(a), math.cos(a), 0, -0.008], [0, 0, 1, 0.006], [0, 0, 0, 1]])
    for k, t in ((1, np.eye(4)), (2, there)):
        q = alignment.moved(faces, t) + r.normal(size=faces.shape) * 0.0008
        (tmp_path / f"scan_{k}.pcd").write_bytes(pcd.render(dict(zip("xyz", q.T, strict=True))))
    settings = SETTINGS.format(tmp_path / "scan_1.pcd", tmp_path / "scan_2.pcd").replace("0.005", "0.02").replace("f: 0.1\ng: 0.1", "f: 0.3\ng: 0.3").replace("0.004", "0.008")
    (tmp_path / "s.txt").write_text(settings)
    row = jobs.pair(spark, str(tmp_path / "s.txt"), f"{tmp_path}/out-").first()
    t = np.array(row["t"]).reshape(4, 4)
    assert np.abs(t @ there - np.eye(4)).max() < 2e-3
    assert 0.5 < row["stable_ratio"] <= 1.0
    report = "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/out-1_Direct2Ref_TransMatrix.txt").collect())
    assert np.isclose(float(report.split()[0]), t[0, 0])
    was = {r["point_id"]: (r["x"], r["y"], r["z"]) for r in spark.read.format("pcd").load(f"{tmp_path}/scan_2.pcd").collect()}
    now = spark.read.format("pcd").schema("pid long, x double, y double, z double").load(f"{tmp_path}/out-registered").collect()
    assert len(now) == len(was) and all(np.allclose(t @ [*was[r["pid"]], 1], [r["x"], r["y"], r["z"], 1]) for r in now)


@pytest.mark.parametrize("mode", [0, 1, -1])
def test_a_series(spark, scans, tmp_path, mode):
    (tmp_path / "s.txt").write_text(SETTINGS.format(scans, f"{tmp_path}/out-"))
    got = {r["epoch"]: r for r in jobs.whole_series(spark, str(tmp_path / "s.txt"), mode=mode, key="label").collect()}
    assert set(got) == {2, 3} and all(r["failed"] is None for r in got.values())
    for k in (1, 2):
        assert np.abs(np.array(got[k + 1]["t"]).reshape(4, 4) - truth(k)).max() < 2e-3
    written = {r["epoch"]: r["t"] for r in text.read_poses(spark, f"{tmp_path}/out-TransMatrix_toRef").collect()}
    assert all(np.allclose(written[k], got[k]["t"], atol=1e-10) for k in got)
    true = spark.createDataFrame([(k + 1, [float(x) for x in truth(k).ravel()]) for k in (1, 2)], "epoch long, t array<double>")
    text.write_poses(true, f"{tmp_path}/truth", covariance=False)
    errors = jobs.compared(spark, spark.createDataFrame([(r["epoch"], r["t"]) for r in got.values()], "epoch long, t array<double>"), f"{tmp_path}/truth").collect()
    assert len(errors) == 2 and all(r["err_tz"] < 2 for r in errors)


@pytest.mark.parametrize("mode, want", [(0, {1: 0, 2: 0, 3: 0, 4: 0}), (2, {1: 0, 2: 0, 3: 1, 4: 2}), (-1, {1: 0, 2: 0, 3: 1, 4: 3})])
def test_targets_and_chains_of_the_modes(spark, monkeypatch, mode, want):
    """Which scans are aligned to which, and what the chains give, with poses that only move along x."""
    asked = {}

    def register(source, target, *_):
        s, t = (int(round(d.agg(F.min("y")).first()[0] * 10)) for d in (source, target))
        asked[s] = t
        pose = np.eye(4)
        pose[0, 3] = s - t
        return [float(x) for x in pose.ravel()], [0.0] * 36, 1.0, [0.1]

    monkeypatch.setattr(series, "_register", register)
    shift = {0: 0.0, 1: 0.1, 2: 0.2, 3: 1.15, 4: 2.0}  # of a line of points: how far scans overlap
    rows = [(k, 100 * k + i, i / 10 + shift[k] * 10, k / 10, 0.0) for k in shift for i in range(100)]
    points = spark.createDataFrame(rows, "scan_idx int, pid long, x double, y double, z double")
    monkeypatch.setattr(series.poses, "overlaps", lambda *_: spark.createDataFrame([(1, 0, 0.9), (2, 0, 0.85), (2, 1, 0.9), (3, 0, 0.5), (3, 1, 0.81), (3, 2, 0.9), (4, 0, 0.1), (4, 1, 0.2), (4, 2, 0.3), (4, 3, 0.4)], "src_idx long, tgt_idx long, ratio double"))
    got = {r["src_idx"]: r for r in series.register_series(points, mode=mode, dt_min=0.1, sizes=0.2).collect()}
    assert asked == want
    assert all(np.isclose(got[k]["t"][3], k) and got[k]["failed"] is None for k in want)


def test_series_prepares_each_scan_once(spark, monkeypatch):
    """Of three pairs in a row, two scans are in two of them."""
    made, before = [], series.prepared
    monkeypatch.setattr(series, "prepared", lambda *a: made.append(1) or before(*a))
    points = spark.createDataFrame([(k, i, 0.1 * i, 0.0, 0.0, i % 2) for k in range(4) for i in range(9)], "scan_idx int, pid long, x double, y double, z double, label long")
    got = series.register_series(points, mode=1, key="label", dt=0.1, dt_min=0.1, sizes=0.2).collect()
    assert len(made) == 4 and sorted(r["src_idx"] for r in got) == [1, 2, 3] and all(r["failed"] for r in got)


def test_point_to_plane_query(spark, sf):
    """The query's pose against the known motion and against plain least squares over all pairs."""
    import __spark_entry__ as registry

    got = np.array([r["row"] for r in sorted(registry.queries()["icp_point_to_plane"](spark, sf).collect(), key=lambda r: r["i"])])
    assert np.allclose(got[3], [0, 0, 0, 1]) and np.allclose(got[:3, :3] @ got[:3, :3].T, np.eye(3), atol=1e-9)
    assert np.abs(got - truth(1)).max() < 0.15  # a fifth of the facets have risen, and all take part


def test_point_to_plane_of_many_patches(spark, sf, monkeypatch):
    """The ways for larger tables give the pose of the collected ones, and collect no source patch."""
    import __spark_entry__ as registry

    run = lambda: np.array([r["row"] for r in sorted(registry.queries()["icp_point_to_plane"](spark, sf).collect(), key=lambda r: r["i"])])
    want = run()
    monkeypatch.setattr(alignment, "MOST_PATCHES", 0)
    monkeypatch.setattr(alignment, "icp", None)
    assert np.allclose(run(), want, atol=1e-8)


def test_nearest_around_is_exact():
    rng = np.random.default_rng(3)
    t = np.vstack([rng.random((3000, 3)) * [9, 9, 0.1], [(50, 0, 0)]])
    for q in (rng.random((80, 3)), rng.random((80, 3)) * 30, np.array([(-40.0, 3, 3)])):
        index, d2 = alignment._nearest_around(q, t, 0.2)
        d = ((q[:, None] - t[None]) ** 2).sum(axis=2)
        assert (index == d.argmin(axis=1)).all() and np.allclose(d2, d.min(axis=1))


def test_pose_vcm_query(spark, sf):
    """Row by row from the sums of all pairs, found without the library."""
    import __spark_entry__ as registry

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    q, p = (np.array([r["embedding"][a : a + 3] for r in rows], float) for a in (0, 3))
    label = np.array([r["label"] for r in rows])
    normal = np.empty_like(p)
    for k in set(label):
        v = np.linalg.eigh(np.cov(p[label == k].T, bias=True))[1][:, 0]
        normal[label == k] = v * np.sign(v[np.abs(v).argmax()])
    ids = np.array([r["vec_id"] for r in rows])
    d = ((q[:, None] - p[None]) ** 2).sum(axis=2)
    near = np.array([min(range(len(p)), key=lambda j: (d[i, j], ids[j])) for i in range(len(q))])
    a = np.hstack([np.cross(q, normal[near]), normal[near]])
    l = ((p[near] - q) * normal[near]).sum(axis=1)  # noqa: E741
    x, *_ = np.linalg.lstsq(a, l, rcond=None)
    want = ((a @ x - l) ** 2).sum() / (len(q) - 6) * np.linalg.inv(a.T @ a)
    got = np.array([r["row"] for r in sorted(registry.queries()["pose_vcm"](spark, sf).collect(), key=lambda r: r["i"])])
    assert np.allclose(got, want, rtol=1e-6, atol=1e-15)
    assert alignment.covariance(a.T @ a, a.T @ l, float(l @ l), len(l)).shape == (6, 6)
