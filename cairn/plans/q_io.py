"""Queries: tables written in a file format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import pcd, text
from . import storage
from .q_poses import _SRC, _T, _pairs
from .registry import PTS, pts, query, r, rounded


def _place(spark, name: str) -> str:
    return f"{storage.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("pcd_roundtrip", f"with {PTS} select pid, {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')} from pts")
def pcd_roundtrip(spark, sf):
    pcd.register(spark)
    where = _place(spark, "pcd")
    pts(spark, sf).drop("label").repartition(4, "pid").write.format("pcd").mode("append").option("path", where).save()
    got = spark.read.format("pcd").schema("pid bigint, x double, y double, z double").option("path", where).load()
    return got.select("pid", *[rounded(c).alias(c) for c in "xyz"])


@query("xyz_roundtrip", f"with {PTS} select {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')} from pts")
def xyz_roundtrip(spark, sf):
    where = _place(spark, "xyz")
    text.write_points(pts(spark, sf), where)
    return text.read_points(spark, where).select(*[rounded(c).alias(c) for c in "xyz"])


@query("xyz_oriented_roundtrip", f"with {PTS} select {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')}, {r('-y', 'nx')}, {r('x', 'ny')}, {r('z * 2', 'nz')} from pts")
def xyz_oriented_roundtrip(spark, sf):
    where = _place(spark, "xyz")
    p = pts(spark, sf).select("x", "y", "z", (-F.col("y")).alias("nx"), F.col("x").alias("ny"), (F.col("z") * 2).alias("nz"))
    text.write_points(p, where, text.ORIENTED)
    return text.read_points(spark, where, text.ORIENTED).select(*[rounded(c).alias(c) for c in text.ORIENTED])


@query("pose_series_roundtrip", f"with {_SRC}, {_T} select src_idx as epoch, {', '.join(r(f't[{i + 1}]', f't{i}') for i in range(12))}, {r('vcm[1]', 'v0')}, {r('vcm[36]', 'v35')} from ps")
def pose_series_roundtrip(spark, sf):
    where = _place(spark, "poses")
    text.write_poses(_pairs(spark, sf).withColumnRenamed("src_idx", "epoch"), where)
    p = text.read_poses(spark, where)
    return p.select("epoch", *[rounded(F.get("t", F.lit(i))).alias(f"t{i}") for i in range(12)], rounded(F.get("vcm", F.lit(0))).alias("v0"), rounded(F.get("vcm", F.lit(35))).alias("v35"))


@query("pair_sequence_roundtrip", f"with {_SRC} select src_idx, tgt_idx from src")
def pair_sequence_roundtrip(spark, sf):
    where = _place(spark, "pairs")
    text.write_pairs(_pairs(spark, sf), where)
    return text.read_pairs(spark, where)


@query("xyz_coloured_roundtrip", f"with {PTS} select {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')}, (pid % 256)::int as r, (pid * 7 % 256)::int as g, (label % 256)::int as b from pts")
def xyz_coloured_roundtrip(spark, sf):
    where = _place(spark, "xyz")
    text.write_points(pts(spark, sf).withColumns({"r": F.col("pid") % 256, "g": F.col("pid") * 7 % 256, "b": F.col("label") % 256}), where, text.COLOURED)
    return text.read_points(spark, where, text.COLOURED).select(*[rounded(c).alias(c) for c in "xyz"], "r", "g", "b")


@query("ground_truth_roundtrip", f"with {_SRC}, {_T} select src_idx as epoch, {', '.join(r(f't[{i + 1}]', f't{i}') for i in range(12))} from ps")
def ground_truth_roundtrip(spark, sf):
    """Poses without covariances."""
    where = _place(spark, "truth")
    text.write_poses(_pairs(spark, sf).withColumnRenamed("src_idx", "epoch"), where, covariance=False)
    p = text.read_poses(spark, where, covariance=False)
    return p.select("epoch", *[rounded(F.get("t", F.lit(i))).alias(f"t{i}") for i in range(12)])
