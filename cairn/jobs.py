"""Whole jobs from a settings file to written results: a pair of scans, and a series of scans.

Scans are PCD files; results are written next to each other under a prefix, each as a folder of Spark's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as g
from .operators import filters, poses, series
from .plans import storage
from .sources import catalog, config, pcd, text


def _scan(spark: SparkSession, path: str) -> DataFrame:
    pcd.register(spark)
    return spark.read.format("pcd").load(path)


def _sizes(settings: config.Settings, target: DataFrame) -> tuple[float, float]:
    """(spacing, the sum of both patch sizes): given, or the mean spacing and ten times that for each scan."""
    if settings.manual_sizes:
        return max(settings.spacing1, settings.spacing2), settings.size1 + settings.size2
    spacing = filters.mean_spacing(target, "point_id").first()[0]
    if not spacing:
        raise ValueError("the scan has no spacing")
    return spacing, 20 * spacing


def _report(spark: SparkSession, prefix: str, epoch: int, mode: int, row) -> None:
    name, body = text.pair_report(epoch, mode, row)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(prefix + name)


def pair(spark: SparkSession, settings_path: str, prefix: str, key: str | None = None) -> DataFrame:
    """Align the second scan of the settings to the first: one row as ``series.register_pair`` gives it.

    Writes the pair's report and, as PCD, the second scan's own points at their new place.  ``key`` names a field of the
    scans with each point's patch; without it patches are supervoxels.
    """
    s = config.load(spark, settings_path)
    schema = "point_id long, x double, y double, z double" + (f", {key} long" if key else "")
    pcd.register(spark)
    target, source = (storage.stored(spark.read.format("pcd").schema(schema).load(p), "scan").withColumnRenamed("point_id", "pid") for p in (s.path1, s.path2))
    spacing, sizes = _sizes(s, target.withColumnRenamed("pid", "point_id"))
    got = storage.stored(series.register_pair(source, target, key=key, dt=s.dt_first if s.manual_threshold else None, dt_min=s.dt_least, sizes=sizes, leaf=spacing), "pose")
    row = got.first()
    _report(spark, prefix, 1, 0, row)
    moved = source.select("pid", *[v.alias(c) for v, c in zip(g.transform(g.vec(), list(row["t"])), "xyz", strict=True)])
    moved.write.format("pcd").mode("append").option("path", prefix + "registered").save()
    return got


def whole_series(spark: SparkSession, settings_path: str, *, start: int = 0, count: int | None = None, mode: int = -1, overlap: float = 0.75, key: str | None = None) -> DataFrame:
    """Align the scans of the settings' folder, in the order of their epochs, to the scan ``start``.

    ``mode`` as in ``series.register_series``.  Returns epoch, t, vcm and failed; writes under the settings'
    second path the poses (epoch, matrix, covariance) and the epochs that failed with the reason.
    """
    s = config.load(spark, settings_path)
    schema = "path string, point_id long, x double, y double, z double" + (f", {key} long" if key else "")
    pcd.register(spark)
    points = spark.read.format("pcd").schema(schema).load(s.path1).withColumn("epoch", catalog.epoch_of(F.col("path")))
    files = catalog.catalog(catalog.list_files(spark, s.path1, "*.pcd")).filter(F.col("scan_idx") >= start)
    files = files.select((F.col("scan_idx") - start).cast("long").alias("scan_idx"), "epoch")
    if count is not None:
        files = files.filter(F.col("scan_idx") < count)
    files = F.broadcast(storage.stored(files, "scans"))  # one row per scan
    points = storage.stored(points.join(files, "epoch").drop("path", "epoch").withColumnRenamed("point_id", "pid"), "points")
    spacing, sizes = _sizes(s, points.filter("scan_idx = 0").withColumnRenamed("pid", "point_id"))
    got = series.register_series(points, mode=mode, key=key, dt=s.dt_first if s.manual_threshold else None, dt_min=s.dt_least, sizes=sizes, leaf=spacing, overlap=overlap)
    out = storage.stored(got.join(files.withColumnRenamed("scan_idx", "src_idx"), "src_idx").select("epoch", "t", "vcm", "failed"), "poses")
    text.write_poses(out.filter("failed is null"), s.path2 + "TransMatrix_toRef", "epoch")
    out.filter("failed is not null").select(F.concat_ws(" ", F.col("epoch").cast("string"), "failed").alias("value")).coalesce(1).write.text(s.path2 + "failed")
    return out


def compared(spark: SparkSession, results: DataFrame, truth_path: str) -> DataFrame:
    """Absolute errors of the poses' parameters against a file of true poses."""
    truth = text.read_poses(spark, truth_path, covariance=False)
    return poses.absolute_errors(results.filter("t is not null").select("epoch", "t"), truth)
