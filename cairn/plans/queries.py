"""All queries of the engine outside the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, voxels
from . import q_cluster, q_geometry, q_io, q_near, q_patches, q_points, q_poses, q_stats  # noqa: F401
from .registry import QUERIES, SQL, pts

__all__ = ["QUERIES", "SQL", "entry"]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downsampled, outlier-free points per label."""
    v = voxels.downsample(pts(spark, sf_dir), 0.05, ["label"]).withColumn("pid", F.xxhash64("label", "kx", "ky", "kz"))
    return filters.remove_outliers(v).groupBy("label").agg(F.count(F.lit(1)).alias("n_points"))
