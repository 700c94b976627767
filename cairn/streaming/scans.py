"""Scans and events as streams: an extension, since scans otherwise come as a finished series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import epoch_of

POINTS = "pid bigint, x double, y double, z double"


def incoming(spark: SparkSession, folder: str, schema: str = POINTS, files_per_batch: int = 1) -> DataFrame:
    """A stream of the points of Parquet scans that appear under a folder, with the epoch of their file names."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(folder)
    return rows.withColumn("epoch", epoch_of(F.col("_metadata.file_path")))


def each_scan(points: DataFrame, register: Callable[[DataFrame, int], DataFrame], sink: str, checkpoint: str):
    """Run ``register(points of an epoch, epoch)`` on each new scan and append its rows to a Parquet table.

    A scan needs only the pose of its target, so results can be chained as they come.  A batch that is
    repeated after a failure replaces its own rows.
    """

    def batch(df: DataFrame, number: int) -> None:
        held = df.persist()
        for r in held.select("epoch").distinct().orderBy("epoch").collect():
            out = register(held.filter(F.col("epoch") == r["epoch"]).drop("epoch"), r["epoch"])
            out.write.mode("overwrite").parquet(f"{sink}/batch={number}/epoch={r['epoch']}")
        held.unpersist()

    return points.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, time: str, value: str, *, width: str = "1 day", late: str = "1 hour", keys: list[str] | None = None) -> DataFrame:
    """Count, mean and extremes per tumbling window (and keys); rows later than the watermark are left out."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, width), *(keys or []))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
        .select(F.col("window.start").alias("start"), *(keys or []), "n", "mean", "least", "most")
    )
