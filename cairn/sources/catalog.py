"""The catalog of scan files: paths, epochs and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MARK = "Epoch_"


def epoch_of(path: Column, mark: str = MARK, digits: int = 3) -> Column:
    """The number of ``digits`` characters behind the mark in a file name; null where there is none."""
    at = F.instr(path, mark)
    return F.when(at > 0, F.substring(path, at + len(mark), F.lit(digits)).try_cast("bigint"))


def catalog(paths: DataFrame, path: str = "path", **kw) -> DataFrame:
    """scan_idx, epoch, path of the files that have an epoch, ascending by epoch and path.

    One row per file, so numbering them in one task is bounded by the number of scans.
    """
    found = paths.select(epoch_of(F.col(path), **kw).alias("epoch"), F.col(path).alias("path")).filter("epoch is not null")
    return found.select((F.row_number().over(Window.orderBy("epoch", "path")) - 1).cast("int").alias("scan_idx"), "epoch", "path")


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The files under a folder and its subfolders; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", F.col("length"), F.col("modificationTime"))
