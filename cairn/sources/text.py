"""Text files of points (one per line) and of poses (blocks of lines)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT, COLOURED, ORIENTED = ("x", "y", "z"), ("x", "y", "z", "r", "g", "b"), ("x", "y", "z", "nx", "ny", "nz")


def read_points(spark: SparkSession, path: str, names: tuple[str, ...] = POINT) -> DataFrame:
    """Numbers parted by white space; further ones on a line are ignored.

    A line with too few numbers, or anything else, fails the whole read, as soon as it is reached.
    Colours are integers.
    """
    words = F.split(F.trim("value"), r"\s+")
    line = spark.read.text(path).filter(F.trim("value") != "")
    kind = lambda n: "int" if n in "rgb" else "double"
    got = line.select("value", *[F.try_element_at(words, F.lit(i + 1)).try_cast(kind(n)).alias(n) for i, n in enumerate(names)])
    broken = F.raise_error(F.concat(F.lit("malformed line: "), F.col("value")))
    return got.select(*[F.coalesce(F.col(n), broken.cast(kind(n))).alias(n) for n in names])


def write_points(points: DataFrame, path: str, names: tuple[str, ...] = POINT, digits: int = 12) -> None:
    """One line per point, numbers with ``digits`` significant digits."""
    each = [F.col(n).cast("string") if n in "rgb" else F.format_string(f"%.{digits - 1}e", F.col(n).cast("double")) for n in names]
    points.select(F.concat_ws(" ", *each).alias("value")).write.text(path)


def pose_lines(poses: DataFrame, key: str = "epoch", digits: int = 12, covariance: bool = True) -> DataFrame:
    """(epoch, value) one text block per pose: epoch, four lines of the matrix, and six of the covariance or none."""
    number = lambda c: F.format_string(f"%.{digits}f", c)
    line = lambda a, i, n: F.concat_ws(" ", *[number(F.get(a, F.lit(i * n + j))) for j in range(n)])
    block = [F.col(key).cast("string"), *[line("t", i, 4) for i in range(4)], *[line("vcm", i, 6) for i in range(6 if covariance else 0)]]
    return poses.select(F.col(key).alias("epoch"), F.concat_ws("\n", *block).alias("value"))


def write_poses(poses: DataFrame, path: str, key: str = "epoch", covariance: bool = True) -> None:
    """One file with the blocks in ascending order of epochs (a series has few of them)."""
    pose_lines(poses, key, covariance=covariance).coalesce(1).sortWithinPartitions("epoch").select("value").write.text(path)


def read_poses(spark: SparkSession, path: str, covariance: bool = True) -> DataFrame:
    """(epoch, t, vcm) by epoch, or (epoch, t) of blocks without covariance."""
    size = 11 if covariance else 5
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("i", "line"), F.xxhash64("value").alias("f"))
    # one file holds one series, a few lines per scan
    block = lines.groupBy("f", F.floor(F.col("i") / size).alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]).alias("b"))
    numbers = lambda lo, n: F.transform(F.filter(F.split(F.concat_ws(" ", F.slice("b", lo, n)), r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    out = [F.trim(F.get("b", F.lit(0))).cast("long").alias("epoch"), numbers(2, 4).alias("t")]
    return block.select(*out, *([numbers(6, 6).alias("vcm")] if covariance else []))


def write_pairs(pairs: DataFrame, path: str) -> None:
    """``src tgt`` per line."""
    pairs.select(F.concat_ws(" ", F.col("src_idx").cast("string"), F.col("tgt_idx").cast("string")).alias("value")).write.text(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    w = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(F.get(w, F.lit(0)).cast("long").alias("src_idx"), F.get(w, F.lit(1)).cast("long").alias("tgt_idx"))


def pair_report(epoch: int, mode: int, row) -> tuple[str, str]:
    """(file name, text) of one pair's report: matrix, angles, translation, covariance, deviations."""
    import numpy as np

    kind = "Direct2Ref" if mode == 0 else "Fixed" if mode > 0 else "Adaptive"
    t, vcm = np.array(row["t"]).reshape(4, 4), np.array(row["vcm"]).reshape(6, 6)
    gon = 200 / np.pi
    angles = np.array([np.arctan2(t[2, 1], t[2, 2]), -np.arcsin(np.clip(t[2, 0], -1, 1)), np.arctan2(t[1, 0], t[0, 0])]) * gon
    sd = np.sqrt(np.maximum(np.diag(vcm), 0)) * np.array([gon * 1000] * 3 + [1000] * 3)
    table = lambda a: "\n".join(" ".join(f"{x:.12f}" for x in r) for r in a)
    parts = [table(t), " ".join(f"{x:.10f}" for x in angles), " ".join(f"{x:.10f}" for x in t[:3, 3]), table(vcm), " ".join(f"{x:.6f}" for x in sd)]
    return f"{epoch}_{kind}_TransMatrix.txt", "\n\n".join(parts) + "\n"
