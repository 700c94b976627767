"""Matrices as relations (i, j, v) of their entries, and small dense ones as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join on the inner index, then sum; sums are combined before the shuffle."""
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("p"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("q"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("v"))


def times_vector(a: DataFrame, x: DataFrame) -> DataFrame:
    """(i, v) of a matrix times a vector (i, v)."""
    right = x.select(F.col("i").alias("j"), F.col("v").alias("q"))
    return a.join(right, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("q")).alias("v"))


def vector_times(x: DataFrame, a: DataFrame) -> DataFrame:
    """(j, v) of a vector (i, v) times a matrix."""
    left = x.select("i", F.col("v").alias("q"))
    return a.join(left, "i").groupBy("j").agg(F.sum(F.col("v") * F.col("q")).alias("v"))


def identity(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def scaled(a: DataFrame, k: float) -> DataFrame:
    return a.select("i", "j", (F.col("v") * k).alias("v"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("i", "j").agg(F.sum("v").alias("v"))


def sub_matrix(a: DataFrame, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    """Entries of half-open ranges, counted from their beginnings."""
    inside = a.filter(F.col("i").between(rows[0], rows[1] - 1) & F.col("j").between(columns[0], columns[1] - 1))
    return inside.select((F.col("i") - rows[0]).alias("i"), (F.col("j") - columns[0]).alias("j"), "v")


def swap_rows(a: DataFrame, p: int, q: int) -> DataFrame:
    return a.select(F.when(F.col("i") == p, F.lit(q)).when(F.col("i") == q, F.lit(p)).otherwise(F.col("i")).alias("i"), "j", "v")


def swap_columns(a: DataFrame, p: int, q: int) -> DataFrame:
    return transpose(swap_rows(transpose(a), p, q))


def shape_tests(a: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row: is the matrix symmetric, and is it an upper Hessenberg matrix (missing entries are 0)?"""
    t = transpose(a).withColumnRenamed("v", "t")
    both = a.join(t, ["i", "j"], "left")
    return both.agg(
        F.coalesce(F.bool_and(F.abs(F.col("v") - F.coalesce("t", F.lit(0.0))) <= tolerance), F.lit(True)).alias("symmetric"),
        F.coalesce(F.bool_and((F.col("i") <= F.col("j") + 1) | (F.col("v") == 0)), F.lit(True)).alias("hessenberg"),
    )


def _rows(b: pa.RecordBatch, column: str, n: int) -> np.ndarray:
    return np.array(b.column(column).to_pylist(), np.float64).reshape(-1, n, n)


def eigenvalues(df: DataFrame, key: str, column: str, n: int) -> DataFrame:
    """(key, k, value): eigenvalues of symmetric n x n matrices in row-major arrays, descending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = np.linalg.eigvalsh(_rows(b, column, n))[:, ::-1]
                yield pa.RecordBatch.from_pydict({key: b.column(key).take(pa.array(np.repeat(np.arange(b.num_rows), n))), "k": pa.array(np.tile(np.arange(n, dtype=np.int32), b.num_rows)), "value": pa.array(v.ravel())})

    return df.select(key, column).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, k int, value double")


def balance(a: np.ndarray, base: float = 2.0) -> np.ndarray:
    """Powers of the base by which rows are divided and columns multiplied until their sizes agree within the base."""
    a, n = a.copy(), len(a)
    d = np.ones(n)
    moved = True
    while moved:
        moved = False
        for i in range(n):
            column = np.abs(a[:, i]).sum() - abs(a[i, i])
            row = np.abs(a[i]).sum() - abs(a[i, i])
            if not column or not row:
                continue
            f = float(base ** np.round(np.log(row / column) / (2 * np.log(base))))
            if f != 1 and (column * f + row / f) < 0.95 * (column + row):
                d[i] *= f
                a[:, i] *= f
                a[i] /= f
                moved = True
    return d


def balanced(df: DataFrame, key: str, column: str, n: int) -> DataFrame:
    """(key, k, factor): the balancing factors of n x n matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = np.array([balance(x) for x in _rows(b, column, n)])
                yield pa.RecordBatch.from_pydict({key: b.column(key).take(pa.array(np.repeat(np.arange(b.num_rows), n))), "k": pa.array(np.tile(np.arange(n, dtype=np.int32), b.num_rows)), "factor": pa.array(v.ravel())})

    return df.select(key, column).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, k int, factor double")
