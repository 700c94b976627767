"""Order statistics, means and ranks with fixed conventions.

Order statistics pick elements by rank and never interpolate: ``percentile_element`` is
sorted[int(n * p)] counted from 0, the median is the upper one.  Ungrouped ones bracket the element
with approximate quantiles and count, so that no task sorts all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BRACKET = 10_000


def percentile_element(df: DataFrame, value: str, p: float, keys: list[str] | None = None, name: str = "value") -> DataFrame:
    """sorted[floor(n * p)] of each group (the last element for p = 1); nulls are ignored.

    With keys, ranks are taken within each group.  Without, two approximate quantiles
    bracket the rank and one pass counts what lies below, until at most ``BRACKET`` rows or few
    distinct values are left; only these, counted per value first, are sorted in one task.
    """
    rows = df.filter(F.col(value).isNotNull())
    if keys:
        order = Window.partitionBy(*keys).orderBy(value)
        whole = Window.partitionBy(*keys)
        ranked = rows.select(*keys, value, (F.row_number().over(order) - 1).alias("_r"), F.count(F.lit(1)).over(whole).alias("_n"))
        return ranked.filter(F.col("_r") == F.least(F.floor(F.col("_n") * F.lit(p)), F.col("_n") - 1)).select(*keys, F.col(value).alias(name))
    n = rows.count()
    kind = df.schema[value].dataType.simpleString()
    if not n:
        return df.sparkSession.createDataFrame([], f"{name} {kind}")
    rank, error = min(int(n * p), n - 1), 0.001
    tally, before = rows.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")), 0
    while n > BRACKET and error < 1:
        a, b = rows.approxQuantile(value, [max(0.0, (rank - before) / n - 2 * error), min(1.0, (rank - before) / n + 2 * error)], error)
        part = rows.filter(F.col(value).between(a, b))
        below, inside = rows.agg(F.count_if(F.col(value) < a), F.count_if(F.col(value).between(a, b))).first()
        if not before + below <= rank < before + below + inside:
            error *= 4  # missed: a wider bracket
            continue
        rows, tally, before = part, part.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")), before + below
        if a == b or inside > 0.9 * n:  # one value, or ties that no bracket parts: few distinct values are left
            break
        n = inside
    upto = F.sum("_c").over(Window.orderBy("_v"))
    return tally.withColumn("_upto", upto + before).filter(F.col("_upto") > rank).agg(F.min("_v").alias(name))


def upper_median(df: DataFrame, value: str, keys: list[str] | None = None, name: str = "median") -> DataFrame:
    """The element of rank n div 2."""
    return percentile_element(df, value, 0.5, keys, name)


def median_absolute_deviation(df: DataFrame, value: str, keys: list[str] | None = None, name: str = "mad") -> DataFrame:
    """Upper median of the distances to the upper median."""
    middle = upper_median(df, value, keys, "_m")
    joined = df.join(middle, keys) if keys else df.crossJoin(F.broadcast(middle))  # without keys: one row
    return upper_median(joined.withColumn("_d", F.abs(F.col(value) - F.col("_m"))), "_d", keys, name)


def mean_of(kind: str, value: Column) -> Column:
    """Aggregates: arithmetic, geometric, harmonic, contraharmonic, square, root_square."""
    if kind == "arithmetic":
        return F.avg(value)
    if kind == "geometric":
        return F.exp(F.avg(F.ln(value)))
    if kind == "harmonic":
        return F.try_divide(F.count(value).cast("double"), F.sum(F.try_divide(F.lit(1.0), value)))
    if kind == "contraharmonic":
        return F.try_divide(F.sum(value * value), F.sum(value))
    if kind == "square":
        return F.avg(value * value)
    if kind == "root_square":
        return F.sqrt(F.avg(value * value))
    raise ValueError(kind)


def ranks(df: DataFrame, value: str, tie: str, keys: list[str] | None = None) -> DataFrame:
    """The rows with four ranks from 0: competition, dense, ordinal (ties by ``tie``) and fractional."""
    order = Window.partitionBy(*(keys or [])).orderBy(value)
    same = Window.partitionBy(*(keys or []), value)
    return df.select(
        "*",
        (F.rank().over(order) - 1).alias("competition"),
        (F.dense_rank().over(order) - 1).alias("dense"),
        (F.row_number().over(Window.partitionBy(*(keys or [])).orderBy(value, tie)) - 1).alias("ordinal"),
        ((F.rank().over(order) - 1) + (F.count(F.lit(1)).over(same) - 1) / 2.0).alias("fractional"),
    )


def top_k(df: DataFrame, k: int, keys: list[str], order: list) -> DataFrame:
    """The first k rows of each group; the planner limits groups before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")
