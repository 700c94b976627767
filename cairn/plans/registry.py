"""The registry of queries and their DuckDB SQL, and the point relations they run on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, label and the first three coordinates of the embeddings."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("pid"), "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])


def two_scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(source, target): all embeddings as points twice, by their first three coordinates and by the next three."""
    e = table(spark, sf_dir, "embeddings")
    return pts(spark, sf_dir), e.select(F.col("vec_id").alias("pid"), "label", *[F.col("embedding")[i + 3].cast("double").alias(c) for i, c in enumerate("xyz")])


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), F.col("embedding").cast("array<double>").alias("v"))


def li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"), "l_returnflag", "l_linestatus")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, epoch (days since 1970), type, and x = value, y = user, z = hour."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.unix_date(F.to_date("ts")).cast("long").alias("epoch"), "event_type", F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), F.hour("ts").cast("double").alias("z"))


PTS = "pts as (select vec_id as pid, label, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings)"
TGT = "tgt as (select vec_id as pid, label, embedding[4]::double as x, embedding[5]::double as y, embedding[6]::double as z from embeddings)"
SRC_TGT = f"{PTS}, src as (select * from pts), {TGT}"
VECS = "vecs as (select vec_id as pid, embedding::double[] as v from embeddings)"
LI = "li as (select l_quantity as x, l_extendedprice / 1000 as y, l_discount * 100 as z, l_returnflag, l_linestatus from lineitem)"
EV = "ev as (select event_id, date_diff('day', date '1970-01-01', ts::date)::bigint as epoch, event_type, value as x, user_id::double as y, hour(ts)::double as z from events)"
D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


def knn_sql(source: str, target: str, k: int, where: str = "true", name: str = "knn") -> str:
    """CTEs that end in ``name``: pid, nbr_id, rank, d2."""
    return (
        f"{name}_d as (select a.pid, b.pid as nbr_id, {D2} as d2 from {source} a, {target} b where {where}), "
        f"{name} as (select * from (select pid, nbr_id, d2, row_number() over (partition by pid order by d2, nbr_id) as rank from {name}_d) where rank <= {k})"
    )


def eigen_sql(source: str, name: str = "eig") -> str:
    """CTEs that add l1 >= l2 >= l3 of the matrix (xx, xy, xz, yy, yz, zz) to the rows of ``source``."""
    return f"""{name}_q as (select *, (xx + yy + zz) / 3 as q from {source}),
{name}_p as (select *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) as p,
  (xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz) as det from {name}_q),
{name}_f as (select *, acos(greatest(least(coalesce(det / nullif(2 * p * p * p, 0), 1.0), 1.0), -1.0)) / 3 as phi from {name}_p),
{name}_l as (select *, q + 2 * p * cos(phi) as l1, q + 2 * p * cos(phi + 2 * pi() / 3) as l3 from {name}_f),
{name} as (select *, 3 * q - l1 - l3 as l2 from {name}_l)"""


def normal_sql(source: str, name: str = "nrm") -> str:
    """CTEs that add the upright unit eigenvector (nx, ny, nz) of l3."""
    return f"""{name}_c as (select *,
  [xy * yz - xz * (yy - l3), xz * xy - (xx - l3) * yz, (xx - l3) * (yy - l3) - xy * xy] as c1,
  [xy * (zz - l3) - xz * yz, xz * xz - (xx - l3) * (zz - l3), (xx - l3) * yz - xy * xz] as c2,
  [(yy - l3) * (zz - l3) - yz * yz, yz * xz - xy * (zz - l3), xy * yz - (yy - l3) * xz] as c3 from {source}),
{name}_n as (select *, list_dot_product(c1, c1) as n1, list_dot_product(c2, c2) as n2, list_dot_product(c3, c3) as n3 from {name}_c),
{name}_b as (select *, case when n1 >= n2 and n1 >= n3 then c1 when n2 >= n3 then c2 else c3 end as cb, greatest(n1, n2, n3) as nb from {name}_n),
{name}_u as (select *, case when nb <= 0 then 0.0 else cb[1] / sqrt(nb) end as ux, case when nb <= 0 then 0.0 else cb[2] / sqrt(nb) end as uy, case when nb <= 0 then 1.0 else cb[3] / sqrt(nb) end as uz from {name}_b),
{name}_s as (select *, case when (case when abs(ux) >= abs(uy) and abs(ux) >= abs(uz) then ux when abs(uy) >= abs(uz) then uy else uz end) < 0 then -1.0 else 1.0 end as sg from {name}_u),
{name} as (select *, ux * sg as nx, uy * sg as ny, uz * sg as nz from {name}_s)"""


def moments_sql(source: str, key: str, name: str = "mom") -> str:
    """Count, centroid and population covariance of each group."""
    return (
        f"{name} as (select {key}, count(*) as n, avg(x) as cx, avg(y) as cy, avg(z) as cz, covar_pop(x, x) as xx, covar_pop(x, y) as xy, covar_pop(x, z) as xz, "
        f"covar_pop(y, y) as yy, covar_pop(y, z) as yz, covar_pop(z, z) as zz from {source} group by {key})"
    )


def r(e: str, name: str, digits: int = 6) -> str:
    return f"round({e}, {digits}) + 0.0 as {name}"
