"""Sharding by rendezvous hashing of stable record keys over weighted shards.

A record's key and a shard's number give a hash, read as u in (0, 1); the record goes to the
shard with the largest weight / -ln(u).  The law is ``key``: the id and the set of shards
alone decide, and adding a shard moves records only into the new one.

Everything is DataFrame expressions.  Shards are chosen without a shuffle.  Slots are numbered
within 4,096 hash buckets of every shard, and a bucket's first slot is the sum of the counts
before it, so no task ever holds a shard.  The bucket follows from the key, the size and the
checksum, so the different texts of one key, or of none, are spread over all of a shard's buckets.
Rows that agree in everything are counted before the shuffle and dealt out again behind it, so a
record that repeats very often costs one row.  The counted rows are written once and read twice; the
texts are read once.

Edge cases: a null key hashes as the word ``null``; a null text has size 1 and checksum 0;
repeated rows get slots of their own; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import storage

SHARDS = 16


def _digits(text: Column, first: int, count: int) -> Column:
    """Hexadecimal digits first .. first + count - 1 of the MD5 of a text, as a number."""
    return F.conv(F.substring(F.md5(text), first, count), 16, 10).cast("long")


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def cost(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight: the shard with the smallest takes the record."""
    u = (_digits(F.concat(key_text(key), F.lit(f"|{shard}")), 1, 13).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a key; of equal costs the lowest shard wins."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    best = F.least(*[F.struct(cost(key, s, w).alias("c"), F.lit(s).alias("s")) for s, w in enumerate(weights)]) if len(weights) > 1 else F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("s"))
    return best["s"]


def grown(key: Column, weights: list[float], added: float) -> Column:
    """(shard, shard with one more of weight ``added``), hashing the old shards once."""
    old = F.least(*[F.struct(cost(key, s, w).alias("c"), F.lit(s).alias("s")) for s, w in enumerate(weights)]) if len(weights) > 1 else F.struct(cost(key, 0, weights[0]).alias("c"), F.lit(0).alias("s"))
    more = F.struct(cost(key, len(weights), added).alias("c"), F.lit(len(weights)).alias("s"))
    return F.struct(old["s"].alias("shard"), F.least(old, more)["s"].alias("grown_shard"))


def assign(df: DataFrame, key: str, weights: list[float]) -> DataFrame:
    """The rows with their ``shard`` (replaced if there is one); no shuffle."""
    return df.withColumn("shard", rendezvous(F.col(key), weights))


def numbered(rows: DataFrame, group: str, bucket: str, order: list[str]) -> DataFrame:
    """One row per input row with ``slot``: its gapless number from 0 within ``group``.

    Numbers ascend by bucket, then by ``order``; rows equal in every column are interchangeable.
    """
    columns = rows.columns
    counted = storage.stored(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")), "counted")
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    sizes = counted.groupBy(group, bucket).agg(F.sum("_n").alias("_m"))
    first = sizes.withColumn("_first", F.coalesce(F.sum("_m").over(Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_m")
    start = placed.join(first, [group, bucket]).withColumn("_start", F.col("_first") + F.col("_before"))
    step = 1 << 16  # repeats are dealt out in two steps, so that no array is long
    blocks = start.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(step).cast("long"))))
    dealt = blocks.withColumn("_at", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + step, F.col("_n")) - 1)))
    return dealt.select(*columns, (F.col("_start") + F.col("_at")).alias("slot"))


def sharded(documents: DataFrame, weights: list[float], *, added: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    both = grown(F.col("doc_id"), weights, added)
    rows = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        both.alias("_both"),
    )
    mark = F.concat_ws("|", key_text(F.col("doc_id")), F.col("size").cast("string"), F.col("text_crc32").cast("string"))
    rows = rows.select("doc_id", "size", "text_crc32", F.col("_both.shard").alias("shard"), F.col("_both.grown_shard").alias("grown_shard"), _digits(mark, 1, 3).alias("_bucket"))
    out = numbered(rows, "shard", "_bucket", ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"), [1.0] * SHARDS)


#: The same rows in DuckDB, the checksum by its bitwise definition over the bytes.
OP2_SQL = f"""
with steps as (
  select i, list_reduce([i::bigint] || [0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) as v from range(256) r(i)
), tab as (select list(v order by i) as t from steps),
base as (
  select row_number() over () as row, doc_id, coalesce(text, '') as text, coalesce(cast(doc_id as varchar), 'null') as k from documents
), crc as (
  select row, doc_id, k, octet_length(encode(text)) + 1 as size,
    xor(4294967295, list_reduce([4294967295::bigint] || list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::bigint),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) as text_crc32
  from base, tab
), cost as (
  select crc.*, s, -ln((('0x' || substr(md5(k || '|' || s), 1, 13))::bigint::double + 0.5) / 4503599627370496.0) as c from crc, range({SHARDS + 1}) u(s)
), best as (
  select row, doc_id, size, text_crc32, k, arg_min(s, c) filter (where s < {SHARDS}) as shard, arg_min(s, c) as grown_shard
  from cost group by row, doc_id, size, text_crc32, k
)
select doc_id, cast(size as bigint) as size, text_crc32, 'key' as law, cast(shard as integer) as shard,
  row_number() over (partition by shard order by ('0x' || substr(md5(k || '|' || size || '|' || text_crc32), 1, 3))::bigint, doc_id, size, text_crc32) - 1 as slot,
  cast(grown_shard as integer) as grown_shard
from best
"""
