"""The streams, run over files that are there."""

from pyspark.sql import functions as F

from cairn.streaming import scans


def test_scans_are_registered_as_they_come(spark, tmp_path):
    for e in (1, 2, 3):
        spark.range(10 * e).selectExpr("id as pid", "rand(1) as x", "rand(2) as y", "rand(3) as z").coalesce(1).write.parquet(f"{tmp_path}/in/Epoch_00{e}")
    points = scans.incoming(spark, f"{tmp_path}/in")
    scans.each_scan(points, lambda p, epoch: p.agg(F.count(F.lit(1)).alias("n")), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = {(r["epoch"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, 10), (2, 20), (3, 30)}


def test_windows_equal_the_batch_result(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    batch.coalesce(1).write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/ev")
    q = scans.windowed(stream, "ts", "value", keys=["event_type"]).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    want = scans.windowed(batch, "ts", "value", keys=["event_type"])
    assert spark.table("days").exceptAll(want.select(*spark.table("days").columns)).count() == 0 and spark.table("days").count() == want.count() > 0
