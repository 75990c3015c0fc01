from pyspark.sql import functions as F

from lodestone.streaming import metrics as M
from tests.conftest import SF


def test_windows_equal_the_batch_result(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = M.metric_stream(spark, str(tmp_path / "in"), events.schema.simpleString()[7:-1].replace(":", " "))
    q = M.windowed(stream, "1 day").writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start, r.metric): r.n for r in spark.table("w").collect()}
    want = {(r.start, r.metric): r.n for r in events.groupBy(F.window("ts", "1 day").start.alias("start"), F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_upserts(spark, tmp_path):
    spark.createDataFrame([(1, "a", 1), (2, "b", 1), (1, "c", 2)], "id long, v string, at long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, v string, at long").parquet(str(tmp_path / "in"))
    M.upsert_batches(stream, str(tmp_path / "t"), ["id"], "at", str(tmp_path / "c")).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t" / "v0")).select("id", "v").collect()} == {(1, "c"), (2, "b")}
