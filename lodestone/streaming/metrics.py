"""Structured Streaming over metric events and jobs.

Late rows: a watermark of ten minutes; a window's figures are written once when the watermark has passed it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.relational import upsert


def metric_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, metric, n, avg) by tumbling window."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), F.col("event_type").alias("metric"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg")).select(F.col("w.start").alias("start"), "metric", "n", "avg")


def hourly_rate(events: DataFrame, per_hour: int = 100, late: str = "10 minutes") -> DataFrame:
    """(start, user_id, n): users over a limit of events an hour."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return by.where(F.col("n") > per_hour).select(F.col("w.start").alias("start"), "user_id", "n")


#: What follows a job's state on an event.
MOVES = {("pending", "start"): "processing", ("processing", "finish"): "completed", ("processing", "fail"): "failed", ("pending", "cancel"): "cancelled", ("processing", "cancel"): "cancelled", ("failed", "retry"): "pending"}


def job_states(changes: DataFrame) -> DataFrame:
    """(job_id, state, refused): the state of each job after a batch of changes (job_id, seq, change); changes that do not apply are refused."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, refused = state.get if state.exists else ("pending", 0)
        for change in pd.concat(parts).sort_values("seq")["change"]:
            now, refused = (MOVES[now, change], refused) if (now, change) in MOVES else (now, refused + 1)
        state.update((now, refused))
        yield pd.DataFrame({"job_id": [key[0]], "state": [now], "refused": [refused]})

    return changes.groupBy("job_id").applyInPandasWithState(run, "job_id long, state string, refused long", "state string, refused long", "update", GroupStateTimeout.NoTimeout)


def upsert_batches(stream: DataFrame, target: str, key: list[str], order: str, checkpoint: str):
    """Starts a query that puts each batch's changes into the newest version of a table of numbered folders under target."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{target}/v{number - 1}") if number else None
        latest = upsert(batch.limit(0) if before is None else before, batch, key, F.col(order))
        latest.write.mode("overwrite").parquet(f"{target}/v{number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
