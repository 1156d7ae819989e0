"""Structured Streaming: growth, sessions and the indexing queue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.storage import new_folder, new_state


def daily_growth(stream: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Rows a UTC day and type; state of a day is dropped once the watermark passes it."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def sessions(stream: DataFrame, who: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Stretches of activity of one identity without a pause of ``gap``."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    grouped = timed.groupBy(F.session_window(ts, gap), who).agg(F.count("*").alias("n"))
    return grouped.select(who, F.unix_millis("session_window.start").alias("start_ms"), F.unix_millis("session_window.end").alias("end_ms"), "n")


def drained(result: DataFrame, name: str) -> DataFrame:
    """Runs a streaming aggregate over everything there is now and returns its final table.

    For replays: results are kept whole ('complete'), each micro-batch's in Parquet files, and the last one is read; the driver holds nothing.
    """
    spark, folder = result.sparkSession, new_folder(result.sparkSession, name)
    batches: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{number}")
        batches.append(number)

    options = {"checkpointLocation": f"{folder}-state"}
    new_state(spark, options["checkpointLocation"])
    result.writeStream.outputMode("complete").foreachBatch(keep).options(**options).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/{max(batches)}") if batches else spark.createDataFrame([], result.schema)


def appended(result: DataFrame, path: str, checkpoint: str):
    """Appends every window once its watermark has passed to Parquet files, and drops its state; gives the running query.

    For live streams: rows later than the watermark are not counted, windows still open are not there yet.
    """
    return result.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def queue_worker(jobs: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Handles every appended job exactly once in micro-batches: the batch's checkpoint is the claim.

    ``work(batch, number)`` embeds and merges by key, so a repeated batch changes nothing.
    """
    return jobs.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
