"""The metric log as a stream (an extension: batch jobs only append to it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def daily(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """(day, event_type, n, total) in tumbling windows of a day; with a watermark late rows are dropped and windows close."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        rows = rows.withWatermark("ts", watermark)
    each = rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return each.select(F.col("w.start").cast("date").alias("day"), "event_type", "n", "total")


def run_to_end(frame: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Process everything that is there, then stop; the result is a table at ``path``, written by the executors.

    A batch that is run again after a failure writes the same folder again.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    q = frame.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def resume(todo: DataFrame, done: DataFrame, key: str = "utterance_id") -> DataFrame:
    """What is left of a job whose results are appended as they come."""
    return todo.join(done.select(key), key, "left_anti")


def progress(done: int, total: int, before: int, seconds: float) -> dict:
    """Rate and remaining seconds from what this session did, not from what it found."""
    rate = (done - before) / seconds if seconds > 0 else 0.0
    return {"rate": rate, "eta_s": (total - done) / rate if rate > 0 else None}
