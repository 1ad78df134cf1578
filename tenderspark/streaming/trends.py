"""Event counts and sessions as streams with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(events: DataFrame, watermark: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def stream_counts(events: DataFrame, window: str = "1 day", slide: str | None = None, watermark: str = "2 hours") -> DataFrame:
    """(window_start, window_end, event_type, n); a window comes out once the watermark has passed it."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return _timed(events, watermark).groupBy(span, "event_type").agg(F.count(F.lit(1)).alias("n")) \
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n")


def stream_sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "2 hours") -> DataFrame:
    """(user_id, session_start, session_end, n): events of one user no further apart than `gap`."""
    return _timed(events, watermark).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")) \
        .select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def write_stream(df: DataFrame, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Append finished rows to a table until the source is drained."""
    return df.writeStream.outputMode("append").format("parquet").option("path", out_dir) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The windows that a run of `stream_counts` has left open, as its state holds them: with the emitted ones all counts so far."""
    return spark.read.format("statestore").load(checkpoint).select(
        F.col("key.window.start").alias("window_start"), F.col("key.window.end").alias("window_end"), "key.event_type", F.col("value.count").alias("n"))


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sessions that a run of `stream_sessions` has left open."""
    return spark.read.format("statestore").load(checkpoint).select(
        "value.user_id", F.col("value.session_window.start").alias("session_start"), F.col("value.session_window.end").alias("session_end"), F.col("value.count").alias("n"))
