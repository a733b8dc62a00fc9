"""Traces from a stream of events: sums per unit and window of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, width: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """(unit_id, start, value, n): sums of events(ts, user_id, value) per window; a
    window is final once the watermark, `late` behind, has passed its end. The same
    plan runs on a stream and on a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    held = timed.withWatermark("ts", late)
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = held.groupBy(span.alias("w"), F.col("user_id").alias("unit_id")).agg(F.sum("value").alias("value"), F.count("*").alias("n"))
    return out.select("unit_id", F.col("w.start").alias("start"), "value", "n")


def stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_trigger: int = 1) -> DataFrame:
    """The folder's event files as a stream."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(folder)


def start(traces: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write final windows to Parquet, exactly once, as far as there is input."""
    return traces.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
