"""Streaming forms (inventory 2.12): the same expressions over a stream as over a table, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """ST1: a folder of event files as a stream, some files at a time."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """ST3: rows and sums by window and type; on a stream, rows later than `late` are left out."""
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "2 hours") -> DataFrame:
    """ST4: runs of a user's events with pauses below gap."""
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, *keys: str, late: str = "2 hours") -> DataFrame:
    """ST7: the first row of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))


def running_maxima(samples: DataFrame, key: str, *values: str) -> DataFrame:
    """ST5: the largest value of each measure so far, by what is watched; on a stream a line is sent again when it rises."""
    return samples.groupBy(key).agg(*[F.max(v).alias(f"max_{v}") for v in values])


def alerts(samples: DataFrame, value: str, limit: float) -> DataFrame:
    """ST6: the samples beyond a limit, as they come."""
    return samples.filter(F.col(value) > limit)


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain what is there now into a memory table; for tests and small reports."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
