"""Streams of metric results: an extension beside the batch engine, which itself has no streams.

Files of (event_id, ts, metric, value) that runs append are rolled up by time windows, with late rows admitted up to
a watermark, and repeated events dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def rollup(events: DataFrame, window: str = "1 hour", late: str = "30 minutes", key: str = "event_type", value: str = "value", time: str = "ts") -> DataFrame:
    """Count, mean, least and most of each window and key."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
        .select(F.col("w.start").alias("window_start"), key, "n", "mean", "low", "high")
    )


def first_only(events: DataFrame, key: str = "event_id", late: str = "30 minutes", time: str = "ts") -> DataFrame:
    """Events without repeats of a key within the watermark; a stream's form of sharing a run in flight."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Process what there is into a table in memory; for tests and small rollups."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
