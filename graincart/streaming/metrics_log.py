"""Metric logs and events as streams. An extension: nothing of it is needed for a batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = "global_step bigint, loss double, learning_rate double, logged_at timestamp"


def metrics_stream(spark: SparkSession, folder: str, schema: str = METRICS) -> DataFrame:
    """The rows appended to a folder of JSONL metric logs."""
    return spark.readStream.schema(schema).json(folder)


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows by window and `by`; rows later than `late` behind the newest are dropped, which bounds the state."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), by, "n")


def first_deliveries_stream(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The first of the rows with one key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
