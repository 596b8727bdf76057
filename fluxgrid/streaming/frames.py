"""Extension: event streams as frames that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def frame_sums(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Sum of values by user and window, closed once the watermark has passed."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return stamped.groupBy(F.window("at", width), F.col("user_id").cast("long").alias("pixel")).agg(F.sum("value").alias("v"), F.count("*").alias("n")).select("pixel", F.col("window.start").alias("start"), "v", "n")
