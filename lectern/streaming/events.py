"""Structured Streaming forms of the event queries: feed, windows, first-of-key. Those with state and timers are in `stateful`.

Each takes a streaming DataFrame with the columns of `events` and returns one;
the caller chooses sink, trigger and checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the parquet files of a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def feed(events: DataFrame, after: int) -> DataFrame:
    """Events beyond an id, to resume from."""
    return events.where(F.col("event_id") > after)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    window = F.window("ts", width).alias("w")
    return events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_of_key(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Exactly one event of each id, for as long as the watermark holds its state."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
