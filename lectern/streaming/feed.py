"""A resumable feed: batches of a stream in folders named by their number, and what a reader has not seen yet.

A batch that is run again after a crash overwrites its own folder, so each row is there once. A
folder counts from the moment its writer has finished it.
"""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lectern.session import folder_for

NUMBER = re.compile(r"batch=(\d+)")


def written(batch: DataFrame, number: int, sink: str) -> None:
    batch.write.mode("overwrite").parquet(f"{sink}/batch={number:012d}")


def deliver(rows: DataFrame, sink: str, checkpoint: str, available_now: bool = False, every: str = "1 second") -> StreamingQuery:
    """Starts the feed of a stream into sink; started again with the same checkpoint it goes on where it stopped."""
    writer = rows.writeStream.foreachBatch(lambda batch, number: written(batch, number, sink)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def _finished(spark: SparkSession, sink: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(sink)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [PurePosixPath(f.getPath().getName()).name for f in fs.listStatus(path)]
    whole = [n for n in names if NUMBER.fullmatch(n) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/{n}/_SUCCESS"))]
    return sorted(int(NUMBER.fullmatch(n)[1]) for n in whole)


def since(spark: SparkSession, sink: str, schema: str, last: int = -1) -> tuple[DataFrame, int]:
    """The rows of the batches after `last` with their batch, and the number to go on from."""
    new = [n for n in _finished(spark, sink) if n > last]
    if not new:
        return spark.createDataFrame([], f"{schema}, batch long"), last
    rows = spark.read.schema(schema).option("basePath", sink).parquet(*(f"{sink}/batch={n:012d}" for n in new))
    return rows.withColumn("batch", F.col("batch").cast("long")), new[-1]


def drained(rows: DataFrame, sink: str | None = None) -> DataFrame:
    """All that a stream gives for what is there now, as a table."""
    spark = rows.sparkSession
    sink = sink or folder_for(spark, "feed")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    deliver(rows, f"{sink}/rows", f"{sink}/checkpoint", available_now=True).awaitTermination()
    return since(spark, f"{sink}/rows", schema)[0].drop("batch")
