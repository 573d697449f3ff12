"""Session settings and table access shared by the whole library."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "lectern", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution on; cluster settings stay as the submitter gave them."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of the scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """For work that costs far more than reading does: a table of few partitions is dealt to all cores. One that has as many partitions as there are cores stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def parts_for(spark: SparkSession, rows: int, each: int = 250_000) -> int:
    """Partitions for a repartition of so many rows: their number grows with the rows, so what a task sorts doesn't. Spark itself merges partitions up to a size in bytes, which may be millions of short rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def together(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """All rows of a key in one partition and in order, for a mapInPandas that goes through them.

    They are dealt by a hash of the key: after a join on the key itself Spark drops a repartition as repeated, and as mapInPandas asks for no
    distribution, it may then split the join's partitions or make it a broadcast that reads them as they come.
    """
    return df.repartition(F.xxhash64(*by)).sortWithinPartitions(*by, *order)


def folder_for(spark: SparkSession, what: str) -> str:
    """A new name below the folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a temporary folder will do for a master on this machine alone; anywhere else that is an error.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir isn't set: name a folder there that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-shared-"))
        shared = context.getCheckpointDir()
    return f"{str(shared).rstrip('/')}/{what}-{uuid.uuid4().hex}"


class Rounds:
    """Tables of an iterative plan: each call writes one, and reading it again doesn't repeat what made it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folders = spark, []

    def __call__(self, rows: DataFrame) -> DataFrame:
        self.folders.append(folder_for(self.spark, "round"))
        rows.write.parquet(self.folders[-1])
        return self.spark.read.schema(rows.schema).parquet(self.folders[-1])

    def drop(self, but: int = 0) -> None:
        """Deletes all tables but the newest ones."""
        for folder in self.folders[: len(self.folders) - but]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.folders = self.folders[len(self.folders) - but :]


@contextmanager
def rounds(spark: SparkSession) -> Iterator[Rounds]:
    """Rounds whose last table alone is left at the end: the result."""
    tables = Rounds(spark)
    try:
        yield tables
    except BaseException:
        tables.drop()
        raise
    tables.drop(but=1)
