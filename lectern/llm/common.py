"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks, as the contracts state them.
BLANKS = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a temporary folder will do for a master on this machine alone, as in tests; anywhere else
    executors couldn't read each other's files there, so that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir isn't set: name a folder there that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-shared-"))
        folder = context.getCheckpointDir()
    return folder


#: Spark then deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files: their results are in tables, so nothing reads these again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


#: The folders that `checkpointed` has written in the innermost open scope.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """The tables that operators write inside are deleted at the end: results must have been read or written by then.

    Operators delete what has no later reader themselves; what their results still read stays until the scope ends.
    """
    own: list[str] = []
    outer = _written.set(own)
    try:
        yield
    finally:
        _written.reset(outer)
        for folder in own:
            _delete(spark, folder)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` gives as a table; all other tables that were written for it are deleted."""
    with intermediates(spark):
        done = checkpointed(make())
        path = _written.get().pop()
    _note(path)
    return done


def _note(folder: str) -> None:
    if _written.get() is not None:
        _written.get().append(folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, and read again after executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lectern-{uuid.uuid4().hex}"
    _note(path)
    with shuffles_cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes what `checkpointed` wrote, after the last reader of these tables has been written itself."""
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if folder.rsplit("/", 1)[-1].startswith("lectern-"):
                _delete(table.sparkSession, folder)


def fresh(name: str, *taken: DataFrame) -> str:
    """A column name like `name` that none of these frames has."""
    used = {c.lower() for df in taken for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_struct(df: DataFrame, fn: Callable, schema: str, *inputs: str, rows: int = 1000) -> DataFrame:
    """df and the columns of a struct that a batch function makes from some of its columns, so many rows at a time.

    The other columns, ids above all, don't pass through pandas, where integers with nulls would become floats.
    """

    def parts(series: tuple[pd.Series, ...]) -> Iterator[tuple[pd.Series, ...]]:
        for at in range(0, len(series[0]), rows):
            yield tuple(s.iloc[at : at + rows].reset_index(drop=True) for s in series)

    def one(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from fn(p[0] for series in batches for p in parts((series,)))

    def many(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        yield from fn(p for series in batches for p in parts(series))

    made = F.pandas_udf(one if len(inputs) == 1 else many, schema)(*inputs)
    struct = fresh("made", df)
    return df.withColumn(struct, made).select(*(F.col(f"`{c}`") for c in df.columns), f"{struct}.*")


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, in DuckDB's SQL: a byte is taken in at its first bit, and each bit is shifted out."""
    taken = f"CASE WHEN i % 8 = 0 THEN xor(s, ascii(({text})[(i // 8 + 1)::INT])::BIGINT) ELSE s END"
    step = f"CASE WHEN ({taken}) % 2 = 1 THEN xor(({taken}) // 2, 3988292384::BIGINT) ELSE ({taken}) // 2 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, range(8 * length({text}))), lambda s, i: {step}), 4294967295::BIGINT)"
