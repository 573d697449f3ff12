"""Readers of raw documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import CONTROL, normalized

LIMITS = {"pdf": 20 << 20, "md": 5 << 20, "txt": 5 << 20}


def raw_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, ext, size, content, verdict of the files of a folder, checked cheapest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    raw = F.lower(F.regexp_extract("path", r"[^.]+$", 0))
    rows = files.select("path", F.when(raw == "markdown", "md").otherwise(raw).alias("ext"), F.col("length").alias("size"), "content")
    most = F.coalesce(*(F.when(F.col("ext") == k, v) for k, v in LIMITS.items()))
    magic = F.locate("%PDF-", F.decode(F.substring("content", 1, 1024), "ISO-8859-1")) > 0
    text = F.expr("try_validate_utf8(content)")
    verdict = (
        F.when(most.isNull(), "type").when(F.col("size") > most, "size").when(F.col("ext") == "pdf", F.when(magic, "ok").otherwise("magic"))
        .when(text.isNull() | text.rlike(CONTROL), "text").when(F.trim(text) == "", "blank").otherwise("ok")
    )
    return rows.withColumn("verdict", verdict)


def texts(files: DataFrame) -> DataFrame:
    """path, digest, text of the admitted text files. The digest is that of the bytes, as for pasted text."""
    good = files.where("verdict = 'ok' and ext <> 'pdf'")
    return good.select("path", F.sha2("content", 256).alias("digest"), normalized(F.expr("try_validate_utf8(content)")).alias("text"))
