"""Visibility, pages, latest rows and merges over registry relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import rounds


def not_retired(rows: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    return rows.join(tombstones, key, "left_anti")


def visible_generations(gens: DataFrame, link: DataFrame, dead_docs: DataFrame, dead_gens: DataFrame) -> DataFrame:
    """Generations without a tombstone of their own, of their primary document or of any linked one.

    An OR over key shapes would plan as a nested loop; each shape is its own anti-join.
    """
    by_link = link.join(dead_docs, "doc_id", "left_semi").select("gen_id")
    by_primary = gens.join(dead_docs.withColumnRenamed("doc_id", "primary_doc"), "primary_doc", "left_semi").select("gen_id")
    return gens.join(dead_gens.union(by_link).union(by_primary).distinct(), "gen_id", "left_anti")


def page(rows: DataFrame, key: tuple[str, str], after: tuple[Column, Column] | None, size: int, descending: bool = False) -> DataFrame:
    """One keyset page, and `more`: whether another follows (one row beyond is looked at)."""
    a, b = key
    if after is not None:
        x, y = after
        beyond = (F.col(a) < x) | ((F.col(a) == x) & (F.col(b) < y)) if descending else (F.col(a) > x) | ((F.col(a) == x) & (F.col(b) > y))
        rows = rows.where(beyond)
    order = [F.desc(a), F.desc(b)] if descending else [F.asc(a), F.asc(b)]
    ahead = rows.orderBy(*order).limit(size + 1)
    counted = ahead.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return counted.withColumn("more", F.max("place").over(Window.partitionBy()) > size).where(F.col("place") <= size)


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("rn_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("rn_ = 1").drop("rn_")


def numbered(rows: DataFrame, group: str, key: str) -> DataFrame:
    """rows and place: the number of each from 0 on in its group by key. A group may have a third of all rows, so ranges of
    (group, key) are numbered by themselves, and each starts after what the ranges before it have of the group."""
    with rounds(rows.sparkSession) as kept:
        parts = kept(rows.repartitionByRange(group, key).withColumn("range_", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy(group, "range_").orderBy(key)) - 1
    earlier = Window.partitionBy(group).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    starts = parts.groupBy(group, "range_").agg(F.count("*").alias("n_")).withColumn("start_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)))
    return parts.withColumn("place", inside).join(starts, [group, "range_"]).withColumn("place", F.col("place") + F.col("start_")).drop("range_", "start_", "n_")
