"""Retrieval for several sections at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.search import top_k


def fetched(scored: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k nearest of each asked (query_id, label)."""
    return top_k(scored.join(asked, ["query_id", "label"], "left_semi"), k, ["query_id", "label"], ["vec_id"])


def widened(wanted: DataFrame, first: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], DataFrame], by: list[str]) -> DataFrame:
    """What the first fetch finds for the wanted groups, and the second one for those that it left empty; `widened` tells which.

    Each fetch takes the groups to ask for. Groups that both leave empty have no rows.
    """
    found = first(wanted)
    open_ = wanted.join(found.select(*by).distinct(), by, "left_anti")
    return found.withColumn("widened", F.lit(False)).unionByName(second(open_).withColumn("widened", F.lit(True)))
