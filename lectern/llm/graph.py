"""Connected components by alternating large and small stars, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed, dropped


def _least(edges: DataFrame) -> DataFrame:
    """u, m: the smallest of each node and its neighbours, of rows (u, v). Partial minima come before the shuffle, so a hub is no large group."""
    return edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours link to the smallest of its neighbours and itself."""
    both = edges.union(edges.select("v", "u").toDF("u", "v"))
    linked = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours link to the smallest of them. edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """node, component (its smallest reachable node) of all nodes of edges (a, b).

    Rounds of a large and a small star until nothing changes, which a chain of
    n nodes reaches after about log n rounds. Each round is written to the
    shared checkpoint folder, and the table before it is deleted. Null ends and
    loops are left out, repeated edges count once. `rounds` gets the number of edges of each round.
    """
    links = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = checkpointed(links), None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if rounds is not None:
            rounds.append(seen["n"])
        if seen["n"] == 0 or (seen["n"], seen["h"]) == before:
            break
        before = (seen["n"], seen["h"])
        after = checkpointed(_small_star(_large_star(now)))
        dropped(now)
        now = after
    # stars now: each node but the smallest of its component has one edge, to that one
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
