"""Pairs each query with its DuckDB oracle.

A query is a function (spark, sf_dir) -> DataFrame. The decorator stores it
under its name, with the oracle text if SQL can express the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"duplicate query {name}")
            self.queries[name] = fn
            if oracle:
                self.oracles[name] = oracle
            return fn

        return register
