"""Python functions over Arrow batches, for what depends on the order inside one text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def batched(fn: Callable, kind: str, *columns: Column) -> Column:
    """A column of fn over the rows of Arrow batches; null where the first argument is."""

    def rows(parts: tuple[pd.Series, ...]) -> pd.Series:
        return pd.Series([None if row[0] is None else fn(*row) for row in zip(*parts, strict=True)], dtype=object)

    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from (rows((part,)) for part in batches)

    def many(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        yield from map(rows, batches)

    return F.pandas_udf(one if len(columns) == 1 else many, kind)(*columns)
