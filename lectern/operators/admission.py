"""Admission of calls under limits, where only accepted calls fill the windows.

After more than `window` seconds without a call the window is empty, and only the day's count goes on.
So a key's calls are cut there into sessions, which are replayed in parallel as
if no day limit held. Within a day that changes nothing up to the last call that
the limit admits, and from there on all are refused: so a running count of what
sessions accept settles the limit. A session that reaches over midnight is the
exception, since calls refused before midnight leave room after it: it is
replayed for each count that its first day may have begun with, and once more when that count is known.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import together

DAY = 86_400


@dataclass(frozen=True)
class Limits:
    """At most `calls` and `tokens` accepted within the last `window` seconds, a call aged exactly that included, and `per_day` a day (UTC)."""

    window: int
    calls: int
    tokens: int | None = None
    per_day: int | None = None


class Replay:
    """The windows of one session, whose first day has `accepted` calls already."""

    def __init__(self, limits: Limits, day: int, accepted: int = 0, capped: bool = True) -> None:
        self.limits, self.day, self.accepted, self.capped = limits, day, accepted, capped
        self.held: deque = deque()
        self.used = 0

    def take(self, second: int, tokens: int) -> bool:
        while self.held and second - self.held[0][0] > self.limits.window:
            self.used -= self.held.popleft()[1]
        if second // DAY != self.day:
            self.day, self.accepted = second // DAY, 0
        most = self.limits.per_day
        good = len(self.held) < self.limits.calls and (self.limits.tokens is None or self.used + tokens <= self.limits.tokens) and not (self.capped and most is not None and self.accepted >= most)
        if good:
            self.held.append((second, tokens))
            self.used += tokens
            self.accepted += 1
        return good


def with_sessions(calls: DataFrame, key: str, window: int) -> DataFrame:
    """calls and session: the second in which the session of a call began. Spans of `span` seconds of a key are looked at by themselves and then linked by their ends."""
    span = max(3600, window)
    rows = calls.withColumn("span_", F.expr(f"second div {span}"))
    ends = rows.groupBy(key, "span_").agg(F.min("second").alias("from_"), F.max("second").alias("to_"))
    inside = Window.partitionBy(key, "span_").orderBy("second")
    gap = F.col("second") - F.lag("second").over(inside) > window
    own = rows.withColumn("begins_", F.when(gap, F.col("second")))
    own = own.withColumn("begun_", F.max("begins_").over(inside.rangeBetween(Window.unboundedPreceding, 0)))
    last = own.groupBy(key, "span_").agg(F.max("begins_").alias("last_"))
    spans = Window.partitionBy(key).orderBy("span_")  # a row per span
    linked = ends.join(last, [key, "span_"]).withColumn("first_", F.when(F.coalesce(F.col("from_") - F.lag("to_").over(spans) > window, F.lit(True)), F.col("from_")))
    carried = linked.withColumn("open_", F.max(F.greatest("first_", "last_")).over(spans.rowsBetween(Window.unboundedPreceding, -1)))
    start = carried.select(key, "span_", F.coalesce("first_", "open_").alias("start_"))
    return own.join(start, [key, "span_"]).withColumn("session", F.coalesce("begun_", "start_")).drop("span_", "begins_", "begun_", "start_")


def _grouped(batches: Iterator[pd.DataFrame], key: str, each: Callable, columns: list[str]) -> Iterator[pd.DataFrame]:
    """Hands the rows of sorted partitions one by one to `each`(first of its session?, row), which gives the rows to return."""
    before = None
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            own = (getattr(row, key), row.session)
            out += each(own != before, row)
            before = own
        yield pd.DataFrame(out, columns=columns)


def replayed(calls: DataFrame, key: str, id_: str, limits: Limits) -> DataFrame:
    """id and accepted of calls (key, id, second, tokens), taken by second and id. Repeated rows are calls of their own; null keys are one key."""
    rows = with_sessions(calls.select(F.coalesce(key, F.lit(-1)).alias("key_"), F.col(id_).alias("id_"), "second", "tokens"), "key_", limits.window)
    days = rows.groupBy("key_", "session").agg(F.expr(f"min(second) div {DAY}").alias("day_"), F.expr(f"max(second) div {DAY}").alias("last_"))
    rows = rows.join(days, ["key_", "session"])

    def free(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sessions of one day without the day limit."""
        state: list[Replay] = []

        def each(new: bool, row) -> list[tuple]:
            if new:
                state[:] = [Replay(limits, row.day_, capped=False)]
            good = state[0].take(row.second, row.tokens)
            return [(row.key_, row.session, row.day_, row.id_, good, state[0].accepted)]

        yield from _grouped(batches, "key_", each, ["key_", "session", "day_", "id_", "good", "nth"])

    long, ids = "long", dict(calls.dtypes)[id_]
    kinds = f"key_ {dict(rows.dtypes)['key_']}, session {long}, day_ {long}"
    ordered = lambda df: together(df, ["key_", "session"], ["second", "id_"])
    plain = ordered(rows.where("day_ = last_")).mapInPandas(free, f"{kinds}, id_ {ids}, good boolean, nth long")
    if limits.per_day is None:
        whole = ordered(rows.withColumn("last_", F.col("day_"))).mapInPandas(free, f"{kinds}, id_ {ids}, good boolean, nth long")
        return whole.select(F.col("id_").alias(id_), F.col("good").alias("accepted"))
    most = limits.per_day

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For sessions over midnight: how many calls their last day has after them, for each count that the first one began with."""
        state: list[Replay] = []

        def each(new: bool, row) -> list[tuple]:
            if new:
                state[:] = [Replay(limits, row.day_, c) for c in range(most + 1)]
            for s in state:
                s.take(row.second, row.tokens)
            return [(row.key_, row.session, row.day_, row.last_, row.second, [min(most, s.accepted) for s in state])]

        yield from _grouped(batches, "key_", each, ["key_", "session", "day_", "last_", "second", "after"])

    over = ordered(rows.where("day_ < last_"))
    steps = over.mapInPandas(tables, f"{kinds}, last_ {long}, second long, after array<long>").groupBy("key_", "session", "day_", "last_").agg(F.max(F.struct("second", F.size("after"), "after")).alias("x"))
    crossing = steps.select("key_", "session", "day_", "last_", F.lit(0).cast("long").alias("n"), F.col("x.after").alias("after"))
    counted = plain.groupBy("key_", "session", "day_").agg(F.max("nth").alias("n"))
    sessions = counted.select("key_", "session", "day_", F.col("day_").alias("last_"), "n", F.lit(None).cast("array<long>").alias("after")).unionByName(crossing)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What each session's first day has before it."""
        at: list = [None, None, 0]

        def each(new: bool, row) -> list[tuple]:
            key, day, count = at
            before = count if (key, day) == (row.key_, row.day_) else 0
            at[:] = row.key_, row.last_, min(most, before + row.n) if row.after is None else int(row.after[before])
            return [(row.key_, row.session, before)]

        yield from _grouped(batches, "key_", each, ["key_", "session", "before"])

    begun = together(sessions, ["key_"], ["session"]).mapInPandas(fold, f"key_ {dict(rows.dtypes)['key_']}, session long, before long")

    def settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: list[Replay] = []

        def each(new: bool, row) -> list[tuple]:
            if new:
                state[:] = [Replay(limits, row.day_, row.before)]
            return [(row.id_, state[0].take(row.second, row.tokens))]

        yield from _grouped(batches, "key_", each, [id_, "accepted"])

    within = plain.join(begun, ["key_", "session"]).select(F.col("id_").alias(id_), (F.col("good") & (F.col("before") + F.col("nth") <= most)).alias("accepted"))
    across = ordered(over.join(begun, ["key_", "session"])).mapInPandas(settled, f"{id_} {ids}, accepted boolean")
    return within.unionByName(across)
