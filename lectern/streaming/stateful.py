"""Keyed state with timers: admission under limits, the states of jobs, first bodies and their conflicts.

Rows wait in state until the watermark has passed their second, and
are then taken in the order of time and id, so that neither batches nor the order of arrival
change what comes out. Timers wake for the next waiting row, and end what is
held of a key: nothing is kept for a key whose windows are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets that keys are dealt to by hash, and rows of a bucket that a larger number of them is to aim at.
BUCKETS, BUCKET_ROWS = 1024, 8192


def buckets(rows: int) -> int:
    """Buckets for a stream of about so many live rows. A checkpoint goes on with the number that it began with."""
    return max(BUCKETS, -(-rows // BUCKET_ROWS))


class Ordered(StatefulProcessor):
    """Takes each key's rows (key, id, second, body) in order; rows without an id come first in their second.

    A group of the stream is a bucket of keys with one timer, as an exchange with the state store costs as much as hundreds of rows do.
    Subclasses say in `held` what is held of a key, by names of states and their columns, and in `taken` what its due rows give: the rows
    that come out, what is held from now on, and the second to wake at.
    """

    body, held = "string", {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"keys array<{self.key}>, ids array<long>, seconds array<long>, bodies array<{self.body}>")  # a row for each part that came
        self.next = handle.getValueState("next", "second long")
        self.states = {name: handle.getListState(name, f"key {self.key}, {columns}") for name, columns in self.held.items()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        empty = "" if self.body == "string" else 0  # what a null body counts as
        first = None
        for batch in rows:
            if not len(batch):
                continue
            ids, seconds = ([None if x != x or x is None else int(x) for x in batch[c].tolist()] for c in ("id", "second"))
            bodies = [empty if x is None or x != x else type(empty)(x) for x in batch["body"].tolist()]
            self.waiting.appendList([(batch["key"].tolist(), ids, seconds, bodies)])
            first = min(seconds) if first is None else min(first, *seconds)
        if first is not None:
            self.wake(first + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // 1000  # no row of an earlier second will come
        due, later = {}, []
        for part in self.waiting.get():
            for row in zip(*part):
                if row[2] < now:
                    due.setdefault(row[0], []).append((row[2], row[1] is not None, row[1] or 0, row[3]))
                else:
                    later.append(row)
        before = {name: {} for name in self.states}
        for name, state in self.states.items():
            for own, *values in state.get():
                before[name].setdefault(own, []).append(tuple(values))
                due.setdefault(own, [])
        after, out, wakes = {name: [] for name in self.states}, [], [row[2] + 1 for row in later]
        for own, rows in due.items():
            told = [(place if known else None, second, body) for second, known, place, body in sorted(rows)]
            given, kept, wake = self.taken(own, told, now, {name: before[name].get(own, []) for name in self.states})
            out += given
            for name, values in kept.items():
                after[name] += [(own, *v) for v in values]
            if wake is not None:
                wakes.append(wake)
        if due:
            self.hold(self.waiting, [tuple(map(list, zip(*later)))] if later else [])
        for name, state in self.states.items():
            if before[name] or after[name]:
                self.hold(state, after[name])
        self.next.clear()
        if wakes:
            self.wake(min(wakes))
        if out:
            yield pd.DataFrame(out, columns=self.columns, dtype=object)  # ids may be null

    @staticmethod
    def hold(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def wake(self, second: int) -> None:
        """The timer at the earliest second that the bucket needs one for."""
        known = self.next.get()
        if known is not None and known[0] <= second:
            return
        if known is not None:
            self.handle.deleteTimer(known[0] * 1000)
        self.handle.registerTimer(second * 1000)
        self.next.update((second,))

    def close(self) -> None:
        pass


class Admission(Ordered):
    """Accepts a call if, with it, the accepted ones of the last `window` seconds are at most `calls`, their tokens at
    most `tokens`, and those of its day at most `per_day`. A call aged exactly `window` still counts. No limit where None."""

    body, columns = "long", ["id", "accepted"]
    held = {"held": "second long, tokens long", "today": "day long, accepted long"}

    def __init__(self, window: int, calls: int, tokens: int | None, per_day: int | None) -> None:
        self.window, self.calls, self.tokens, self.per_day = window, calls, tokens, per_day

    def taken(self, key, due: list, now: int, own: dict) -> tuple[list, dict, int | None]:
        held = own["held"]
        day, accepted = own["today"][0] if own["today"] else (0, 0)
        out = []
        for call, second, tokens in due:
            held = [h for h in held if second - h[0] <= self.window]
            if second // DAY != day:
                day, accepted = second // DAY, 0
            fits = self.tokens is None or sum(h[1] for h in held) + tokens <= self.tokens
            good = len(held) < self.calls and fits and (self.per_day is None or accepted < self.per_day)
            if good:
                held.append((second, tokens))
                accepted += 1
            out.append((call, good))
        held = [h for h in held if now - h[0] <= self.window]
        today = [(day, accepted)] if accepted and self.per_day is not None and now < (day + 1) * DAY else []
        wakes = [h[0] + self.window + 1 for h in held[:1]] + [(d + 1) * DAY for d, _ in today]
        return out, {"held": held, "today": today}, min(wakes, default=None)


class JobStates(Ordered):
    """The states of a job until its first end state. A job begins with the state `start`; it expires `wait` seconds after its last
    event if none follows. Then its state goes, and what still comes for it isn't a job and isn't reported."""

    columns, held = ["job", "id", "state", "second"], {"last": "second long"}

    def __init__(self, start: str, ends: tuple[str, ...], wait: int) -> None:
        self.start, self.ends, self.wait = start, ends, wait

    def taken(self, key, due: list, now: int, own: dict) -> tuple[list, dict, int | None]:
        last, out = own["last"][0][0] if own["last"] else None, []
        for event, second, state in due:
            if last is not None and second - last > self.wait:
                out.append((key, None, "expired", last + self.wait))
                last = None
            if last is None and state != self.start:
                continue
            out.append((key, event, state, second))
            last = None if state in self.ends else second
        if last is not None and now > last + self.wait:
            out.append((key, None, "expired", last + self.wait))
            last = None
        return out, {"last": [] if last is None else [(last,)]}, None if last is None else last + self.wait + 1


class Outcomes(Ordered):
    """created for the first body of a key, then duplicate for the same and conflict for another one. A key is forgotten `keep` seconds after its last row."""

    columns, held = ["id", "outcome"], {"first": "body string, last long"}

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def taken(self, key, due: list, now: int, own: dict) -> tuple[list, dict, int | None]:
        known, last = own["first"][0] if own["first"] else (None, None)
        out = []
        for row, second, body in due:
            if last is not None and second - last > self.keep:
                last = None
            out.append((row, "created" if last is None else "duplicate" if body == known else "conflict"))
            known, last = body if last is None else known, second
        if last is not None and now <= last + self.keep:
            return out, {"first": [(known, last)]}, last + self.keep + 1
        return out, {"first": []}, None


def _run(rows: DataFrame, key: str, body: str, processor: Ordered, schema: str, late: str, n: int) -> DataFrame:
    """Keys mustn't be null, as pandas would make others of their batch floats."""
    spark = rows.sparkSession
    spark.conf.set(PROVIDER, ROCKSDB)  # the store that keeps lists and timers
    processor.key = rows.schema[key].dataType.simpleString()
    marked = rows.select(F.pmod(F.xxhash64(key), F.lit(n)).alias("bucket"), F.col(key).alias("key"), "id", "ts", F.unix_seconds("ts").alias("second"), F.col(body).alias("body")).withWatermark("ts", late)
    return marked.groupBy("bucket").transformWithStateInPandas(processor, schema, "append", "eventTime")


def admitted(calls: DataFrame, key: str, window: int, most: int, tokens: int | None = None, per_day: int | None = None, late: str = "0 seconds", n: int = BUCKETS) -> DataFrame:
    """id, accepted of a stream of calls (key, id, ts, tokens); a call is judged once the watermark has passed its second."""
    return _run(calls, key, "tokens", Admission(window, most, tokens, per_day), "id long, accepted boolean", late, n)


def outcomes(rows: DataFrame, key: str, keep: int, late: str = "0 seconds", n: int = BUCKETS) -> DataFrame:
    """id, outcome of a stream of rows (key, id, ts, body)."""
    return _run(rows, key, "body", Outcomes(keep), "id long, outcome string", late, n)


def job_states(events: DataFrame, start: str, ends: tuple[str, ...], wait: int, late: str = "0 seconds", n: int = BUCKETS) -> DataFrame:
    """job, id, state, second of a stream of events (job, id, ts, body: the state); an expiry has no id."""
    return _run(events, "job", "body", JobStates(start, ends, wait), "job long, id long, state string, second long", late, n)
