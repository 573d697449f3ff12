import random
import shutil
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lectern.operators import admission
from lectern.streaming import feed, stateful

EVENTS = "key long, id long, ts timestamp, tokens long"


def brute(calls, limits):
    out, state = {}, {}
    for key, call, second, tokens in sorted(calls, key=lambda c: (c[2], c[1])):
        held, days = state.setdefault(key, ([], {}))
        held[:] = [h for h in held if second - h[0] <= limits.window]
        today = days.get(second // 86_400, 0)
        good = len(held) < limits.calls and (limits.tokens is None or sum(h[1] for h in held) + tokens <= limits.tokens) and (limits.per_day is None or today < limits.per_day)
        if good:
            held.append((second, tokens))
            days[second // 86_400] = today + 1
        out[call] = good
    return out


def made(seed, n=1500):
    """Three keys around several midnights: bursts, gaps of exactly the window, and sessions that reach over midnight."""
    rnd = random.Random(seed)
    at, calls = 86_400 * 19_700 - 4000, []
    for i in range(n):
        at += rnd.choice([0, 1, 5, 20, 59, 60, 61, 62, 400, 1500]) if rnd.random() < 0.9 else rnd.choice([0, 9000])
        calls.append((rnd.choice([1, 1, 2, 3]), i, at, rnd.randint(1, 60)))
    return calls


@pytest.mark.parametrize("limits", [admission.Limits(60, 3, 120, 5), admission.Limits(60, 2, None, None), admission.Limits(5000, 4, 150, 9), admission.Limits(90_000, 5, None, 3)])
def test_sessions_equal_one_sequence(spark, limits):
    for seed in (1, 2):
        calls = made(seed)
        rows = spark.createDataFrame(calls, "key long, id long, second long, tokens long")
        assert {r.id: r.accepted for r in admission.replayed(rows, "key", "id", limits).collect()} == brute(calls, limits)


def test_empty_and_null_keys(spark):
    schema = "key long, id long, second long, tokens long"
    assert admission.replayed(spark.createDataFrame([], schema), "key", "id", admission.Limits(60, 1, None, 1)).count() == 0
    rows = spark.createDataFrame([(None, 1, 5, 1), (None, 2, 5, 1)], schema)
    assert {r.id: r.accepted for r in admission.replayed(rows, "key", "id", admission.Limits(60, 1, None, 9)).collect()} == {1: True, 2: False}


def written(spark, calls, folder, parts):
    stamp = lambda s: datetime.fromtimestamp(s, timezone.utc)
    for k in range(parts):
        own = [(a, b, stamp(c) + timedelta(milliseconds=b % 900), d) for a, b, c, d in calls[k::parts]] if parts < 3 else [(a, b, stamp(c) + timedelta(milliseconds=b % 900), d) for a, b, c, d in calls[k * len(calls) // parts : (k + 1) * len(calls) // parts]]
        spark.createDataFrame(own, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def stored(spark, checkpoint, name):
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load().count()


def test_stream_equals_the_replay_and_its_state_ends(spark, tmp_path):
    limits, calls = admission.Limits(60, 3, 120, 5), made(3, 400)
    folder, sink = str(tmp_path / "in"), str(tmp_path / "out")
    written(spark, calls, folder, 4)
    last = max(c[2] for c in calls)
    written(spark, [(-1, -1, last + 200_000, 1)], folder, 1)
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    # the parts overlap in time, so rows may come a day late
    got = feed.drained(stateful.admitted(rows, "key", 60, 3, 120, 5, late="1 day"), sink)
    assert {r.id: r.accepted for r in got.where("id >= 0").collect()} == brute(calls, limits)
    assert stored(spark, f"{sink}/checkpoint", "held") == 0 and stored(spark, f"{sink}/checkpoint", "today") == 0
    assert stored(spark, f"{sink}/checkpoint", "waiting") <= 1  # the marker's own row


JOB = "job long, id long, ts timestamp, body string"


def test_jobs_end_expire_and_stay_ended(spark, tmp_path):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    parts = [
        [(1, 0, 0, "queued"), (2, 1, 5, "queued"), (2, 2, 9, "running"), (3, 3, 20, "queued"), (6, 4, 30, "running")],
        [(2, 5, 30, "completed"), (2, 6, 40, "running"), (3, 7, 200, "running"), (2, 8, 3000, "running")],
        [(2, 9, 9000, "running"), (4, 10, 9000, "queued"), (1, 11, 9001, "running")],
        [(5, 12, 99_000, "queued")],
    ]
    for part in parts:
        rows = [(j, i, start + timedelta(seconds=s), kind) for j, i, s, kind in part]
        spark.createDataFrame(rows, JOB).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(JOB).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {}
    for r in feed.drained(stateful.job_states(rows, "queued", ("completed", "failed"), 300), str(tmp_path / "out")).orderBy("second").collect():
        got.setdefault(r.job, []).append(r.state)
    assert got == {1: ["queued", "expired"], 2: ["queued", "running", "completed"], 3: ["queued", "running", "expired"], 4: ["queued", "expired"]}
    assert stored(spark, str(tmp_path / "out" / "checkpoint"), "last") == 0


def test_feed_goes_on_after_a_crash(spark, tmp_path, monkeypatch):
    """A writer dies after a batch's rows are written and before the batch is committed: started again, it loses and repeats nothing."""
    folder, sink, checkpoint = (str(tmp_path / x) for x in ("in", "sink", "checkpoint"))
    for k in range(5):
        spark.range(k * 10, k * 10 + 10).select("id").coalesce(1).write.mode("append").parquet(folder)
    source = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(folder)
    plain, died = feed.written, []

    def dying(batch, number, where):
        plain(batch, number, where)
        if number == 2 and not died:
            died.append(number)
            raise RuntimeError("killed")

    monkeypatch.setattr(feed, "written", dying)
    with pytest.raises(Exception, match="killed"):
        feed.deliver(source(), sink, checkpoint, available_now=True).awaitTermination()
    seen, last = feed.since(spark, sink, "id long")
    first = [r.id for r in seen.collect()]
    assert len(first) == 30 and last == 2
    shutil.rmtree(tmp_path / "sink" / f"batch={1:012d}", ignore_errors=True)  # a reader that has batch 1 doesn't ask for it again
    feed.deliver(source(), sink, checkpoint, available_now=True).awaitTermination()
    more, last = feed.since(spark, sink, "id long", last)
    rest = [r.id for r in more.collect()]
    assert last == 4 and sorted(first + rest) == list(range(50))
    none, same = feed.since(spark, sink, "id long", last)
    assert none.count() == 0 and same == last


def test_sessions_stay_whole_when_a_join_becomes_a_broadcast(spark):
    """Spark then reads the partitions of a join as they come, and nothing but the replay's own repartition keeps a session together."""
    rnd, limits = random.Random(1), admission.Limits(100_000, 5)
    calls = [(rnd.randrange(300), i, 1_704_067_200 + rnd.randrange(30 * 86_400), 1) for i in range(12_000)]
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "300k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows = spark.createDataFrame(calls, "key long, id long, second long, tokens long").repartition(6)
        got = {r.id: r.accepted for r in admission.replayed(rows, "key", "id", limits).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == brute(calls, limits)


def test_keys_of_a_bucket_share_its_timer(spark, tmp_path):
    """Many keys in one group of the stream and rows that come late: each key is judged alone, nothing stays held, and the number of groups follows the rows, not the keys."""
    limits, rnd = admission.Limits(60, 2, 90, 4), random.Random(7)
    calls = [(rnd.randrange(40), i, 86_400 * 19_700 - 300 + 2 * i + rnd.choice([0, 0, 900, 80_000]), rnd.randint(1, 60)) for i in range(600)]
    folder, sink = str(tmp_path / "in"), str(tmp_path / "out")
    written(spark, calls, folder, 2)
    written(spark, [(-1, -1, max(c[2] for c in calls) + 200_000, 1)], folder, 1)
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    got = feed.drained(stateful.admitted(rows, "key", 60, 2, 90, 4, late="1 day", n=3), sink)
    assert {r.id: r.accepted for r in got.where("id >= 0").collect()} == brute(calls, limits)
    assert [stored(spark, f"{sink}/checkpoint", name) for name in ("held", "today")] == [0, 0] and stored(spark, f"{sink}/checkpoint", "next") <= 1
    assert stateful.buckets(10) == stateful.BUCKETS and stateful.buckets(36_000_000) * stateful.BUCKET_ROWS >= 36_000_000
