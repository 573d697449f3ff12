"""Study progress, rate and budget accounting over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import admission
from lectern.plans.base import CATALOG
from lectern.plans.registry import OUTCOME_SQL, PROGRESS_SQL
from lectern.session import folder_for, table
from lectern.sources.upserts import KeyedTable
from lectern.streaming import stateful
from lectern.streaming.feed import drained

query = CATALOG.query
TOKENS_SQL = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


@query(
    "concept_reviews",
    """WITH e AS (SELECT user_id, event_type AS concept, CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS day FROM events)
SELECT user_id, count(DISTINCT concept) AS concepts, (count(DISTINCT concept || coalesce(day, '-')) - count(DISTINCT concept))::BIGINT AS repeats, max(day) AS last_day FROM e GROUP BY 1""",
)
def concept_reviews(spark: SparkSession, d: str) -> DataFrame:
    day = F.when(F.col("event_id") % 5 != 0, F.date_format("ts", "yyyy-MM-dd"))
    rows = events(spark, d).select("user_id", F.col("event_type").alias("concept"), day.alias("day"))
    concepts, days = F.countDistinct("concept"), F.countDistinct(F.concat("concept", F.coalesce("day", F.lit("-"))))
    return rows.groupBy("user_id").agg(concepts.alias("concepts"), (days - concepts).alias("repeats"), F.max("day").alias("last_day"))


@query("cards_seen", "SELECT user_id, count(DISTINCT json_extract_string(props, '$.k')) AS cards FROM events GROUP BY 1")
def cards_seen(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("user_id").agg(F.countDistinct(F.get_json_object("props", "$.k")).alias("cards"))


@query(
    "quiz_attempts",
    """WITH a AS (SELECT user_id, value > 50 AS hit, row_number() OVER (PARTITION BY user_id, event_type, event_id % 10 ORDER BY event_id) AS n FROM events)
SELECT user_id, count(*) FILTER (n = 1) AS first_total, count(*) FILTER (n = 1 AND hit) AS first_hits, count(*) FILTER (n > 1) AS later_total, count(*) FILTER (n > 1 AND hit) AS later_hits FROM a GROUP BY 1""",
)
def quiz_attempts(spark: SparkSession, d: str) -> DataFrame:
    attempt = F.row_number().over(Window.partitionBy("user_id", "event_type", F.col("event_id") % 10).orderBy("event_id"))
    rows = events(spark, d).select("user_id", (F.col("value") > 50).alias("hit"), attempt.alias("n"))
    first, later = F.col("n") == 1, F.col("n") > 1
    return rows.groupBy("user_id").agg(F.count_if(first).alias("first_total"), F.count_if(first & F.col("hit")).alias("first_hits"), F.count_if(later).alias("later_total"), F.count_if(later & F.col("hit")).alias("later_hits"))


@query(
    "remaining_time",
    """WITH item AS (SELECT u.user_id, t.event_type, k.k FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT event_type FROM events) t, range(10) k(k)),
done AS (SELECT DISTINCT user_id, event_type, event_id % 10 AS k FROM events WHERE value > 50),
p AS (SELECT i.user_id, i.event_type, count(*) FILTER (d.k IS NULL) AS pending, count(*) AS total FROM item i LEFT JOIN done d USING (user_id, event_type, k) GROUP BY 1, 2)
SELECT user_id, round(sum(5.0 * pending / total), 2) AS minutes FROM p GROUP BY 1""",
)
def remaining_time(spark: SparkSession, d: str) -> DataFrame:
    done = events(spark, d).where("value > 50").groupBy("user_id", "event_type").agg(F.countDistinct(F.col("event_id") % 10).alias("done"))
    kinds = events(spark, d).select("event_type").distinct().agg(F.count("*").alias("kinds"))
    users = events(spark, d).select("user_id").distinct().join(F.broadcast(kinds))  # one row
    finished = done.groupBy("user_id").agg(F.sum("done").alias("done"))
    return users.join(finished, "user_id", "left").select("user_id", F.round((F.col("kinds") * 10 - F.coalesce("done", F.lit(0))) * 5.0 / 10, 2).alias("minutes"))


MONTHLY_SQL = "SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n FROM events GROUP BY 1, 2"


@query("monthly_requests", MONTHLY_SQL)
def monthly_requests(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count("*").alias("n"))


BUDGET = 2_000_000


@query("budget_summary", f"SELECT source, sum(n_chars)::BIGINT AS stored, sum(n_chars) >= 0.8 * {BUDGET} // 20 AS alert, sum(n_chars) >= {BUDGET} // 20 - 1000 AS blocked FROM documents GROUP BY 1")
def budget_summary(spark: SparkSession, d: str) -> DataFrame:
    limit = BUDGET // 20
    rows = table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("stored"))
    return rows.select("source", "stored", (F.col("stored") >= 0.8 * BUDGET // 20).alias("alert"), (F.col("stored") >= limit - 1000).alias("blocked"))


INVENTORY_SQL = "SELECT name, max(bytes) AS bytes FROM (SELECT p_name AS name, p_size AS bytes FROM part UNION ALL SELECT p_name, (p_size * 3) % 50 FROM part WHERE p_partkey % 2 = 0) GROUP BY 1"


@query("inventory_merge", INVENTORY_SQL)
def inventory_merge(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    newer = part.where("p_partkey % 2 = 0").select("p_name", (F.col("p_size") * 3) % 50)
    return part.select(F.col("p_name").alias("name"), F.col("p_size").alias("bytes")).union(newer).groupBy("name").agg(F.max("bytes").alias("bytes"))


def in_batches(table_: KeyedTable, rows: DataFrame, part: str) -> DataFrame:
    """Applies rows in three batches by a column of 0 to 2, the second of them twice."""
    for batch in (0, 1, 1, 2):
        table_.apply(rows.where(F.col(part) == batch), "query", batch)
    return table_.rows()


@query("monthly_requests_kept", MONTHLY_SQL)
def monthly_requests_kept(spark: SparkSession, d: str) -> DataFrame:
    """The counters as batches of events add to them."""
    kept = KeyedTable(spark, folder_for(spark, "kept"), "month string, event_type string, n long", ["month", "event_type"], {"n": "sum"}, buckets=8)
    rows = events(spark, d).select(F.date_format("ts", "yyyy-MM").alias("month"), "event_type", F.lit(1).cast("long").alias("n"), (F.col("event_id") % 3).alias("part"))
    return in_batches(kept, rows, "part")


@query("inventory_kept", INVENTORY_SQL)
def inventory_kept(spark: SparkSession, d: str) -> DataFrame:
    kept = KeyedTable(spark, folder_for(spark, "kept"), "name string, bytes int", ["name"], {"bytes": "max"}, buckets=8)
    part = table(spark, d, "part")
    newer = part.where("p_partkey % 2 = 0").select("p_name", ((F.col("p_size") * 3) % 50).alias("bytes"), F.lit(2).alias("part"))
    return in_batches(kept, part.select(F.col("p_name").alias("name"), F.col("p_size").alias("bytes"), (F.col("p_partkey") % 2).cast("int").alias("part")).union(newer), "part")


@query("progress_kept", PROGRESS_SQL)
def progress_kept(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last state: older versions that come later don't replace it."""
    kept = KeyedTable(spark, folder_for(spark, "kept"), "user_id long, state double, version long", ["user_id"], {"state": "newest"}, "version", buckets=8)
    return in_batches(kept, events(spark, d).select("user_id", F.col("value").alias("state"), F.col("event_id").alias("version"), F.pmod(-F.col("event_id"), F.lit(3)).alias("part")), "part")


@query("history_suffix", f"SELECT conv_id, turn FROM (SELECT conv_id, turn, sum({TOKENS_SQL}) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS cost FROM conversations) WHERE cost <= 120")
def history_suffix(spark: SparkSession, d: str) -> DataFrame:
    cost = F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0)))
    from_here = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").withColumn("cost", F.sum(cost).over(from_here)).where("cost <= 120").select("conv_id", "turn")


@query("recent_turns", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)")
def recent_turns(spark: SparkSession, d: str) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", newest.alias("back")).where("back <= 3")
    return rows.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("place"))


@query("rolling_rate", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS calls, count(*) OVER (PARTITION BY event_type, strftime(ts, '%Y-%m-%d') ORDER BY ts) AS today FROM events")
def rolling_rate(spark: SparkSession, d: str) -> DataFrame:
    """Calls of the type in the last 60 seconds, and of its day so far. A type may have a third of all rows, so windows hold
    one minute of a type and the minute before it; whole minutes are counted before they are added up."""
    rows = events(spark, d).select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    rows = rows.withColumn("minute", F.floor(F.col("us") / 60_000_000))
    before = Window.partitionBy("event_type", "day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    minutes = rows.groupBy("event_type", "day", "minute").agg(F.count("*").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
    seen = rows.withColumn("part", F.explode(F.array("minute", F.col("minute") + 1)))
    own = (F.col("part") == F.col("minute")).cast("long")
    inside = Window.partitionBy("event_type", "part").orderBy("us")
    told = seen.withColumns({"calls": F.count("*").over(inside.rangeBetween(-60_000_000, 0)), "so_far": F.sum(own).over(inside.rangeBetween(Window.unboundedPreceding, 0)), "own": own}).where("own = 1")
    return told.join(minutes, ["event_type", "day", "minute"]).select("event_id", "calls", (F.col("so_far") + F.col("earlier")).alias("today"))


@query(
    "rolling_tokens",
    """WITH e AS (SELECT event_id, event_type, ts, 10 + event_id % 60 AS tokens FROM events)
SELECT event_id, (sum(tokens) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW))::BIGINT AS minute_tokens, (sum(tokens) OVER (PARTITION BY event_type, strftime(ts, '%Y-%m-%d') ORDER BY ts))::BIGINT AS day_tokens FROM e""",
)
def rolling_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the type in the last 60 seconds, and of its day so far, in windows of a minute and the one before it."""
    rows = events(spark, d).select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.lit(10) + F.col("event_id") % 60).alias("tokens"))
    rows = rows.withColumn("minute", F.floor(F.col("us") / 60_000_000))
    before = Window.partitionBy("event_type", "day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    minutes = rows.groupBy("event_type", "day", "minute").agg(F.sum("tokens").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
    seen = rows.withColumn("part", F.explode(F.array("minute", F.col("minute") + 1)))
    own = F.when(F.col("part") == F.col("minute"), F.col("tokens")).otherwise(0)
    inside = Window.partitionBy("event_type", "part").orderBy("us")
    told = seen.withColumns({"minute_tokens": F.sum("tokens").over(inside.rangeBetween(-60_000_000, 0)), "so_far": F.sum(own).over(inside.rangeBetween(Window.unboundedPreceding, 0))}).where("part = minute")
    return told.join(minutes, ["event_type", "day", "minute"]).select("event_id", "minute_tokens", (F.col("so_far") + F.col("earlier")).alias("day_tokens"))


ADMISSION_SQL = """WITH RECURSIVE c AS (SELECT event_id, user_id, epoch(ts)::BIGINT - (epoch(ts) < epoch(ts)::BIGINT)::INT AS second, 10 + event_id % 60 AS tokens, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT - (epoch(ts) < epoch(ts)::BIGINT)::INT, event_id) AS rn FROM events),
s AS (SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, []::STRUCT(sec BIGINT, n BIGINT)[] AS win, -1::BIGINT AS day, 0 AS today, false AS accepted FROM (SELECT DISTINCT user_id FROM c)
UNION ALL SELECT user_id, rn, event_id, CASE WHEN ok THEN list_append(live, {'sec': second, 'n': tokens}) ELSE live END, second // 86400, done + ok::INT, ok FROM (
  SELECT *, len(live) < 3 AND coalesce(list_sum(list_transform(live, lambda x: x.n)), 0) + tokens <= 120 AND done + 1 <= 20 AS ok FROM (
    SELECT c.user_id, c.rn, c.event_id, c.second, c.tokens, list_filter(s.win, lambda x: c.second - x.sec <= 60) AS live, CASE WHEN c.second // 86400 = s.day THEN s.today ELSE 0 END AS done FROM s JOIN c ON c.user_id = s.user_id AND c.rn = s.rn + 1)))
SELECT event_id, accepted FROM s WHERE rn > 0"""


def calls(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"), (F.lit(10) + F.col("event_id") % 60).alias("tokens"))


@query("admission_replay", ADMISSION_SQL)
def admission_replay(spark: SparkSession, d: str) -> DataFrame:
    """Calls of each user in time order; only accepted ones count in the windows of 3 calls and 120 tokens a minute and 20 calls a day."""
    return admission.replayed(calls(spark, d), "user_id", "event_id", admission.Limits(60, 3, 120, 20))


@query("admission_stream", ADMISSION_SQL)
def admission_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream of the events, whose state holds the windows and ends with them."""
    rows = event_stream(spark, d).select(F.coalesce("user_id", F.lit(-1)).alias("key"), F.col("event_id").alias("id"), "ts", (F.lit(10) + F.col("event_id") % 60).alias("tokens"))
    return drained(stateful.admitted(rows, "key", 60, 3, 120, 20, n=buckets(spark, d)).where("id is not null")).select(F.col("id").alias("event_id"), "accepted")


def buckets(spark: SparkSession, d: str) -> int:
    """Buckets of keys for a stream of all events: their number grows with the table, what a task holds of one doesn't."""
    return stateful.buckets(table(spark, d, "events").count())


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """A stream of the events and one without a user, a day after the last of them, that moves the watermark past them."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    end = folder_for(spark, "end")
    table(spark, d, "events").agg(F.max("ts").alias("ts")).select(F.lit(None).cast("long").alias("event_id"), F.expr("ts + interval 1 day").alias("ts"), *(F.lit(None).cast(k).alias(c) for c, k in (("user_id", "long"), ("event_type", "string"), ("value", "double"), ("props", "string")))).write.parquet(end)
    read = lambda path: spark.readStream.schema(schema).parquet(path)
    return read(f"{d}/events.parquet*").unionByName(read(end)).withColumn("ts", F.col("ts").cast("timestamp"))


# an attempt of a user with a value below 25 fails; five that weren't refused within 100,000 seconds lock the user out
LOCK_SQL = """WITH RECURSIVE c AS (SELECT event_id, user_id, epoch(ts)::BIGINT - (epoch(ts) < epoch(ts)::BIGINT)::INT AS second, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT - (epoch(ts) < epoch(ts)::BIGINT)::INT, event_id) AS rn FROM events WHERE value < 25),
s AS (SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, []::BIGINT[] AS win, false AS locked FROM (SELECT DISTINCT user_id FROM c)
UNION ALL SELECT user_id, rn, event_id, CASE WHEN len(live) < 5 THEN list_append(live, second) ELSE live END, len(live) >= 5 FROM (
  SELECT c.user_id, c.rn, c.event_id, c.second, list_filter(s.win, lambda x: c.second - x <= 100000) AS live FROM s JOIN c ON c.user_id = s.user_id AND c.rn = s.rn + 1))
SELECT event_id, locked FROM s WHERE rn > 0"""


@query("attempt_lock", LOCK_SQL)
def attempt_lock(spark: SparkSession, d: str) -> DataFrame:
    """Failed attempts, and which of them met a lock: one that is refused doesn't count, so a lock ends when the attempts that made it have aged."""
    failed = events(spark, d).where("value < 25").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"), F.lit(0).cast("long").alias("tokens"))
    return admission.replayed(failed, "user_id", "event_id", admission.Limits(100_000, 5)).select("event_id", (~F.col("accepted")).alias("locked"))


@query("attempt_lock_stream", LOCK_SQL)
def attempt_lock_stream(spark: SparkSession, d: str) -> DataFrame:
    failed = event_stream(spark, d).where("value < 25 or event_id is null").select(F.coalesce("user_id", F.lit(-1)).alias("key"), F.col("event_id").alias("id"), "ts", F.lit(0).cast("long").alias("tokens"))
    return drained(stateful.admitted(failed, "key", 100_000, 5, n=buckets(spark, d)).where("id is not null")).select(F.col("id").alias("event_id"), (~F.col("accepted")).alias("locked"))


@query("idempotency_stream", OUTCOME_SQL)
def idempotency_stream(spark: SparkSession, d: str) -> DataFrame:
    """What each event of a user and type is to the first one's body, as the stream tells it."""
    rows = event_stream(spark, d).select(F.concat_ws(":", "user_id", "event_type").alias("key"), F.col("event_id").alias("id"), "ts", F.coalesce("props", F.lit("")).alias("body"))
    return drained(stateful.outcomes(rows, "key", 400 * 86_400, n=buckets(spark, d)).where("id is not null")).select(F.col("id").alias("event_id"), "outcome")


# a job for each user and day of events: it is queued first, a purchase completes it, an error fails it, and six hours without an event end it
JOBS_SQL = """WITH e AS (SELECT event_id, user_id * 1000 + dayofyear(ts) AS job, floor(epoch(ts))::BIGINT AS second, event_type, ts FROM events),
n AS (SELECT *, row_number() OVER w AS place, lag(second) OVER w AS before FROM e WINDOW w AS (PARTITION BY job ORDER BY second, event_id)),
s AS (SELECT *, CASE WHEN place = 1 THEN 'queued' WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error' THEN 'failed' ELSE 'running' END AS state, coalesce(second - before > 21600, false) AS late FROM n),
u AS (SELECT *, coalesce(sum((state IN ('completed', 'failed'))::INT) OVER (PARTITION BY job ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended, sum(late::INT) OVER (PARTITION BY job ORDER BY place) AS expired FROM s),
k AS (SELECT * FROM u WHERE ended = 0 AND expired = 0)
SELECT job, event_id, state, second FROM k UNION ALL SELECT job, NULL, 'expired', max(second) + 21600 FROM k GROUP BY 1 HAVING NOT bool_or(state IN ('completed', 'failed'))"""


@query("job_feed", JOBS_SQL)
def job_feed(spark: SparkSession, d: str) -> DataFrame:
    """The states of jobs as a resumable feed delivers them, up to the first end state or six hours of silence."""
    rows = event_stream(spark, d)
    job = F.col("user_id") * 1000 + F.dayofyear("ts")
    first = table(spark, d, "events").groupBy((F.col("user_id") * 1000 + F.dayofyear("ts")).alias("job")).agg(F.min_by("event_id", F.struct(F.unix_seconds(F.col("ts").cast("timestamp")), "event_id")).alias("first"))
    kind = F.when(F.col("first").isNotNull(), "queued").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    told = rows.withColumn("job", job).join(first.withColumnRenamed("first", "event_id").withColumn("first", F.col("event_id")), ["job", "event_id"], "left")
    states = stateful.job_states(told.select(F.coalesce("job", F.lit(-1)).alias("job"), F.col("event_id").alias("id"), "ts", F.coalesce(kind, F.lit("")).alias("body")), "queued", ("completed", "failed"), 21_600, n=buckets(spark, d))
    return drained(states).where("job >= 0").select("job", F.col("id").alias("event_id"), "state", "second")


@query(
    "failed_attempt_lock",
    "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) >= 5 AS locked FROM events WHERE value < 25",
)
def failed_attempt_lock(spark: SparkSession, d: str) -> DataFrame:
    day = Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0)
    rows = events(spark, d).where("value < 25").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return rows.select("event_id", (F.count("*").over(day) >= 5).alias("locked"))
