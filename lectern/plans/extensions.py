"""Engine extensions beyond the registry and retrieval queries: grouping sets, set operations, as-of and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.plans.base import CATALOG
from lectern.session import table

query = CATALOG.query
GROUPED = "coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n"


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n")


@query("ext_rollup", f"SELECT {GROUPED} FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def ext_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority"))


@query("ext_cube", f"SELECT {GROUPED} FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def ext_cube(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority"))


@query("ext_intersect", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def ext_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("ext_except", "SELECT p_partkey AS part FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def ext_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("part")).subtract(table(spark, d, "lineitem").where("l_quantity > 45").select("l_partkey"))


@query("ext_asof", "WITH a AS (SELECT * FROM events WHERE event_type = 'purchase'), b AS (SELECT * FROM events WHERE event_type <> 'purchase') SELECT a.event_id, max_by(b.event_id, (b.ts, b.event_id)) AS before FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.ts <= a.ts GROUP BY 1")
def ext_asof(spark: SparkSession, d: str) -> DataFrame:
    """The last other event of the user at each purchase: one sort by user and time instead of a range join."""
    rows = table(spark, d, "events").withColumn("bought", F.col("event_type") == "purchase")
    past = Window.partitionBy("user_id").orderBy("ts", "bought", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(~F.col("bought"), F.col("event_id")), ignorenulls=True).over(past)
    return rows.withColumn("before", seen).where("bought").select("event_id", "before")


@query("ext_approx_distinct", "SELECT event_type, count(DISTINCT user_id) AS exact, true AS near FROM events GROUP BY 1")
def ext_approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Each user of a type counts once in both, so a sketch is held for each type, not for each user."""
    users = table(spark, d, "events").select("event_type", "user_id").distinct()
    rows = users.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count("user_id").alias("n"))
    return rows.select("event_type", F.col("n").alias("exact"), (F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("near"))


@query("ext_tumbling", "SELECT event_type, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def ext_tumbling(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return rows.select("event_type", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "total")


@query(
    "ext_sliding",
    "SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1",
)
def ext_sliding(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query(
    "ext_session_window",
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def ext_session_window(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
