"""Data invariants as queries: each gives the rows it checks and whether they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.plans.base import CATALOG
from lectern.session import table

query = CATALOG.query


@query(
    "request_sources",
    """WITH s AS (SELECT l_orderkey AS request, list_sort(list_distinct(list(l_partkey))) AS ids FROM lineitem GROUP BY 1)
SELECT request, array_to_string(ids[1:5], ',') AS sources, ids[1] AS primary_source, len(ids) > 5 AS too_many FROM s""",
)
def request_sources(spark: SparkSession, d: str) -> DataFrame:
    """Source ids distinct, sorted, five at most; the first is the primary one."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("request")).agg(F.sort_array(F.collect_set("l_partkey")).alias("ids"))
    said = F.array_join(F.transform(F.slice("ids", 1, 5), lambda x: x.cast("string")), ",")
    return rows.select("request", said.alias("sources"), F.element_at("ids", 1).alias("primary_source"), (F.size("ids") > 5).alias("too_many"))


@query("query_text", "SELECT doc_id, sha256(substr(concat_ws(' | ', lang, source, substr(text, 1, 1990)), 1, 2000)) AS query_digest FROM documents")
def query_text(spark: SparkSession, d: str) -> DataFrame:
    built = F.substring(F.concat_ws(" | ", "lang", "source", F.substring("text", 1, 1990)), 1, 2000)
    return table(spark, d, "documents").select("doc_id", F.sha2(built, 256).alias("query_digest"))


@query(
    "date_validation",
    """SELECT event_id, raw, regexp_full_match(raw, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(raw AS DATE) IS NOT NULL AS valid FROM (
SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-02-%d') WHEN 2 THEN month(ts) || '-' || strftime(ts, '%Y-%d') WHEN 3 THEN event_type ELSE strftime(ts, '%Y-%m-%d %H') END AS raw FROM events)""",
)
def date_validation(spark: SparkSession, d: str) -> DataFrame:
    """Which of the dates of events, written in five ways, are real days in the one form that counts."""
    kind, said = F.col("event_id") % 5, lambda form: F.date_format("ts", form)
    raw = (
        F.when(kind == 0, said("yyyy-MM-dd")).when(kind == 1, said("yyyy-'02'-dd")).when(kind == 2, F.concat_ws("-", F.month("ts").cast("string"), said("yyyy-dd")))
        .when(kind == 3, F.col("event_type")).otherwise(said("yyyy-MM-dd HH"))
    )
    real = F.col("raw").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date("raw", "yyyy-MM-dd").isNotNull()
    return table(spark, d, "events").select("event_id", raw.alias("raw")).withColumn("valid", F.coalesce(real, F.lit(False)))


@query("event_order", "SELECT user_id, count(*) AS n, bool_and(coalesce(ts >= before, true)) AS ordered FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) GROUP BY 1")
def event_order(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, d, "events").select("user_id", F.coalesce(F.col("ts") >= before, F.lit(True)).alias("ok"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.bool_and("ok").alias("ordered"))


@query(
    "human_approval",
    """SELECT doc_id, least(doc_id % 5, (doc_id + 1) % 5, quality * 5, 5 - toxic * 5) >= 3 AS approved FROM labels""",
)
def human_approval(spark: SparkSession, d: str) -> DataFrame:
    """Approved only if each of the four ratings is 3 or more."""
    i = F.col("doc_id")
    ratings = F.least(i % 5, (i + 1) % 5, F.col("quality") * 5, 5 - F.col("toxic") * 5)
    return table(spark, d, "labels").select("doc_id", (ratings >= 3).alias("approved"))


@query("chunk_integrity", """WITH c AS (SELECT doc_id, unnest(string_split(text, E'\\n')) AS said FROM documents), n AS (SELECT doc_id, count(*) AS chunks, count(DISTINCT sha256(said)) AS different FROM c WHERE trim(said) <> '' GROUP BY 1)
SELECT doc_id, coalesce(chunks, 0) AS chunks, coalesce(different, 0) AS different, coalesce(chunks, 0) > 0 AS ready FROM documents LEFT JOIN n USING (doc_id)""")
def chunk_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Ready documents have chunks; counts as the index row should have them. Narrow: no shuffle is needed."""
    own = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    different = F.size(F.array_distinct(own)).cast("bigint")
    return table(spark, d, "documents").select("doc_id", F.size(own).cast("bigint").alias("chunks"), different.alias("different"), (F.size(own) > 0).alias("ready"))
