"""The catalog that the plan modules fill, and the registry relations over the driver tables.

Each relation has a DataFrame form and a SQL form (for the oracle's WITH list).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.catalog import Catalog
from lectern.session import table

CATALOG = Catalog()
NOW = "2024-01-20 00:00:00"

GEN = """gen AS (SELECT o_orderkey AS gen_id, o_custkey AS workspace, o_orderstatus AS status, o_orderdate AS created, o_totalprice AS price, o_orderpriority AS format,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 997 + 1 END AS primary_doc FROM orders)"""
DOC = """doc AS (SELECT p_partkey AS doc_id, p_partkey % 150 + 1 AS workspace, p_name AS title, p_size AS pages, p_brand AS brand, p_type AS kind, p_retailprice AS price FROM part)"""
LINK = "link AS (SELECT DISTINCT l_orderkey AS gen_id, l_partkey AS doc_id FROM lineitem)"
WS = """ws AS (SELECT c_custkey AS workspace, c_name AS name, c_mktsegment AS profile, c_acctbal AS balance, c_acctbal < 0 AS deleted,
  TIMESTAMP '2024-01-01 00:00:00' + to_days(c_custkey % 40) AS expires FROM customer)"""
TOMB = """tomb AS (SELECT 'doc' AS kind, p_partkey AS id FROM part WHERE p_partkey % 17 = 0
  UNION ALL SELECT 'gen', o_orderkey FROM orders WHERE o_orderkey % 23 = 0)"""
ADM = "adm AS (SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN 'queued' ELSE 'failed' END AS state, p_size % 4 AS attempts FROM part WHERE p_partkey % 5 < 2)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def generations(spark: SparkSession, d: str) -> DataFrame:
    primary = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 997 + 1)
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("gen_id"), F.col("o_custkey").alias("workspace"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created"),
        F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("format"), primary.alias("primary_doc"),
    )


def registry_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("doc_id"), (F.col("p_partkey") % 150 + 1).alias("workspace"), F.col("p_name").alias("title"), F.col("p_size").alias("pages"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_retailprice").alias("price"),
    )


def links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("gen_id"), F.col("l_partkey").alias("doc_id")).distinct()


def workspaces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("workspace"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("profile"), F.col("c_acctbal").alias("balance"),
        (F.col("c_acctbal") < 0).alias("deleted"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 40 as int))").alias("expires"),
    )


def retired(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Ids with a tombstone, of documents ('doc') or generations ('gen')."""
    if kind == "doc":
        return table(spark, d, "part").where("p_partkey % 17 = 0").select(F.col("p_partkey").alias("doc_id"))
    return table(spark, d, "orders").where("o_orderkey % 23 = 0").select(F.col("o_orderkey").alias("gen_id"))


def admissions(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("p_partkey") % 3 == 0, "queued").otherwise("failed")
    return table(spark, d, "part").where("p_partkey % 5 < 2").select(F.col("p_partkey").alias("doc_id"), state.alias("state"), (F.col("p_size") % 4).alias("attempts"))


def stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
