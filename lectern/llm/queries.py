"""One query per operator, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.catalog import Catalog
from lectern.llm import bpe, byte_bpe, conversation, decontaminate, jaccard_join, lm_score, merkle, pii, secrets, simhash, substring_dedup, suffix_dedup, toxicity
from lectern.llm.common import checkpointed, documents, dropped

LLM_CATALOG = Catalog()


@LLM_CATALOG.query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir))


@LLM_CATALOG.query("op2_secrets", secrets.ORACLE)
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come in two deliveries: the second scan takes only contents that the first one's ledger lacks."""
    docs = documents(spark, sf_dir)
    first = docs.where(F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True)))
    ledger = checkpointed(secrets.scan(first))
    whole = checkpointed(secrets.scan(docs, ledger))
    dropped(ledger)
    return secrets.by_document(docs, whole)


@LLM_CATALOG.query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir))


@LLM_CATALOG.query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@LLM_CATALOG.query("op9_jaccard_join", jaccard_join.ORACLE)
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.connected(documents(spark, sf_dir))


@LLM_CATALOG.query("op5_substring_dedup", substring_dedup.ORACLE)
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(documents(spark, sf_dir))


@LLM_CATALOG.query("op10_decontaminate")
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@LLM_CATALOG.query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited(documents(spark, sf_dir))


@LLM_CATALOG.query("op6_lm_score")
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(documents(spark, sf_dir))


@LLM_CATALOG.query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(documents(spark, sf_dir))


@LLM_CATALOG.query("op11_conversation_repair", conversation.ORACLE)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@LLM_CATALOG.query("op12_merkle", merkle.ORACLE)
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


@LLM_CATALOG.query("op13_byte_bpe")
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(documents(spark, sf_dir))
