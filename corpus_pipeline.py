"""The corpus pipeline: toxic documents go, one of each group of near copies stays,
documents with benchmark passages go, personal data is redacted, texts are encoded.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. Rows without an id can't be named in a group or a label and pass the
first two stages' joins untouched; rows without text are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import bpe, decontaminate, jaccard_join, pii, toxicity
from lectern.llm.common import documents, dropped, fresh, settled

TOXIC_FROM = 0.3
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches TOXIC_FROM go. Null text counts as empty, and an empty text stays; repeated rows share their fate."""
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh("toxicity", docs)
    return toxicity.with_scores(docs, model, score).where(F.col(score) < TOXIC_FROM).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by the Jaccard similarity of word shingles the document with the smallest id stays.

    If an id stands on several rows with words, the row with the smallest text stays; of equal rows one does.
    """
    named = jaccard_join.connected(docs.select("doc_id", "text"), SHINGLE_WORDS, SIMILAR_PERCENT)
    kept = named.where("doc_id is not null and doc_id = component_id").select("doc_id").distinct()
    worded, place = fresh("worded", docs), fresh("place", docs)
    has_words = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").withColumn(worded, has_words)
    order = Window.partitionBy("doc_id", worded).orderBy("text")
    chosen = rows.withColumn(place, F.row_number().over(order)).where((F.col(place) == 1) | ~F.col(worded))
    return chosen.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. Null and empty texts hold none; repeated rows share their fate."""
    matched = fresh("matched", docs)
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name=matched)
    return found.where(F.size(matched) == 0).drop(matched)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text is replaced by marks of its kind; n_chars follows. Null text stays null."""
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the token ids, and the digests of ids and decoded text, for each row; null text counts as empty."""
    return bpe.encode(docs, keep=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pii", redact_pii),
    ("bpe", encode_text),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        kept = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if k:
            dropped(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
