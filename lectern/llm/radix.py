"""Exact ranks inside groups, from histograms of the key's digits instead of a sort of all rows.

Keys are counted by their value, these counts by the value without its last
digit, and so on up to the first digit in which keys differ. From there down, a
prefix starts where its parent starts plus what its smaller siblings hold, and
a parent has at most 2^DIGIT children. So no window is wider than that,
whatever a group holds, and only counts are moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed, dropped

#: Bits of a digit.
DIGIT = 10


def offsets(counts: DataFrame, group: list[str], key: str) -> DataFrame:
    """counts (group, key, n; one row each, a long key that isn't null) and before_: how many of the group have a smaller key."""
    ends = counts.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    bits = 1 if ends["a"] is None else ((ends["a"] ^ ends["b"]) & (2**64 - 1)).bit_length()
    levels = max(1, -(-bits // DIGIT))
    unsigned = F.col(key).bitwiseXOR(F.lit(-(2**63)))
    steps = [counts.select(*group, unsigned.alias("prefix_"), F.col("n").alias("n_"))]
    parent = F.shiftrightunsigned("prefix_", DIGIT)
    for _ in range(levels - 1):
        steps.append(steps[-1].groupBy(*group, parent.alias("prefix_")).agg(F.sum("n_").alias("n_")))
    siblings = Window.partitionBy(*group, "parent_").orderBy(F.col("prefix_").bitwiseAND(F.lit(2**DIGIT - 1))).rowsBetween(Window.unboundedPreceding, -1)
    above = None
    for step in reversed(steps):
        level = step.withColumn("parent_", parent).withColumn("before_", F.coalesce(F.sum("n_").over(siblings), F.lit(0)))
        if above is not None:
            level = level.join(above, [*group, "parent_"]).withColumn("before_", F.col("before_") + F.col("start_"))
        above = level.select(*group, F.col("prefix_").alias("parent_"), F.col("before_").alias("start_"))
    return counts.withColumn("parent_", unsigned).join(above.withColumnRenamed("start_", "before_"), [*group, "parent_"]).drop("parent_")


def ranked(rows: DataFrame, group: str, key: str, tie: str) -> DataFrame:
    """rows and rank: the place from 0 on of each row in its group by key (a long; null first), then by tie, a hexadecimal digest.

    group and tie aren't null, and rows with equal (group, key, tie) are equal in all columns; each of n such rows gets its own rank.
    """
    distinct = checkpointed(rows.groupBy(*rows.columns).agg(F.count("*").alias("n_")))
    ids = checkpointed(distinct.groupBy(group, key).agg(F.sum("n_").alias("n"), F.count("*").alias("kinds_")))
    nulls = ids.where(F.col(key).isNull()).select(group, F.col("n").alias("nulls_"))
    placed = offsets(ids.where(F.col(key).isNotNull()).select(group, key, "n"), [group], key)
    starts = placed.join(nulls, group, "left").select(group, key, (F.col("before_") + F.coalesce("nulls_", F.lit(0))).alias("start_"))
    starts = starts.union(nulls.select(group, F.lit(None).cast("long"), F.lit(0).cast("long")))

    # null keys are equal here: joined by a flag and a filled value
    filled = {"null_": F.col(key).isNull(), "key_": F.coalesce(F.col(key), F.lit(0))}
    out = distinct.withColumns(filled).join(starts.withColumns(filled).drop(key), [group, "null_", "key_"])
    if (ids.agg(F.max("kinds_").alias("m")).first()["m"] or 0) > 1:
        digits = F.conv(F.substring(tie, 1, 15), 16, 10).cast("long")
        several = ids.where("kinds_ > 1").withColumns(filled).select(group, "null_", "key_")
        many = distinct.withColumns(filled).join(several, [group, "null_", "key_"], "left_semi")
        many = many.withColumn("digits_", digits)
        heads = offsets(many.groupBy(group, "null_", "key_", "digits_").agg(F.sum("n_").alias("n")), [group, "null_", "key_"], "digits_")
        same = Window.partitionBy(group, "null_", "key_", "digits_").orderBy(tie).rowsBetween(Window.unboundedPreceding, -1)
        inner = many.withColumn("ahead_", F.coalesce(F.sum("n_").over(same), F.lit(0))).join(heads.drop("n"), [group, "null_", "key_", "digits_"])
        inner = inner.select(group, "null_", "key_", tie, (F.col("ahead_") + F.col("before_")).alias("inner_"))
        out = out.join(inner, [group, "null_", "key_", tie], "left").withColumn("start_", F.col("start_") + F.coalesce("inner_", F.lit(0)))
    copies = out.withColumn("copy_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_") - 1)))
    done = checkpointed(copies.select(*rows.columns, (F.col("start_") + F.col("copy_")).alias("rank")))
    dropped(distinct, ids)
    return done
