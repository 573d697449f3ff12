"""What keeps a task's memory from growing with the tables, read from plans."""

import re

from lectern.plans import CATALOG

DATA = "/root/testdata/sf0.001"


def plan(spark, name):
    return CATALOG.queries[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_sketches_are_held_by_type_alone(spark):
    """Beside a distinct count Spark held a sketch for each user of a type."""
    for keys in re.findall(r"keys=\[([^\]]*)\], functions=\[[^\]]*approx_count_distinct", plan(spark, "ext_approx_distinct")):
        assert "event_type" in keys and "user_id" not in keys


def test_claims_and_verdicts_are_counted_without_a_join(spark):
    """One exchange by evaluation, into partitions whose number grows with the input; a full join sorted both sides."""
    told = plan(spark, "quality_verdict")
    assert "Join" not in told and told.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in told


def test_chains_are_dealt_to_partitions_by_their_number(spark, monkeypatch):
    """Spark merged the partitions of each sort to a size in bytes; now each exchange of the chain's steps has a number that follows the rows."""
    from lectern.operators import trees
    from lectern.session import Rounds, parts_for

    told, plain = [], Rounds.__call__
    monkeypatch.setattr(Rounds, "__call__", lambda self, rows: told.append(rows._jdf.queryExecution().executedPlan().toString()) or plain(self, rows))
    CATALOG.queries["prune_chain"](spark, DATA)
    assert len(told) > 2
    for each in told:
        assert "REPARTITION_BY_NUM" in each and "ENSURE_REQUIREMENTS" not in each
    told.clear()
    nodes = spark.createDataFrame([(1, i, i - 1 if i else None, i == 7) for i in range(12)], "tree long, node long, parent long, dead boolean")
    left, _ = trees.surviving(nodes, "tree", "node", "parent", "dead", parts=3)
    assert sorted(r.node for r in left.collect()) == list(range(7)) and ", 3), REPARTITION_BY_NUM" in told[0]
    assert parts_for(spark, 10) == spark.sparkContext.defaultParallelism and parts_for(spark, 216_000_000) == 864


def test_texts_of_a_task_are_few(spark, tmp_path):
    """The number of tasks that cut chunks follows the rows, so Python never holds a batch of 10,000 texts."""
    spark.range(20_000).selectExpr("id AS doc_id", "'a' AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert "RoundRobinPartitioning(10)" in CATALOG.queries["chunks"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_every_pair_costs_no_decimal(spark):
    """F.round made a decimal of each of the pairs; the sum in doubles gives the same for every distance there is. The pairs carry ids alone."""
    from pyspark.sql import functions as F

    from lectern.operators import search

    told = plan(spark, "cosine_scores")
    assert "round(" not in told and "label" not in told
    all_ = spark.range(2_000_001).select((F.col("id") / 1e6).alias("distance"))
    assert all_.where(search.similarity_of_millionths(F.col("distance")) != F.round(search.similarity(F.col("distance")), 6)).count() == 0


def test_every_pair_copies_no_block(spark):
    """Each block of vectors went to disk once for each block of queries, and the other way round: the shuffle grew as the product of both. Now a block is written once, packed."""
    told = plan(spark, "cosine_scores")
    assert "Generate" not in told and "CoGroup" not in told
    below = told[told.index("CartesianProduct") :].splitlines()
    assert sum("Exchange" in line for line in below) == 4 and sum(" collect_list(" in line or "[collect_list(" in line for line in below) == 2
