import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import search
from lectern.operators.vector_index import VectorIndex
from lectern.operators.vector_index import search as index_search

FOLDER = "/root/testdata/sf0.01"


def told(rows):
    return sorted((r.query_id, r.vec_id, r.distance) for r in rows.select("query_id", "vec_id", "distance").collect())


def asked(vectors, every=20):
    return vectors.where(f"vec_id % {every} = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec"), F.col("vec_norm").alias("q_norm"))


@pytest.fixture(scope="module")
def given(spark):
    vectors = search.with_norm(spark.read.parquet(f"{FOLDER}/embeddings.parquet")).cache()
    return vectors, asked(vectors), VectorIndex.build(vectors, "vec_id")


def test_recall_and_exactness_on_the_table(given):
    vectors, queries, index = given
    exact = told(search.top_k(search.score_pairs(queries, vectors), 10, ["query_id"], ["vec_id"]))
    probes = index.probes_for(asked(vectors, 60), 10, 0.95)
    assert probes < index.centers.count()
    near = told(index.approximate(queries, 10, probes))
    assert len(set(near) & set(exact)) >= 0.9 * len(exact)
    assert told(index.certified(queries, 10, 2)) == exact


def test_narrow_scopes_are_exact(given):
    vectors, queries, index = given
    few = vectors.where("label = 3 and vec_id % 7 = 0")
    want = told(search.top_k(search.score_pairs(queries, few), 10, ["query_id"], ["vec_id"]))
    assert told(index.where("label = 3 and vec_id % 7 = 0").approximate(queries, 10, 1)) == want
    assert told(index_search(few, queries, "vec_id", 100, index, 1)) == told(search.top_k(search.score_pairs(queries, few), 100, ["query_id"], ["vec_id"]))


def test_copies_fill_a_list_in_parts(spark, monkeypatch):
    """A third of the vectors are one vector: their list is cut, and no match is lost."""
    monkeypatch.setattr("lectern.operators.vector_index.PART", 50)
    rnd = np.random.default_rng(5)
    made = np.vstack([np.tile(rnd.normal(size=8), (300, 1)), rnd.normal(size=(600, 8))])
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(made)], "vec_id long, embedding array<double>")
    vectors = search.with_norm(rows)
    index = VectorIndex.build(vectors, "vec_id", lists=12)
    assert index.centers.agg(F.max("parts")).first()[0] >= 6
    queries = asked(vectors, 100)
    assert told(index.certified(queries, 7, 1)) == told(search.top_k(search.score_pairs(queries, vectors), 7, ["query_id"], ["vec_id"]))


def test_saved_lists_are_read_without_a_shuffle(spark, given, tmp_path):
    vectors, queries, index = given
    name = "index_under_test"
    index.save(name, buckets=4)
    try:
        held = VectorIndex.load(spark, name, "vec_id")
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            lists = held.ranked_lists(queries).where("rn <= 3")
            plan = held.scored(queries, lists)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        below = plan[plan.index("SortMergeJoin [list") :] if "SortMergeJoin [list" in plan else plan
        assert "Bucketed: true" in plan and "hashpartitioning(list#" in below and below.count("Exchange hashpartitioning(list") == 1
        assert told(held.certified(queries, 10, 2)) == told(index.certified(queries, 10, 2))
    finally:
        spark.sql(f"DROP TABLE {name}_lists")
        spark.sql(f"DROP TABLE {name}_centers")


def test_refused(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        VectorIndex.build(search.with_norm(rows), "vec_id")
    with pytest.raises(ValueError):
        VectorIndex.build(search.with_norm(rows.limit(0)), "vec_id")


def test_nearest_equals_all_pairs(spark):
    """Blocks keep what top_k of all pairs has, with many copies of one vector, by groups and without, and compare vectors of one size only."""
    rnd = np.random.default_rng(3)
    made = np.vstack([np.tile(rnd.normal(size=8), (150, 1)), rnd.normal(size=(350, 8))])
    rows = [(i, [float(x) for x in v], i % 4) for i, v in enumerate(made)] + [(900 + i, [1.0, float(i)], 0) for i in range(40)]
    vectors = search.with_norm(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3))
    queries, small = asked(vectors), {"block_queries": 7, "block_vectors": 60}
    lengths = {r.vec_id: len(r.embedding) for r in vectors.collect()}
    every = search.score_pairs(queries, vectors, 5, 50)
    assert every.count() == sum(lengths[a] == lengths[b] for a in lengths for b in lengths if a % 20 == 0)
    by_expression = vectors.join(queries, F.size("q_vec") == F.size("embedding")).withColumn("distance", F.round(search.cosine_distance(F.col("q_vec"), F.col("embedding"), F.col("q_norm"), F.col("vec_norm")), 6))
    assert told(every) == told(by_expression)
    for by, k in (([], 10), (["label"], 3)):
        assert told(search.nearest(queries, vectors, k, by, "vec_id", **small)) == told(search.top_k(every, k, ["query_id", *by], ["vec_id"]))
    ranked = search.top_k(every, 30, ["query_id", "label"], ["vec_id"])
    first = lambda rows: told(search.top_k(rows.withColumn("distance", F.col("rn") * 10.0 + F.col("label")), 6, ["query_id"], ["vec_id"]))
    assert first(search.nearest(queries, vectors, 30, ["label"], "vec_id", turns=6, **small)) == first(ranked)
    assert told(search.nearest(queries, vectors, 2, ["label"], "vec_id", below=0.6, **small)) == told(search.top_k(every.where("distance < 0.6"), 2, ["query_id", "label"], ["vec_id"]))
    assert search.nearest(queries.limit(0), vectors, 3, [], "vec_id").count() == 0 == search.nearest(queries, vectors.limit(0), 3, [], "vec_id").count()


def test_pairs_of_blocks_leave_by_distance(spark):
    """Equal distances stand together, over all pieces of two blocks, so that a file of them is small; every pair is there once."""
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v], str(i)) for i, v in enumerate(rnd.normal(size=(450, 8)))]
    vectors = search.with_norm(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    queries = vectors.selectExpr("vec_id AS query_id", "embedding AS q_vec", "vec_norm AS q_norm")
    found = search.score_pairs(queries, vectors, 450, 450).toPandas()
    assert len(found) == 450 * 450 > search.PIECE and not found.duplicated(["query_id", "vec_id"]).any()
    assert found["distance"].is_monotonic_increasing and (found["label"] == found["vec_id"].astype(str)).all()
    assert told(search.score_pairs(queries, vectors, 60, 70)) == told(search.score_pairs(queries, vectors, 450, 450))


def test_pairs_of_copies(spark):
    """Rows that are alike to the last column fall into one block, which a task takes in parts; without queries or vectors there are no pairs."""
    vectors = search.with_norm(spark.createDataFrame([(20, [1.0, 2.0])] * 90 + [(i, [1.0, float(i)]) for i in range(30)], "vec_id long, embedding array<double>"))
    queries = asked(vectors)
    found = search.score_pairs(queries, vectors, 7, 11)
    assert found.count() == queries.count() * 120 == 92 * 120
    assert found.where("query_id = 20 AND vec_id = 20 AND distance = 0").count() >= 90 * 90
    assert search.score_pairs(queries.limit(0), vectors).count() == 0 == search.score_pairs(queries, vectors.limit(0)).count()


def test_a_task_holds_few_of_the_best(spark):
    """What leaves the blocks is k rows for each query and block, not all pairs."""
    rnd = np.random.default_rng(4)
    vectors = search.with_norm(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rnd.normal(size=(2000, 8)))], "vec_id long, embedding array<double>"))
    plan = search.nearest(asked(vectors), vectors, 3, [], "vec_id")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_probed_keeps_what_scored_has(spark, given, monkeypatch):
    """The lists that a query probes meet it region by region; what comes back is top_k of all their pairs, which the certified search no longer makes."""
    vectors, queries, index = given
    monkeypatch.setattr("lectern.operators.vector_index.BLOCK_VECTORS", 30)
    monkeypatch.setattr("lectern.operators.vector_index.BLOCK_QUERIES", 4)
    few = queries.where("query_id % 100 = 0")
    lists = index.ranked_lists(few).where("rn in (1, 2, 5)")
    found = index.probed(few, lists, 4)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert told(found) == told(search.top_k(index.scored(few, lists), 4, ["query_id"], ["vec_id"]))
