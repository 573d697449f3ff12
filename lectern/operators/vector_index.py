"""A partitioned vector index: vectors in lists by their nearest centroid, searched by probing few lists.

Centroids are trained by Spark's k-means on a bounded sample; every vector is indexed. A list that many
vectors fall into is cut into parts by their ids, so that no task holds a list. A
search probes the lists whose centroids are nearest to the query and ranks their
vectors by the exact distance. `certified` then also probes each list that could
hold a nearer vector: none of its vectors is nearer to the query, as an angle, than its centroid
is, less the list's radius. What it returns is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.search import BLOCK_QUERIES, BLOCK_VECTORS, SLICE, cosine_distance, held_together, millionths, nearest, norm, score_pairs, top_k, units

#: Vectors that centroids are trained on, about, and the most lists: what the driver holds and sends to every task.
SAMPLE, MOST_LISTS = 65_536, 4096
#: Vectors of a part of a list.
PART = 65_536
#: Distances are rounded to 6 places: by so much an angle may be off, and a distance.
ANGLE_SLACK, DISTANCE_SLACK = 3e-3, 2e-6


def angle(distance: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - distance)))


@dataclass
class VectorIndex:
    """centers: list, embedding, vec_norm, size, radius, parts. lists: the vectors' columns with list and part."""

    centers: DataFrame
    lists: DataFrame
    key: str

    @classmethod
    def build(cls, vectors: DataFrame, key: str, lists: int | None = None, sample: int = SAMPLE, seed: int = 11) -> VectorIndex:
        """Indexes vectors (key, embedding, vec_norm, any others): all of one length, none zero. lists: by default the root of their number."""
        seen = vectors.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
        if not seen["n"]:
            raise ValueError("no vectors to index")
        if seen["least"] != seen["most"]:
            raise ValueError("vectors of more than one length")
        wanted = max(2, min(lists or round(seen["n"] ** 0.5), MOST_LISTS, seen["n"]))
        featured = vectors.withColumn("features", array_to_vector("embedding"))
        share = int(min(1.0, sample / seen["n"]) * 1_000_000)
        chosen = featured.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < share).select("features")
        model = KMeans(k=wanted, seed=seed, maxIter=8, distanceMeasure="cosine").fit(chosen)
        spark = vectors.sparkSession
        means = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        centers = spark.createDataFrame(means, "list int, embedding array<double>").withColumn("vec_norm", norm(F.col("embedding")))
        own = F.broadcast(centers.select("list", F.col("embedding").alias("c"), F.col("vec_norm").alias("c_norm")))  # MOST_LISTS rows at most
        placed = model.transform(featured).drop("features").withColumnRenamed("prediction", "list").join(own, "list")
        placed = placed.withColumn("from_center", angle(cosine_distance(F.col("c"), F.col("embedding"), F.col("c_norm"), F.col("vec_norm")))).drop("c", "c_norm")
        sizes = placed.groupBy("list").agg(F.count("*").alias("size"), F.max("from_center").alias("radius"))
        described = centers.join(sizes, "list").withColumn("parts", F.ceil(F.col("size") / PART).cast("int"))
        # a row per list, MOST_LISTS at most: computed once
        held = spark.createDataFrame(described.collect(), described.schema)
        cut = placed.drop("from_center").join(F.broadcast(held.select("list", "parts")), "list")
        return cls(held, cut.withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int")).drop("parts"), key)

    def save(self, name: str, buckets: int = 64) -> None:
        """Keeps the index as two tables; lists are bucketed, so that a probe reads them without a shuffle."""
        self.lists.write.mode("overwrite").bucketBy(buckets, "list", "part").sortBy("list", "part").saveAsTable(f"{name}_lists")
        self.centers.write.mode("overwrite").saveAsTable(f"{name}_centers")

    @classmethod
    def load(cls, spark: SparkSession, name: str, key: str) -> VectorIndex:
        return cls(spark.table(f"{name}_centers"), spark.table(f"{name}_lists"), key)

    def where(self, condition: str) -> VectorIndex:
        """The index over the vectors that meet a condition."""
        return VectorIndex(self.centers, self.lists.where(condition), self.key)

    def ranked_lists(self, queries: DataFrame) -> DataFrame:
        """query_id, list, parts, radius, distance, rn: the lists of each query, nearest centroid first."""
        return top_k(score_pairs(queries, self.centers), MOST_LISTS, ["query_id"], ["list"])

    def scored(self, queries: DataFrame, probes: DataFrame) -> DataFrame:
        """The vectors of the probed lists (query_id, list, parts) with their exact distances."""
        parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        asked = probes.select("query_id", "list", parts).join(queries, "query_id")
        pairs = self.lists.join(asked, ["list", "part"])
        distance = cosine_distance(F.col("q_vec"), F.col("embedding"), F.col("q_norm"), F.col("vec_norm"))
        return pairs.withColumn("distance", F.round(distance, 6)).drop("q_vec", "q_norm", "embedding", "vec_norm", "list", "part")

    def probed(self, queries: DataFrame, probes: DataFrame, k: int) -> DataFrame:
        """top_k of `scored` without its pairs: lists meet blocks of queries region by region, and a query goes to a region once, with the lists that it probes there."""
        key, none = self.key, (np.empty(0, np.int64),) * 3
        regions = max(1, -(-(self.centers.agg(F.sum("size")).first()[0] or 0) // BLOCK_VECTORS))
        blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
        region = F.pmod(F.xxhash64("list", "part"), F.lit(regions)).cast("int")
        asked = probes.select("query_id", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).withColumn("region_", region)
        asked = asked.groupBy("query_id", "region_").agg(F.collect_set("list").alias("lists_")).join(queries, "query_id")
        right = asked.withColumn("q_block_", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        left = self.lists.withColumn("region_", region).withColumn("q_block_", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def kept(v: pa.Table, q: pa.Table) -> tuple:
            sorting, n = pc.sort_indices(v, sort_keys=[(key, "ascending")], null_placement="at_start").to_numpy(), v.num_rows
            near, vectors, own = units(v, "embedding", "vec_norm")[sorting], units(q, "q_vec", "q_norm"), v["list"].to_numpy()[sorting]
            by_list = np.argsort(own, kind="stable")  # places in the order of the key, list by list
            lists, starts = np.unique(own[by_list], return_index=True)
            row = np.repeat(np.arange(q.num_rows), pc.list_value_length(q["lists_"]).to_numpy())
            wanted = np.concatenate([c.flatten().to_numpy() for c in q["lists_"].chunks])
            rows, found = [], []
            for x, place in zip(lists, np.split(by_list, starts[1:])):
                those = row[wanted == x]
                for at in range(0, len(those), SLICE):
                    some = those[at : at + SLICE]
                    ranked = millionths(vectors[some], near[place]) * n + place
                    ranked = np.partition(ranked, k - 1, axis=1)[:, :k] if len(place) > k else ranked
                    rows.append(np.repeat(some, ranked.shape[1]))
                    found.append(ranked.ravel())
            if not rows:
                return none
            rows, found = np.concatenate(rows), np.concatenate(found)
            order = np.lexsort((found, rows))
            rows, found = rows[order], found[order]
            begun = np.maximum.accumulate(np.where(np.diff(rows, prepend=-1) != 0, np.arange(len(rows)), 0))
            first = np.arange(len(rows)) - begun < k
            return sorting[found[first] % n], rows[first], found[first] // n

        columns = self.lists.drop("embedding", "vec_norm", "list", "part").schema, queries.drop("q_vec", "q_norm").schema
        return top_k(held_together(left, right, ["region_", "q_block_"], 2 * regions * blocks, *columns, kept), k, ["query_id"], [key])

    def approximate(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """The k nearest vectors of each query (query_id, q_vec, q_norm) among those of its `probes` nearest lists.

        A query that finds fewer than k there, as under a narrow condition, is compared with every vector.
        """
        near = self.ranked_lists(queries).where(F.col("rn") <= probes)
        found = top_k(self.scored(queries, near), k, ["query_id"], [self.key])
        enough = found.where(F.col("rn") == k).select("query_id")
        rest = queries.join(enough, "query_id", "left_anti")
        whole = nearest(rest, self.lists.drop("list", "part"), k, [], self.key)
        return found.join(enough, "query_id", "left_semi").unionByName(whole)

    def certified(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """The k nearest vectors of each query, exactly: after its `probes` nearest lists it probes the others that aren't ruled out."""
        lists = self.ranked_lists(queries)
        first = self.probed(queries, lists.where(F.col("rn") <= probes), k)
        reach = queries.select("query_id").join(first.where(F.col("rn") == k).select("query_id", F.col("distance").alias("reach")), "query_id", "left")
        least = F.greatest(F.lit(0.0), angle(F.col("distance")) - F.col("radius") - ANGLE_SLACK)
        open_ = lists.where(F.col("rn") > probes).join(reach, "query_id").where(F.col("reach").isNull() | (1 - F.cos(least) <= F.col("reach") + DISTANCE_SLACK))
        more = self.probed(queries, open_, k)
        return top_k(first.unionByName(more).drop("rn"), k, ["query_id"], [self.key])

    def probes_for(self, queries: DataFrame, k: int, target: float = 0.95) -> int:
        """The fewest probes, by doubling, that reach a recall on a bounded set of queries; their number must be small, as each is compared with all vectors."""
        want = nearest(queries, self.lists.drop("list", "part"), k, [], self.key).select("query_id", self.key).cache()
        lists, probes = self.centers.count(), 1
        while probes < lists:
            got = self.approximate(queries, k, probes).select("query_id", self.key)
            if got.join(want, ["query_id", self.key]).count() >= target * want.count():
                break
            probes *= 2
        want.unpersist()
        return min(probes, lists)


def search(vectors: DataFrame, queries: DataFrame, key: str, k: int, index: VectorIndex, probes: int) -> DataFrame:
    """The k nearest: all vectors are compared where the scope has k at most, else the index is asked."""
    scope = vectors.limit(k + 1).count()
    if scope <= k:
        return nearest(queries, vectors, k, [], key)
    return index.approximate(queries, k, probes)
