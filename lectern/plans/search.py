"""Vector search and ranking queries."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import chunking
from lectern.functions import text as t
from lectern.operators import retrieval, search, selection
from lectern.operators.batches import batched
from lectern.operators.vector_index import VectorIndex
from lectern.plans.base import CATALOG
from lectern.session import parts_for, table

SCORED_SQL = """
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q_vec FROM embeddings WHERE vec_id % 20 = 0),
scored AS (
  SELECT q.query_id, e.vec_id, e.label,
    round(greatest(0.0, least(2.0, 1 - list_dot_product(q.q_vec, e.embedding::DOUBLE[])
      / (sqrt(list_dot_product(q.q_vec, q.q_vec)) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))))), 6) AS distance
  FROM q, embeddings e)
"""


def asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stated set of queries, and all vectors."""
    vectors = search.with_norm(table(spark, sf_dir, "embeddings"))
    queries = vectors.where("vec_id % 20 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec"), F.col("vec_norm").alias("q_norm")
    )
    return queries, vectors


def nearest(spark: SparkSession, sf_dir: str, k: int, by: list[str], where: str | Column = "true", **limits: float) -> DataFrame:
    """The k nearest vectors of each query and group among those that meet a condition, with their place rn."""
    queries, vectors = asked(spark, sf_dir)
    return search.nearest(queries, vectors.where(where), k, by, "vec_id", **limits)


@CATALOG.query(
    "vector_topk",
    f"""WITH {SCORED_SQL}
SELECT query_id, vec_id, distance, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rn FROM scored) WHERE rn <= 10""",
)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, sf_dir, 10, []).select("query_id", "vec_id", "distance", "rn")


query = CATALOG.query


@query(
    "vector_topk_indexed",
    f"""WITH {SCORED_SQL}
SELECT query_id, vec_id, distance, rn FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rn FROM scored) WHERE rn <= 10""",
)
def vector_topk_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same through a partitioned index: near lists first, then those that the first ones' reach doesn't rule out."""
    queries, vectors = asked(spark, d)
    index = VectorIndex.build(vectors.select("vec_id", "embedding", "vec_norm"), "vec_id")
    return index.certified(queries, 10, 8).select("query_id", "vec_id", "distance", "rn")


@query("cosine_scores", f"WITH {SCORED_SQL} SELECT query_id, vec_id, distance, round(greatest(0.0, least(1.0, 1 - distance)), 6) AS sim FROM scored")
def cosine_scores(spark: SparkSession, d: str) -> DataFrame:
    queries, vectors = asked(spark, d)
    return search.score_pairs(queries, vectors.drop("label")).select("query_id", "vec_id", "distance", search.similarity_of_millionths(F.col("distance")).alias("sim"))


@query("vector_topk_filtered", f"WITH {SCORED_SQL} SELECT query_id, vec_id, distance, rn FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rn FROM scored WHERE label = 3) WHERE rn <= 5")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return nearest(spark, d, 5, [], "label = 3").select("query_id", "vec_id", "distance", "rn")


@query("vector_topk_per_doc", f"WITH {SCORED_SQL} SELECT query_id, label, vec_id, distance, rn FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY distance, vec_id) AS rn FROM scored) WHERE rn <= greatest(1, 25 // 10)")
def vector_topk_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return nearest(spark, d, max(1, 25 // 10), ["label"]).select("query_id", "label", "vec_id", "distance", "rn")


@query(
    "hits_dedup",
    f"""WITH {SCORED_SQL}, fetched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rn FROM scored) WHERE rn <= 25
  UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY distance, vec_id) AS rn FROM scored) WHERE rn <= 4),
said AS (SELECT DISTINCT query_id, vec_id, distance, 'text ' || vec_id % 10 AS same FROM fetched)
SELECT query_id, min_by(vec_id, {{'distance': distance, 'vec_id': vec_id}}) AS vec_id, same, count(*) AS dropped_with_it FROM said GROUP BY 1, 3""",
)
def hits_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of two fetches: one row for each id, and of those with one text (blanks collapsed) the nearest."""
    fetched = nearest(spark, d, 25, []).unionByName(nearest(spark, d, 4, ["label"]))
    said = F.concat(F.repeat(F.lit(" "), F.col("vec_id").cast("int") % 3), F.lit("text"), F.repeat(F.lit(" "), F.col("vec_id").cast("int") % 4 + 1), (F.col("vec_id") % 10).cast("string"))
    once = fetched.dropDuplicates(["query_id", "vec_id"]).withColumn("same", t.identity(said))
    first = Window.partitionBy("query_id", "same").orderBy("distance", "vec_id")
    kept = once.withColumns({"rn": F.row_number().over(first), "dropped_with_it": F.count("*").over(Window.partitionBy("query_id", "same"))}).where("rn = 1")
    return kept.select("query_id", "vec_id", "same", "dropped_with_it")


@query(
    "source_type_default",
    f"""WITH {SCORED_SQL} SELECT query_id, vec_id, distance, rn FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rn FROM scored WHERE label % 3 <> 1) WHERE rn <= 5""",
)
def source_type_default(spark: SparkSession, d: str) -> DataFrame:
    """The nearest chunks of type 'text'; a chunk without a type has it."""
    kind = F.when(F.col("label") % 3 == 0, F.lit(None).cast("string")).when(F.col("label") % 3 == 1, "image").otherwise("text")
    return nearest(spark, d, 5, [], F.coalesce(kind, F.lit("text")) == "text").select("query_id", "vec_id", "distance", "rn")


@query(
    "snapshot_guard",
    f"""WITH {SCORED_SQL}, top AS (SELECT query_id, vec_id, label FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10),
now AS (SELECT label, 1 + (count(*) % 5 = 0)::INT AS version FROM embeddings GROUP BY 1),
stale AS (SELECT DISTINCT query_id FROM top JOIN now USING (label) WHERE version <> 1)
SELECT query_id, vec_id FROM top WHERE query_id NOT IN (SELECT query_id FROM stale)""",
)
def snapshot_guard(spark: SparkSession, d: str) -> DataFrame:
    """Results whose documents have kept the version they were read at; a result goes whole if one of its documents hasn't."""
    top = nearest(spark, d, 10, []).select("query_id", "vec_id", "label").withColumn("read_version", F.lit(1))
    active = table(spark, d, "embeddings").groupBy("label").agg((F.lit(1) + (F.count("*") % 5 == 0).cast("int")).alias("version"))
    changed = F.max(F.coalesce(F.col("version") != F.col("read_version"), F.lit(True))).over(Window.partitionBy("query_id"))
    return top.join(active, "label", "left").withColumn("changed", changed).where("not changed").select("query_id", "vec_id")


@query(
    "coverage_round_robin",
    f"""WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY distance, vec_id) AS turn FROM scored),
c AS (SELECT *, sum(20 + vec_id % 7) OVER (PARTITION BY query_id ORDER BY turn, label ROWS UNBOUNDED PRECEDING) AS cost FROM r) SELECT query_id, label, turn, vec_id, cost::BIGINT AS cost FROM c WHERE cost <= 600""",
)
def coverage_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Sources take turns until the budget of 600 is spent; a chunk costs 20 at least, so 30 turns are enough."""
    turns = nearest(spark, d, 30, ["label"], turns=30).withColumnRenamed("rn", "turn")
    running = Window.partitionBy("query_id").orderBy("turn", "label").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("cost", F.sum(F.lit(20) + F.col("vec_id") % 7).over(running)).where("cost <= 600").select("query_id", "label", "turn", "vec_id", "cost")


# a section's own query finds what is nearer than 0.7 in it; where that is nothing, a wider one takes its three nearest
@query(
    "coverage_widened",
    f"""WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY distance, vec_id) AS place, min(distance) OVER (PARTITION BY query_id, label) < 0.7 AS found FROM scored),
pool AS (SELECT * FROM r WHERE CASE WHEN found THEN distance < 0.7 ELSE place <= 3 END), t AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY distance, vec_id) AS turn FROM pool),
c AS (SELECT *, sum(20 + vec_id % 7) OVER (PARTITION BY query_id ORDER BY turn, label ROWS UNBOUNDED PRECEDING) AS cost FROM t)
SELECT query_id, label, turn, vec_id, cost::BIGINT AS cost, NOT found AS widened FROM c WHERE cost <= 600""",
)
def coverage_widened(spark: SparkSession, d: str) -> DataFrame:
    """Sections take turns; those that their own query finds nothing in are asked once more, and only those."""
    queries, vectors = asked(spark, d)
    wanted = queries.select("query_id").crossJoin(vectors.select("label").distinct())  # a stated set by the sections
    pools = retrieval.widened(
        wanted, lambda groups: retrieval.fetched(search.nearest(queries, vectors, 30, ["label"], "vec_id", below=0.7), groups, 30),
        lambda groups: retrieval.fetched(search.nearest(queries, vectors, 3, ["label"], "vec_id"), groups, 3), ["query_id", "label"],
    )
    turns = search.top_k(pools.drop("rn"), 30, ["query_id", "label"], ["vec_id"]).withColumnRenamed("rn", "turn")
    running = Window.partitionBy("query_id").orderBy("turn", "label").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("cost", F.sum(F.lit(20) + F.col("vec_id") % 7).over(running)).where("cost <= 600").select("query_id", "label", "turn", "vec_id", "cost", "widened")


@query(
    "source_coverage",
    f"""WITH {SCORED_SQL}, n AS (SELECT query_id, label FROM scored WHERE distance < 0.75 GROUP BY 1, 2), want AS (SELECT q.query_id, l.label FROM q, (SELECT DISTINCT label FROM embeddings) l)
SELECT w.query_id, w.label, n.label IS NOT NULL AS covered FROM want w LEFT JOIN n ON n.query_id = w.query_id AND n.label = w.label""",
)
def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    return nearest(spark, d, 1, ["label"]).select("query_id", "label", (F.col("distance") < 0.75).alias("covered"))


def hits(spark: SparkSession, d: str, fetch: int = 25) -> DataFrame:
    """The nearest chunks of each query with their vectors, texts and costs."""
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    top = nearest(spark, d, fetch, []).join(vectors, "vec_id")
    return top.select(
        "query_id", F.col("label").cast("long").alias("doc"), F.col("vec_id").alias("idx"), F.concat(F.lit("chk_"), "vec_id").alias("chunk_id"),
        search.similarity(F.col("distance")).alias("sim"), "vec", F.concat(F.lit("text "), F.col("vec_id") % 400).alias("text"), (F.lit(40) + F.col("vec_id") % 50).cast("long").alias("cost"),
    )


HITS_SQL = f"""{SCORED_SQL}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rn FROM scored) WHERE rn <= 25),
hits AS (SELECT query_id, top.label::BIGINT AS doc, vec_id AS idx, greatest(0.0, least(1.0, 1 - distance)) AS sim, embedding::DOUBLE[] AS vec, 'text ' || vec_id % 400 AS said, 40 + vec_id % 50 AS cost FROM top JOIN embeddings USING (vec_id))"""


@query(
    "mmr_select",
    f"""WITH RECURSIVE {HITS_SQL}, own AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, idx) AS place FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, said ORDER BY sim DESC, idx) = 1),
near AS (SELECT a.query_id, a.idx, list({{'idx': b.idx, 'cos': list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec)) / sqrt(list_dot_product(b.vec, b.vec))}}) AS others FROM own a JOIN own b USING (query_id) GROUP BY 1, 2),
h AS (SELECT query_id, idx, sim, cost, place, others FROM own JOIN near USING (query_id, idx)),
s AS (SELECT query_id, []::BIGINT[] AS taken, []::BIGINT[] AS seen, 0::BIGINT AS spent FROM (SELECT DISTINCT query_id FROM h)
UNION ALL SELECT query_id, CASE WHEN spent + best.cost <= 500 THEN list_append(taken, best.idx) ELSE taken END, list_append(seen, best.idx), CASE WHEN spent + best.cost <= 500 THEN spent + best.cost ELSE spent END FROM (
  SELECT s.query_id, s.taken, s.seen, s.spent, max({{'worth': 0.7 * h.sim - 0.3 * coalesce(list_max(list_transform(list_filter(h.others, lambda x: list_contains(s.taken, x.idx)), lambda x: x.cos)), 0.0), 'order': -h.place, 'idx': h.idx, 'cost': h.cost}}) AS best
  FROM s JOIN h ON h.query_id = s.query_id AND NOT list_contains(s.seen, h.idx) WHERE len(s.taken) < 10 GROUP BY 1, 2, 3, 4)),
done AS (SELECT query_id, max_by(taken, len(seen)) AS taken FROM s GROUP BY 1)
SELECT query_id, 'chk_' || unnest(taken) AS chunk_id, generate_subscripts(taken, 1) AS place FROM done""",
)
def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    def select(rows: pd.DataFrame) -> pd.DataFrame:
        return selection.mmr(rows, 10, 0.7, 500)[["query_id", "chunk_id", "place"]]

    return hits(spark, d).groupBy("query_id").applyInPandas(select, "query_id long, chunk_id string, place long")


@query(
    "mmr_multi_source",
    f"""WITH RECURSIVE {HITS_SQL}, own AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc, idx) AS place FROM hits WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY query_id, doc, said ORDER BY sim DESC, idx) = 1),
options AS (SELECT query_id, doc, list({{'idx': idx, 'cost': cost}} ORDER BY place) AS options FROM own GROUP BY 1, 2),
cheap AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY query_id, doc ORDER BY cost, sim DESC, idx) = 1),
slots AS (SELECT query_id, doc, cost, count(*) OVER (PARTITION BY query_id) AS sources, row_number() OVER w AS slot, sum(cost) OVER w AS upto FROM cheap WINDOW w AS (PARTITION BY query_id ORDER BY cost, sim DESC, doc, idx)),
base AS (SELECT * FROM slots JOIN options USING (query_id, doc) WHERE upto <= 700),
raised AS (SELECT query_id, sources, count(*) AS slots, 0::BIGINT AS slot, sum(cost)::BIGINT AS spent, []::BIGINT[] AS taken FROM base GROUP BY 1, 2
UNION ALL SELECT query_id, sources, slots, slot + 1, spent - cost + pick.cost, list_append(taken, pick.idx) FROM (
  SELECT r.*, b.cost, list_filter(b.options, lambda x: r.spent - b.cost + x.cost <= 700)[1] AS pick FROM raised r JOIN base b ON b.query_id = r.query_id AND b.slot = r.slot + 1)),
near AS (SELECT a.query_id, a.idx, list({{'idx': b.idx, 'cos': list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec)) / sqrt(list_dot_product(b.vec, b.vec))}}) AS others FROM own a JOIN own b USING (query_id) GROUP BY 1, 2),
h AS (SELECT query_id, idx, sim, cost, place, others FROM own JOIN near USING (query_id, idx)),
s AS (SELECT query_id, sources, slots, taken, taken AS seen, spent FROM raised WHERE slot = slots
UNION ALL SELECT query_id, sources, slots, CASE WHEN spent + best.cost <= 700 THEN list_append(taken, best.idx) ELSE taken END, list_append(seen, best.idx), CASE WHEN spent + best.cost <= 700 THEN spent + best.cost ELSE spent END FROM (
  SELECT s.query_id, s.sources, s.slots, s.taken, s.seen, s.spent, max({{'worth': 0.7 * h.sim - 0.3 * list_max(list_transform(list_filter(h.others, lambda x: list_contains(s.taken, x.idx)), lambda x: x.cos)), 'order': -h.place, 'idx': h.idx, 'cost': h.cost}}) AS best
  FROM s JOIN h ON h.query_id = s.query_id AND NOT list_contains(s.seen, h.idx) WHERE s.slots = s.sources AND len(s.taken) < greatest(10, s.sources) GROUP BY 1, 2, 3, 4, 5, 6)),
done AS (SELECT query_id, max_by(taken, len(seen)) AS taken FROM s GROUP BY 1), each AS (SELECT query_id, unnest(taken) AS idx, generate_subscripts(taken, 1) AS place FROM done)
SELECT query_id, doc, 'chk_' || idx AS chunk_id, each.place FROM each JOIN own USING (query_id, idx)""",
)
def mmr_multi_source(spark: SparkSession, d: str) -> DataFrame:
    def select(rows: pd.DataFrame) -> pd.DataFrame:
        return selection.mmr_sources(rows, 10, 0.7, 700)[["query_id", "doc", "chunk_id", "place"]]

    return hits(spark, d).groupBy("query_id").applyInPandas(select, "query_id long, doc long, chunk_id string, place long")


FETCH_SQL = HITS_SQL.replace("rn <= 25", "rn <= 100")


# with 10 sources min(100, max(25, 15 * 10)) hits are fetched; the one with the smallest id is evidence already
@query(
    "mmr_with_evidence",
    f"""WITH RECURSIVE {FETCH_SQL}, prior AS (SELECT * FROM hits WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY idx) = 1),
own AS (SELECT hits.*, row_number() OVER (PARTITION BY hits.query_id ORDER BY hits.sim DESC, hits.doc, hits.idx) AS place FROM hits LEFT JOIN prior p ON p.query_id = hits.query_id AND (p.idx = hits.idx OR p.doc = hits.doc AND p.said = hits.said) WHERE hits.sim > 0 AND p.idx IS NULL QUALIFY row_number() OVER (PARTITION BY hits.query_id, hits.doc, hits.said ORDER BY hits.sim DESC, hits.idx) = 1),
options AS (SELECT query_id, doc, list({{'idx': idx, 'cost': cost}} ORDER BY place) AS options FROM own GROUP BY 1, 2),
cheap AS (SELECT * FROM own WHERE (query_id, doc) NOT IN (SELECT (query_id, doc) FROM prior) QUALIFY row_number() OVER (PARTITION BY query_id, doc ORDER BY cost, sim DESC, idx) = 1),
slots AS (SELECT query_id, doc, cost, count(*) OVER (PARTITION BY query_id) AS sources, row_number() OVER w AS slot, sum(cost) OVER w AS upto FROM cheap WINDOW w AS (PARTITION BY query_id ORDER BY cost, sim DESC, doc, idx)),
base AS (SELECT slots.*, options, p.cost AS had FROM slots JOIN options USING (query_id, doc) JOIN prior p USING (query_id) WHERE upto + p.cost <= 700),
raised AS (SELECT query_id, sources, count(*) AS slots, 0::BIGINT AS slot, (sum(cost) + max(had))::BIGINT AS spent, []::BIGINT[] AS taken FROM base GROUP BY 1, 2
UNION ALL SELECT query_id, sources, slots, slot + 1, spent - cost + pick.cost, list_append(taken, pick.idx) FROM (
  SELECT r.*, b.cost, list_filter(b.options, lambda x: r.spent - b.cost + x.cost <= 700)[1] AS pick FROM raised r JOIN base b ON b.query_id = r.query_id AND b.slot = r.slot + 1)),
near AS (SELECT a.query_id, a.idx, list({{'idx': b.idx, 'cos': list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec)) / sqrt(list_dot_product(b.vec, b.vec))}}) AS others FROM own a JOIN own b USING (query_id) GROUP BY 1, 2),
h AS (SELECT query_id, idx, sim, cost, place, others FROM own JOIN near USING (query_id, idx)),
s AS (SELECT query_id, sources, slots, taken, taken AS seen, spent FROM raised WHERE slot = slots
UNION ALL SELECT query_id, sources, slots, CASE WHEN spent + best.cost <= 700 THEN list_append(taken, best.idx) ELSE taken END, list_append(seen, best.idx), CASE WHEN spent + best.cost <= 700 THEN spent + best.cost ELSE spent END FROM (
  SELECT s.query_id, s.sources, s.slots, s.taken, s.seen, s.spent, max({{'worth': 0.7 * h.sim - 0.3 * list_max(list_transform(list_filter(h.others, lambda x: list_contains(s.taken, x.idx)), lambda x: x.cos)), 'order': -h.place, 'idx': h.idx, 'cost': h.cost}}) AS best
  FROM s JOIN h ON h.query_id = s.query_id AND NOT list_contains(s.seen, h.idx) WHERE s.slots = s.sources AND len(s.taken) < greatest(10, s.sources + 1) GROUP BY 1, 2, 3, 4, 5, 6)),
done AS (SELECT query_id, max_by(taken, len(seen)) AS taken FROM s GROUP BY 1), each AS (SELECT query_id, unnest(taken) AS idx, generate_subscripts(taken, 1) AS place FROM done)
SELECT query_id, doc, 'chk_' || idx AS chunk_id, each.place FROM each JOIN own USING (query_id, idx)""",
)
def mmr_with_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Several sources with evidence from before: it counts in the budget and covers its source."""

    def select(rows: pd.DataFrame) -> pd.DataFrame:
        return selection.mmr_sources(rows, 10, 0.7, 700, rows[rows["had"]])[["query_id", "doc", "chunk_id", "place"]]

    had = F.col("idx") == F.min(F.when(F.col("sim") > 0, F.col("idx"))).over(Window.partitionBy("query_id"))  # 100 rows of a query
    fetched = hits(spark, d, min(100, max(25, 15 * 10))).withColumn("had", F.coalesce(had, F.lit(False)))
    return fetched.groupBy("query_id").applyInPandas(select, "query_id long, doc long, chunk_id string, place long")


CHUNKS_SQL = r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, E'\n')) AS line, generate_subscripts(string_split(text, E'\n'), 1) AS no FROM documents),
said AS (SELECT doc_id, line, no, no - row_number() OVER (PARTITION BY doc_id ORDER BY no) AS block FROM l WHERE regexp_matches(line, '\S')),
blocks AS (SELECT doc_id, min(no) AS block, string_agg(line, E'\n' ORDER BY no) AS said FROM said GROUP BY doc_id, said.block),
-- parts of blocks: a block of over 825 tokens is cut at the last best gap before its 631st token
parts AS (
  SELECT doc_id, block, block AS line, said AS rest, NULL::VARCHAR AS part, NULL::BIGINT AS part_line, 0 AS n, len(regexp_extract_all(said, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) > 825 AS big FROM blocks
  UNION ALL
  SELECT doc_id, block, line + length(substr(rest, 1, cut)) - length(replace(substr(rest, 1, cut), E'\n', '')), substr(rest, cut + 1), substr(rest, 1, cut), line, n + 1, big FROM (
    SELECT *, CASE WHEN NOT big OR upto IS NULL THEN length(rest) ELSE coalesce(list_max(list_transform(list_filter(gaps, lambda g: g.cut IS NOT NULL), lambda g: {'worth': g.worth, 'cut': g.cut})).cut, upto) END::INT AS cut FROM (
      SELECT *, list_transform(range(1, len(runs) + 1), lambda i: CASE WHEN lower(regexp_extract(runs[i], '^\S*')) IN ('no', 'not', 'não', 'sin', 'excepto')
          OR regexp_extract(substr(rest, ends[i]::INT + 1, 64), '^\s*(\S*)', 1) IN ('ms', 's', 'MB', 'GB', 'KB', '%', 'kg') THEN {'worth': 0, 'cut': NULL::BIGINT}
          ELSE {'worth': CASE WHEN contains(runs[i], E'\n') THEN 2 WHEN regexp_matches(runs[i], '[.!?;]\s+$') THEN 1 ELSE 0 END, 'cut': ends[i]::BIGINT - CASE WHEN contains(runs[i], E'\n') THEN position(E'\n' IN reverse(runs[i])) - 1 ELSE 0 END} END) AS gaps FROM (
        SELECT *, list_transform(range(1, len(runs) + 1), lambda i: list_sum(list_transform(runs[1:i], lambda r: length(r)))) AS ends FROM (
          SELECT *, CASE WHEN upto IS NULL THEN [] ELSE regexp_extract_all(substr(rest, 1, upto::INT), '\S*\s+') END AS runs FROM (
            SELECT *, CASE WHEN big AND len(toks) > 630 THEN list_sum(list_transform(toks[1:630], lambda t: length(t))) + length(toks[631]) - length(regexp_extract(toks[631], '\S+$')) END AS upto FROM (
              SELECT *, CASE WHEN big THEN regexp_extract_all(rest, '\s*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])') ELSE [] END AS toks FROM parts WHERE rest <> ''))))))),
sized AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block, n) AS u, part AS said, part_line AS line, part_line + length(rtrim(part, E'\n')) - length(replace(rtrim(part, E'\n'), E'\n', '')) AS last, regexp_extract_all(part, '\s*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])') AS toks FROM parts WHERE part IS NOT NULL),
-- the last words of each part with at most 120 tokens
ended AS (SELECT *, len(toks) AS n, CASE WHEN len(toks) <= 120 THEN said ELSE (CASE WHEN regexp_matches(substr(said, list_sum(list_transform(toks[1:len(toks) - 120], lambda t: length(t)))::INT + 1), '\s') THEN regexp_replace(substr(said, list_sum(list_transform(toks[1:len(toks) - 120], lambda t: length(t)))::INT + 1), '^\S*\s+', '') ELSE '' END) END AS tail FROM sized),
units AS (SELECT doc_id, u, max(u) OVER (PARTITION BY doc_id) AS ends_at, n, {'said': said, 'line': line, 'last': last} AS unit, CASE WHEN tail = '' THEN [] ELSE [{'said': tail, 'line': line + length(said) - length(tail) - length(replace(substr(said, 1, (length(said) - length(tail))::INT), E'\n', '')), 'last': last}] END AS tail,
  len(regexp_extract_all(tail, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS tail_n FROM ended),
packed AS (
  SELECT DISTINCT doc_id, 0::BIGINT AS u, NULL::STRUCT(said VARCHAR, line BIGINT, "last" BIGINT)[] AS pack, 0::BIGINT AS size, false AS fresh, NULL::STRUCT(said VARCHAR, line BIGINT, "last" BIGINT)[] AS tail, 0::BIGINT AS tail_n, NULL::STRUCT(said VARCHAR, line BIGINT, "last" BIGINT)[] AS out1, 0::BIGINT AS size1, NULL::STRUCT(said VARCHAR, line BIGINT, "last" BIGINT)[] AS out2, 0::BIGINT AS size2 FROM units
  UNION ALL
  SELECT doc_id, u, CASE WHEN size3 >= 750 THEN tail ELSE pack3 END, CASE WHEN size3 >= 750 THEN tail_n ELSE size3 END, size3 < 750, tail, tail_n, out1, old_size, CASE WHEN size3 >= 750 OR u = ends_at THEN pack3 END, size3 FROM (
    SELECT *, list_append(CASE WHEN NOT fresh2 AND size2 + n > 825 THEN [] ELSE pack2 END, unit) AS pack3, CASE WHEN NOT fresh2 AND size2 + n > 825 THEN 0 ELSE size2 END + n AS size3 FROM (
      SELECT t.doc_id, t.u, t.ends_at, t.n, t.unit, t.tail, t.tail_n, p.size AS old_size, p.fresh AND p.size + t.n > 750 AS shut, CASE WHEN p.fresh AND p.size + t.n > 750 THEN p.pack END AS out1,
        CASE WHEN p.fresh AND p.size + t.n > 750 THEN p.tail ELSE coalesce(p.pack, []) END AS pack2, CASE WHEN p.fresh AND p.size + t.n > 750 THEN p.tail_n ELSE p.size END AS size2, p.fresh AND p.size + t.n <= 750 AS fresh2
      FROM packed p JOIN units t ON t.doc_id = p.doc_id AND t.u = p.u + 1))),
outs AS (SELECT doc_id, u, 1 AS k, out1 AS pack, size1 AS size FROM packed WHERE out1 IS NOT NULL UNION ALL SELECT doc_id, u, 2, out2, size2 FROM packed WHERE out2 IS NOT NULL)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY u, k) - 1)::INT AS idx, '(sin encabezados)' AS section, pack[1].line::INT AS line_start, pack[-1]."last"::INT AS line_end, size::INT AS tokens, sha256(array_to_string(list_transform(pack, lambda x: x.said), E'\n\n')) AS content, NULL::VARCHAR AS problem FROM outs"""


@query("chunks", CHUNKS_SQL)
def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Token-bounded chunks of every document; a document that can't be kept within the limits gives one row with the reason."""
    kind = "array<struct<idx:int,section:string,line_start:int,line_end:int,tokens:int,content:string,problem:string>>"

    def packed(text: str) -> list[tuple]:
        try:
            return [(i, c.section, c.first_line, c.last_line, c.tokens, hashlib.sha256(c.text.encode()).hexdigest(), None) for i, c in enumerate(chunking.chunks(text))]
        except chunking.Oversized as problem:
            return [(None, None, None, None, None, None, str(problem))]

    rows = table(spark, d, "documents").select("doc_id", "text")
    dealt = rows.repartition(parts_for(spark, rows.count(), 2000))  # a task's rows are one batch in Python, else one of 10,000
    return dealt.select("doc_id", F.explode(batched(packed, kind, F.col("text"))).alias("c")).select("doc_id", "c.*")


@query(
    "chunk_record_ids",
    "SELECT doc_id, idx, 'chk_' || substr(sha256('[\"' || source || '\",' || doc_id || ',' || idx || ',\"' || content || '\"]'), 1, 24) AS chunk_id FROM (" + CHUNKS_SQL + ") JOIN documents USING (doc_id)",
)
def chunk_record_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of the chunks themselves: each from its source, document, place and content."""
    rows = chunks(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    recipe = F.concat(F.lit('["'), "source", F.lit('",'), "doc_id", F.lit(","), "idx", F.lit(',"'), "content", F.lit('"]'))
    return rows.select("doc_id", "idx", F.concat(F.lit("chk_"), F.substring(F.sha2(recipe, 256), 1, 24)).alias("chunk_id"))
