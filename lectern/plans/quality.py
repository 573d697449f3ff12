"""Claim-level faithfulness, verdicts and the judge-versus-human report, over lineitem (claims), orders (evaluations) and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.plans.base import CATALOG
from lectern.session import table

query = CATALOG.query
CLAIMS = """claim AS (SELECT o_orderkey AS eval_id, c.c AS claim_id FROM orders, range(5) c(c) WHERE c.c < o_orderkey % 6),
verdict AS (SELECT DISTINCT l_orderkey AS eval_id, l_linenumber % 6 AS claim_id, l_returnflag <> 'R' AS supported FROM lineitem),
v AS (SELECT eval_id, claim_id, count(*) AS n, bool_and(supported) AS supported FROM verdict GROUP BY 1, 2),
checked AS (SELECT coalesce(c.eval_id, v.eval_id) AS eval_id, count(*) FILTER (c.claim_id IS NOT NULL AND v.claim_id IS NULL) AS missing, count(*) FILTER (c.claim_id IS NULL) AS beyond,
  coalesce(sum(CASE WHEN v.n > 1 THEN 1 ELSE 0 END), 0)::BIGINT AS twice, count(c.claim_id) AS claims, count(*) FILTER (c.claim_id IS NOT NULL AND v.supported) AS supported FROM claim c FULL JOIN v ON c.eval_id = v.eval_id AND c.claim_id = v.claim_id GROUP BY 1)"""


def checked(spark: SparkSession, d: str) -> DataFrame:
    """A row for each evaluation: how its claims and verdicts fit."""
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("eval_id"), F.explode(F.slice(F.array(*(F.lit(k) for k in range(5))), F.lit(1), (F.col("o_orderkey") % 6).cast("int"))).alias("claim_id"))
    verdicts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("eval_id"), (F.col("l_linenumber") % 6).alias("claim_id"), (F.col("l_returnflag") != "R").alias("ok"))
    # one exchange by evaluation serves both steps, without sorts, in partitions whose number grows with the input; a verdict that is there in two forms counts as two
    parts = 8 * verdicts.rdd.getNumPartitions()
    both = claims.withColumns({"claimed": F.lit(1), "said": F.lit(None).cast("int")}).unionByName(verdicts.select("eval_id", "claim_id", F.lit(0).alias("claimed"), F.coalesce(F.col("ok").cast("int"), F.lit(2)).alias("said")))
    forms = [F.max(F.when(F.col("said") == k, 1).otherwise(0)).alias(name) for name, k in (("no", 0), ("yes", 1), ("unknown", 2))]
    each = both.repartition(parts, "eval_id").groupBy("eval_id", "claim_id").agg(F.sum("claimed").alias("times"), *forms).withColumn("n", F.col("no") + F.col("yes") + F.col("unknown"))
    times, ok = F.col("times"), (F.col("yes") == 1) & (F.col("no") == 0)
    total = lambda condition, count: F.sum(F.when(condition, count).otherwise(0))
    return each.groupBy("eval_id").agg(
        total(F.col("n") == 0, times).alias("missing"), F.count_if(times == 0).alias("beyond"), total(F.col("n") > 1, F.greatest(times, F.lit(1))).alias("twice"), F.sum("times").alias("claims"), total(ok, times).alias("supported")
    )


@query("verdict_integrity", f"WITH {CLAIMS} SELECT eval_id, missing, beyond, twice FROM checked")
def verdict_integrity(spark: SparkSession, d: str) -> DataFrame:
    return checked(spark, d).select("eval_id", "missing", "beyond", "twice")


SCORE = f"{CLAIMS}, score AS (SELECT *, CASE WHEN claims > 0 AND twice = 0 THEN round(supported / claims, 6) END AS score FROM checked)"


def scores(spark: SparkSession, d: str) -> DataFrame:
    usable = (F.col("claims") > 0) & (F.col("twice") == 0)
    return checked(spark, d).withColumn("score", F.when(usable, F.round(F.col("supported") / F.when(F.col("claims") > 0, F.col("claims")), 6)))


@query("faithfulness_score", f"WITH {SCORE} SELECT eval_id, claims, supported, score FROM score")
def faithfulness_score(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).select("eval_id", "claims", "supported", "score")


@query("approval_band", f"WITH {SCORE} SELECT eval_id, CASE WHEN score < 0.7 THEN 'low' WHEN score < 0.85 THEN 'review' WHEN score IS NULL THEN 'none' ELSE 'approved' END AS band FROM score")
def approval_band(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("score")
    return scores(spark, d).select("eval_id", F.when(s < 0.7, "low").when(s < 0.85, "review").when(s.isNull(), "none").otherwise("approved").alias("band"))


@query(
    "quality_verdict",
    f"""WITH {SCORE}, x AS (SELECT eval_id, concat_ws(',', CASE WHEN supported < claims THEN 'unsupported' END, CASE WHEN score < 0.7 THEN 'low' WHEN score < 0.85 THEN 'review' END,
CASE WHEN eval_id % 9 = 0 THEN 'clarity' END, CASE WHEN missing > 0 THEN 'coverage' END, CASE WHEN claims = 0 THEN 'evidence' END) AS reasons, eval_id % 3 + 1 AS attempt FROM score)
SELECT eval_id, reasons, CASE WHEN reasons = '' THEN 'end' WHEN attempt >= 3 THEN 'reject' WHEN contains(reasons, 'evidence') THEN 'research' ELSE 'rewrite' END AS route FROM x""",
)
def quality_verdict(spark: SparkSession, d: str) -> DataFrame:
    s, e = F.col("score"), F.col("eval_id")
    reasons = F.array_compact(F.array(
        F.when(F.col("supported") < F.col("claims"), "unsupported"), F.when(s < 0.7, "low").when(s < 0.85, "review"), F.when(e % 9 == 0, "clarity"), F.when(F.col("missing") > 0, "coverage"), F.when(F.col("claims") == 0, "evidence")
    ))
    rows = scores(spark, d).select("eval_id", F.array_distinct(reasons).alias("r"))
    route = F.when(F.size("r") == 0, "end").when(e % 3 + 1 >= 3, "reject").when(F.array_contains("r", "evidence"), "research").otherwise("rewrite")
    return rows.select("eval_id", F.array_join("r", ",").alias("reasons"), route.alias("route"))


@query(
    "source_contribution",
    """WITH want AS (SELECT l_orderkey AS eval_id, l_suppkey AS doc FROM lineitem GROUP BY 1, 2), used AS (SELECT l_orderkey AS eval_id, l_suppkey AS doc FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2)
SELECT w.eval_id, count(u.doc) AS contributing, coalesce(string_agg(w.doc, ',' ORDER BY w.doc) FILTER (u.doc IS NULL), '') AS missing FROM want w LEFT JOIN used u ON u.eval_id = w.eval_id AND u.doc = w.doc GROUP BY 1""",
)
def source_contribution(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("want"), F.collect_set(F.when(F.col("l_returnflag") == "N", F.col("l_suppkey"))).alias("used"))
    missing = F.array_sort(F.array_except("want", "used"))
    return rows.select(F.col("l_orderkey").alias("eval_id"), F.size("used").cast("bigint").alias("contributing"), F.array_join(F.transform(missing, lambda x: x.cast("string")), ",").alias("missing"))


@query(
    "rejection_summary",
    """WITH r AS (SELECT DISTINCT l_orderkey AS eval_id, l_partkey AS place FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT *, row_number() OVER (PARTITION BY eval_id ORDER BY place) AS k FROM r)
SELECT eval_id, count(*) AS rejected, string_agg(place, ',' ORDER BY place) FILTER (k <= 5) AS shown FROM n GROUP BY 1""",
)
def rejection_summary(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("eval_id"), F.col("l_partkey").alias("place")).distinct()
    rows = places.groupBy("eval_id").agg(F.array_sort(F.collect_list("place")).alias("p"))
    return rows.select("eval_id", F.size("p").cast("bigint").alias("rejected"), F.array_join(F.transform(F.slice("p", 1, 5), lambda x: x.cast("string")), ",").alias("shown"))


@query("citation_check", """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, count(*) AS refs, bool_and(p.p_partkey IS NOT NULL) AS known, bool_and(coalesce(p.p_size % 7 = l.l_suppkey % 7, false)) AS page_agrees,
bool_and(coalesce(p.p_partkey % 150 = l.l_orderkey % 150, false)) AS document_agrees, bool_and(coalesce(p.p_partkey IS NOT NULL AND coalesce(nullif(p.p_type, 'PROMO'), 'documento') = CASE WHEN l.l_linenumber % 3 = 0 THEN 'documento' WHEN l.l_suppkey % 2 = 0 THEN p.p_type ELSE 'LARGE' END, false)) AS section_agrees
FROM lineitem l LEFT JOIN (SELECT * FROM part WHERE p_partkey % 19 <> 0) p ON p.p_partkey = l.l_partkey GROUP BY 1, 2, 3""")
def citation_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether each citation names authorised evidence, and agrees with its page, document and section; a section without a name is 'documento'."""
    evidence = table(spark, d, "part").where("p_partkey % 19 <> 0").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("page"), (F.col("p_partkey") % 150).alias("document"), F.coalesce(F.nullif(F.col("p_type"), F.lit("PROMO")), F.lit("documento")).alias("section"), "p_type"
    )
    cited = F.when(F.col("l_linenumber") % 3 == 0, "documento").when(F.col("l_suppkey") % 2 == 0, F.col("p_type")).otherwise("LARGE")
    rows = table(spark, d, "lineitem").join(evidence, "l_partkey", "left").withColumn("cited", cited)
    agrees = lambda own, cited: F.bool_and(F.coalesce(own == cited, F.lit(False)))
    return rows.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(
        F.count("*").alias("refs"), F.bool_and(F.col("page").isNotNull()).alias("known"), agrees(F.col("page") % 7, F.col("l_suppkey") % 7).alias("page_agrees"),
        agrees(F.col("document"), F.col("l_orderkey") % 150).alias("document_agrees"), agrees(F.col("section"), F.col("cited")).alias("section_agrees"),
    )


JUDGE = """review AS (SELECT doc_id, quality = 1 AND toxic = 0 AS human, (doc_id * 7) % 10 < 8 AS judge, doc_id % 3 AS lang, doc_id % 4 AS rating, doc_id % 11 <> 0 AS comparable FROM labels)"""


def reviews(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "labels").select(
        "doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("human"), ((i * 7) % 10 < 8).alias("judge"), (i % 3).alias("lang"), (i % 4).alias("rating"), (i % 11 != 0).alias("comparable")
    )


@query("confusion_matrix", f"WITH {JUDGE} SELECT judge, human, count(*) AS n FROM review WHERE comparable GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d).where("comparable").groupBy("judge", "human").agg(F.count("*").alias("n"))


@query("judge_agreement", f"WITH {JUDGE} SELECT lang, round(avg(CASE WHEN comparable THEN (judge = human)::INT END), 6) AS agreement, count(*) FILTER (comparable AND judge AND NOT human) AS false_approvals, count(*) FILTER (comparable AND human AND NOT judge) AS false_rejections FROM review GROUP BY 1")
def judge_agreement(spark: SparkSession, d: str) -> DataFrame:
    same = F.when(F.col("comparable"), (F.col("judge") == F.col("human")).cast("int"))
    return reviews(spark, d).groupBy("lang").agg(
        F.round(F.avg(same), 6).alias("agreement"), F.count_if(F.col("comparable") & F.col("judge") & ~F.col("human")).alias("false_approvals"), F.count_if(F.col("comparable") & F.col("human") & ~F.col("judge")).alias("false_rejections")
    )


@query("mean_ratings", f"WITH {JUDGE} SELECT lang, round(avg(rating), 6) AS mean, count_if(rating >= 3) AS passed FROM review GROUP BY 1")
def mean_ratings(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d).groupBy("lang").agg(F.round(F.avg("rating"), 6).alias("mean"), F.count_if(F.col("rating") >= 3).alias("passed"))


@query("matrix_coverage", "SELECT lang, count(DISTINCT source) AS formats, count(DISTINCT doc_id % 4) = 4 AND count(DISTINCT source) >= 3 AS complete FROM documents GROUP BY 1")
def matrix_coverage(spark: SparkSession, d: str) -> DataFrame:
    formats = F.countDistinct("source")
    return table(spark, d, "documents").groupBy("lang").agg(formats.alias("formats"), ((F.countDistinct(F.col("doc_id") % 4) == 4) & (formats >= 3)).alias("complete"))


@query("latest_revision", "SELECT conv_id AS case_id, max(turn) AS revision, sha256(max_by(text, turn)) AS digest FROM conversations GROUP BY 1")
def latest_revision(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("case_id")).agg(F.max("turn").alias("revision"), F.sha2(F.max_by("text", "turn"), 256).alias("digest"))


@query(
    "revision_chain",
    """WITH r AS (SELECT conv_id, turn, sha256(text) AS digest, CASE WHEN turn % 5 = 4 THEN 'broken' ELSE lag(sha256(text)) OVER w END AS declared, lag(sha256(text)) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, declared IS NOT DISTINCT FROM before AS valid FROM r""",
)
def revision_chain(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag(F.sha2("text", 256)).over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", before.alias("before"))
    declared = F.when(F.col("turn") % 5 == 4, "broken").otherwise(F.col("before"))
    return rows.select("conv_id", "turn", declared.eqNullSafe(F.col("before")).alias("valid"))


@query(
    "evaluation_report",
    f"""WITH {JUDGE}, two AS (SELECT *, doc_id % 2 = 0 OR human AS second FROM review), decided AS (SELECT *, CASE WHEN human = second THEN human WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 2 = 0 END AS final FROM two)
SELECT lang, count(*) AS cases, count_if(human <> second) AS disagreements, count_if(final IS NULL) AS open_cases, count_if(comparable AND final IS NOT NULL) AS comparable,
round(avg(CASE WHEN comparable AND final IS NOT NULL THEN (final = judge)::INT END), 6) AS agreement FROM decided GROUP BY 1""",
)
def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    """Two reviews of each case, adjudicated where they differ, against the judge; no agreement without a sample."""
    i = F.col("doc_id")
    rows = reviews(spark, d).withColumn("second", (i % 2 == 0) | F.col("human"))
    rows = rows.withColumn("final", F.when(F.col("human") == F.col("second"), F.col("human")).when(i % 5 != 0, i % 2 == 0))
    usable = F.col("comparable") & F.col("final").isNotNull()
    return rows.groupBy("lang").agg(
        F.count("*").alias("cases"), F.count_if(F.col("human") != F.col("second")).alias("disagreements"), F.count_if(F.col("final").isNull()).alias("open_cases"), F.count_if(usable).alias("comparable"),
        F.round(F.avg(F.when(usable, (F.col("final") == F.col("judge")).cast("int"))), 6).alias("agreement"),
    )
