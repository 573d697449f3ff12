"""Relational queries over the operational registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import registry as ops
from lectern.operators import trees
from lectern.plans.base import (
    ADM, CATALOG, DOC, GEN, LINK, NOW, TOMB, WS, admissions, generations, links, registry_documents, retired, stamp, with_, workspaces,
)
from lectern.session import parts_for, table

query = CATALOG.query


def now() -> Column:
    return F.expr(f"timestamp_ntz'{NOW}'")


@query("live_sessions", with_(GEN, WS) + f"SELECT g.gen_id AS session_id, g.workspace, NOT w.deleted AND w.expires > TIMESTAMP '{NOW}' AS live FROM gen g JOIN ws w USING (workspace)")
def live_sessions(spark: SparkSession, d: str) -> DataFrame:
    ws = workspaces(spark, d).select("workspace", (~F.col("deleted") & (F.col("expires") > now())).alias("live"))
    return generations(spark, d).join(ws, "workspace").select(F.col("gen_id").alias("session_id"), "workspace", "live")


@query("docs_admissible", with_(DOC, ADM) + "SELECT d.doc_id, d.workspace, coalesce(a.state, 'none') AS state FROM doc d LEFT JOIN adm a USING (doc_id) WHERE a.state IS NULL OR a.state = 'queued'")
def docs_admissible(spark: SparkSession, d: str) -> DataFrame:
    rows = registry_documents(spark, d).join(admissions(spark, d), "doc_id", "left").where("state is null or state = 'queued'")
    return rows.select("doc_id", "workspace", F.coalesce("state", F.lit("none")).alias("state"))


@query("docs_not_retired", with_(DOC, TOMB) + "SELECT doc_id, workspace FROM doc d WHERE NOT EXISTS (SELECT 1 FROM tomb t WHERE t.kind = 'doc' AND (t.id = d.doc_id OR t.id = d.workspace))")
def docs_not_retired(spark: SparkSession, d: str) -> DataFrame:
    dead = retired(spark, d, "doc")
    rows = ops.not_retired(registry_documents(spark, d), dead, "doc_id")
    return ops.not_retired(rows, dead.withColumnRenamed("doc_id", "workspace"), "workspace").select("doc_id", "workspace")


@query(
    "visible_documents",
    with_(DOC, WS, TOMB, ADM) + f"""SELECT d.doc_id, d.workspace, d.title FROM doc d JOIN ws w USING (workspace) LEFT JOIN adm a USING (doc_id)
WHERE NOT w.deleted AND w.expires > TIMESTAMP '{NOW}' AND (a.state IS NULL OR a.state = 'queued') AND NOT EXISTS (SELECT 1 FROM tomb t WHERE t.kind = 'doc' AND t.id = d.doc_id)""",
)
def visible_documents(spark: SparkSession, d: str) -> DataFrame:
    ws = workspaces(spark, d).where(~F.col("deleted") & (F.col("expires") > now())).select("workspace")
    rows = ops.not_retired(registry_documents(spark, d), retired(spark, d, "doc"), "doc_id").join(ws, "workspace")
    return rows.join(admissions(spark, d), "doc_id", "left").where("state is null or state = 'queued'").select("doc_id", "workspace", "title")


VISIBLE_SQL = """vis AS (SELECT * FROM gen g WHERE NOT EXISTS (SELECT 1 FROM tomb t WHERE t.kind = 'gen' AND t.id = g.gen_id)
  AND NOT EXISTS (SELECT 1 FROM tomb t WHERE t.kind = 'doc' AND t.id = g.primary_doc)
  AND NOT EXISTS (SELECT 1 FROM link l JOIN tomb t ON t.kind = 'doc' AND t.id = l.doc_id WHERE l.gen_id = g.gen_id))"""


def visible(spark: SparkSession, d: str) -> DataFrame:
    return ops.visible_generations(generations(spark, d), links(spark, d), retired(spark, d, "doc"), retired(spark, d, "gen"))


@query("generations_visible", with_(GEN, LINK, TOMB, VISIBLE_SQL) + "SELECT gen_id, workspace, status FROM vis")
def generations_visible(spark: SparkSession, d: str) -> DataFrame:
    return visible(spark, d).select("gen_id", "workspace", "status")


@query("history_by_document", with_(GEN, LINK) + "SELECT gen_id, workspace FROM gen g WHERE primary_doc = 42 OR EXISTS (SELECT 1 FROM link l WHERE l.gen_id = g.gen_id AND l.doc_id = 42)")
def history_by_document(spark: SparkSession, d: str) -> DataFrame:
    gens = generations(spark, d)
    keys = links(spark, d).where("doc_id = 42").select("gen_id").union(gens.where("primary_doc = 42").select("gen_id")).distinct()
    return gens.join(keys, "gen_id", "left_semi").select("gen_id", "workspace")


@query(
    "history_filtered",
    with_(GEN, WS) + f"""SELECT gen_id, g.workspace, format, strftime(created, '%Y-%m-%d %H:%M:%S') AS created FROM gen g JOIN ws w USING (workspace)
WHERE w.profile = 'BUILDING' AND g.format LIKE '1%' AND json_extract_string('{{"lang":"' || lower(g.status) || '"}}', '$.lang') = 'o'
AND created >= TIMESTAMP '1994-01-01' AND created <= TIMESTAMP '1997-12-31'""",
)
def history_filtered(spark: SparkSession, d: str) -> DataFrame:
    document = F.concat(F.lit('{"lang":"'), F.lower("status"), F.lit('"}'))
    rows = generations(spark, d).where(F.col("format").startswith("1") & (F.get_json_object(document, "$.lang") == "o"))
    rows = rows.where("created >= timestamp_ntz'1994-01-01' and created <= timestamp_ntz'1997-12-31'")
    return rows.join(workspaces(spark, d).where("profile = 'BUILDING'").select("workspace"), "workspace").select("gen_id", "workspace", "format", stamp("created").alias("created"))


@query(
    "pending_effects",
    with_(GEN, DOC, WS, TOMB) + """SELECT g.gen_id, coalesce(g.primary_doc, g.gen_id % 500 + 1) AS doc_id, w.profile, d.brand, t.id IS NOT NULL AS gone
FROM gen g LEFT JOIN doc d ON d.doc_id = coalesce(g.primary_doc, g.gen_id % 500 + 1) LEFT JOIN ws w ON w.workspace = g.workspace
LEFT JOIN tomb t ON t.kind = 'gen' AND t.id = g.gen_id WHERE g.status = 'P'""",
)
def pending_effects(spark: SparkSession, d: str) -> DataFrame:
    rows = generations(spark, d).where("status = 'P'").withColumn("doc_id", F.coalesce("primary_doc", F.col("gen_id") % 500 + 1))
    rows = rows.join(registry_documents(spark, d).select("doc_id", "brand"), "doc_id", "left").join(workspaces(spark, d).select("workspace", "profile"), "workspace", "left")
    gone = retired(spark, d, "gen").withColumn("gone_", F.lit(True))
    return rows.join(gone, "gen_id", "left").select("gen_id", "doc_id", "profile", "brand", F.coalesce("gone_", F.lit(False)).alias("gone"))


@query(
    "document_jobs",
    with_(GEN, LINK) + """SELECT DISTINCT doc_id, gen_id FROM (SELECT primary_doc AS doc_id, gen_id FROM gen WHERE primary_doc IS NOT NULL
UNION ALL SELECT doc_id, gen_id FROM link UNION ALL SELECT gen_id % 500 + 1, gen_id FROM gen WHERE status = 'P')""",
)
def document_jobs(spark: SparkSession, d: str) -> DataFrame:
    gens = generations(spark, d)
    keys = gens.where("primary_doc is not null").select(F.col("primary_doc").alias("doc_id"), "gen_id").union(links(spark, d).select("doc_id", "gen_id"))
    return keys.union(gens.where("status = 'P'").select(F.col("gen_id") % 500 + 1, "gen_id")).distinct()


SNAP = """snap AS (SELECT gen_id, json_array(primary_doc, gen_id % 500 + 1) AS sources FROM gen WHERE primary_doc IS NOT NULL)"""


@query("retired_by_source", with_(GEN, TOMB, SNAP) + "SELECT DISTINCT gen_id FROM (SELECT gen_id, unnest(from_json(sources, '[\"BIGINT\"]')) AS id FROM snap) s JOIN tomb t ON t.kind = 'doc' AND t.id = s.id")
def retired_by_source(spark: SparkSession, d: str) -> DataFrame:
    snapshots = generations(spark, d).where("primary_doc is not null").select("gen_id", F.to_json(F.array("primary_doc", F.col("gen_id") % 500 + 1)).alias("sources"))
    each = snapshots.select("gen_id", F.explode(F.from_json("sources", "array<bigint>")).alias("doc_id"))
    return each.join(retired(spark, d, "doc"), "doc_id", "left_semi").select("gen_id").distinct()


@query("job_document_arrays", with_(GEN, LINK) + "SELECT g.gen_id, coalesce((SELECT string_agg(l.doc_id, ',' ORDER BY l.doc_id) FROM link l WHERE l.gen_id = g.gen_id), '') AS documents FROM gen g")
def job_document_arrays(spark: SparkSession, d: str) -> DataFrame:
    lists = links(spark, d).groupBy("gen_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("documents"))
    return generations(spark, d).select("gen_id").join(lists, "gen_id", "left").select("gen_id", F.coalesce("documents", F.lit("")).alias("documents"))


@query(
    "bridge_backfill",
    with_(GEN, LINK) + "SELECT DISTINCT gen_id, doc_id FROM (SELECT gen_id, doc_id FROM link UNION ALL SELECT g.gen_id, g.primary_doc FROM gen g JOIN part p ON p.p_partkey = g.primary_doc)",
)
def bridge_backfill(spark: SparkSession, d: str) -> DataFrame:
    known = registry_documents(spark, d).select(F.col("doc_id").alias("primary_doc"))
    own = generations(spark, d).join(known, "primary_doc", "left_semi").select("gen_id", F.col("primary_doc").alias("doc_id"))
    return links(spark, d).union(own).distinct()


@query(
    "provenance_check",
    with_(GEN, LINK) + """SELECT g.gen_id, coalesce(l.s, '') = coalesce(p.s, '') AS snapshot_ok, coalesce(l.s, '') = CAST(coalesce(g.primary_doc, -1) AS VARCHAR) AS declared_ok FROM gen g
LEFT JOIN (SELECT gen_id, string_agg(doc_id, ',' ORDER BY doc_id) AS s FROM link GROUP BY 1) l USING (gen_id)
LEFT JOIN (SELECT l_orderkey AS gen_id, string_agg(DISTINCT l_partkey, ',' ORDER BY l_partkey) AS s FROM lineitem WHERE l_partkey % 11 <> 0 GROUP BY 1) p USING (gen_id)""",
)
def provenance_check(spark: SparkSession, d: str) -> DataFrame:
    said = lambda: F.array_join(F.transform(F.sort_array(F.collect_set("doc_id")), lambda x: x.cast("string")), ",")
    link = links(spark, d).groupBy("gen_id").agg(said().alias("l"))
    snapshot = links(spark, d).where("doc_id % 11 <> 0").groupBy("gen_id").agg(said().alias("p"))
    rows = generations(spark, d).join(link, "gen_id", "left").join(snapshot, "gen_id", "left")
    l, p = F.coalesce("l", F.lit("")), F.coalesce("p", F.lit(""))
    return rows.select("gen_id", (l == p).alias("snapshot_ok"), (l == F.coalesce("primary_doc", F.lit(-1)).cast("string")).alias("declared_ok"))


@query(
    "snapshot_drift",
    with_(GEN, DOC) + """SELECT g.gen_id, d.doc_id IS NULL AS missing, d.doc_id IS NOT NULL AND sha256(d.title) IS DISTINCT FROM sha256(CASE WHEN g.gen_id % 13 = 0 THEN d.brand ELSE d.title END) AS drifted
FROM gen g LEFT JOIN doc d ON d.doc_id = g.primary_doc WHERE g.primary_doc IS NOT NULL""",
)
def snapshot_drift(spark: SparkSession, d: str) -> DataFrame:
    now_ = registry_documents(spark, d).select(F.col("doc_id").alias("primary_doc"), "title", "brand", F.lit(True).alias("there"))
    rows = generations(spark, d).where("primary_doc is not null").join(now_, "primary_doc", "left")
    expected = F.sha2(F.when(F.col("gen_id") % 13 == 0, F.col("brand")).otherwise(F.col("title")), 256)
    drifted = F.col("there").isNotNull() & ~F.sha2("title", 256).eqNullSafe(expected)
    return rows.select("gen_id", F.col("there").isNull().alias("missing"), drifted.alias("drifted"))


@query(
    "documents_page",
    with_(DOC) + "SELECT doc_id, pages, row_number() OVER (ORDER BY pages, doc_id) AS place, count(*) OVER () > 20 AS more FROM (SELECT * FROM doc WHERE (pages, doc_id) > (17, 100) ORDER BY pages, doc_id LIMIT 21) QUALIFY place <= 20",
)
def documents_page(spark: SparkSession, d: str) -> DataFrame:
    return ops.page(registry_documents(spark, d).select("doc_id", "pages"), ("pages", "doc_id"), (F.lit(17), F.lit(100)), 20)


@query(
    "history_page",
    with_(GEN, LINK, TOMB, VISIBLE_SQL) + """SELECT gen_id, strftime(created, '%Y-%m-%d %H:%M:%S') AS created, place, more FROM (
SELECT gen_id, created, row_number() OVER (ORDER BY created DESC, gen_id DESC) AS place, count(*) OVER () > 25 AS more FROM (
SELECT * FROM vis WHERE (created, gen_id) < (TIMESTAMP '1996-06-30', 500) ORDER BY created DESC, gen_id DESC LIMIT 26)) WHERE place <= 25""",
)
def history_page(spark: SparkSession, d: str) -> DataFrame:
    after = (F.expr("timestamp_ntz'1996-06-30'"), F.lit(500))
    rows = ops.page(visible(spark, d).select("gen_id", "created"), ("created", "gen_id"), after, 25, descending=True)
    return rows.withColumn("created", stamp("created"))


@query("latest_job", with_(GEN) + "SELECT workspace, gen_id, status FROM gen QUALIFY row_number() OVER (PARTITION BY workspace ORDER BY created DESC, gen_id DESC) = 1")
def latest_job(spark: SparkSession, d: str) -> DataFrame:
    newest = F.max_by(F.struct("gen_id", "status"), F.struct("created", "gen_id")).alias("j")
    return generations(spark, d).groupBy("workspace").agg(newest).select("workspace", "j.gen_id", "j.status")


@query("latest_error", with_(GEN) + "SELECT workspace, gen_id FROM gen WHERE status = 'F' QUALIFY row_number() OVER (PARTITION BY workspace ORDER BY created DESC, gen_id DESC) = 1")
def latest_error(spark: SparkSession, d: str) -> DataFrame:
    return generations(spark, d).where("status = 'F'").groupBy("workspace").agg(F.max_by("gen_id", F.struct("created", "gen_id")).alias("gen_id"))


@query(
    "cache_lookup",
    with_(GEN) + "SELECT substr(sha256(workspace || ':' || format), 1, 16) AS config, gen_id FROM gen WHERE status = 'F' QUALIFY row_number() OVER (PARTITION BY workspace, format ORDER BY created DESC, gen_id DESC) = 1",
)
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    config = F.substring(F.sha2(F.concat_ws(":", "workspace", "format"), 256), 1, 16)
    rows = generations(spark, d).where("status = 'F'").withColumn("config", config)
    return rows.groupBy("config").agg(F.max_by("gen_id", F.struct("created", "gen_id")).alias("gen_id"))


@query("queue_position", with_(GEN) + "SELECT gen_id, workspace, row_number() OVER (PARTITION BY workspace ORDER BY created, gen_id) AS position FROM gen WHERE status = 'O'")
def queue_position(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("workspace").orderBy("created", "gen_id"))
    return generations(spark, d).where("status = 'O'").select("gen_id", "workspace", place.alias("position"))


@query(
    "workspace_usage",
    with_(GEN, DOC, LINK, TOMB, VISIBLE_SQL, WS) + """SELECT w.workspace, coalesce(dn, 0) AS documents, coalesce(gn, 0) AS generations, coalesce(dn, 0) >= 12 OR coalesce(gn, 0) >= 10 AS full FROM ws w
LEFT JOIN (SELECT workspace, count(*) AS dn FROM doc WHERE doc_id NOT IN (SELECT id FROM tomb WHERE kind = 'doc') GROUP BY 1) a USING (workspace)
LEFT JOIN (SELECT workspace, count(*) AS gn FROM vis GROUP BY 1) b USING (workspace)""",
)
def workspace_usage(spark: SparkSession, d: str) -> DataFrame:
    docs = ops.not_retired(registry_documents(spark, d), retired(spark, d, "doc"), "doc_id").groupBy("workspace").agg(F.count("*").alias("dn"))
    gens = visible(spark, d).groupBy("workspace").agg(F.count("*").alias("gn"))
    rows = workspaces(spark, d).select("workspace").join(docs, "workspace", "left").join(gens, "workspace", "left").na.fill(0)
    return rows.select("workspace", F.col("dn").alias("documents"), F.col("gn").alias("generations"), ((F.col("dn") >= 12) | (F.col("gn") >= 10)).alias("full"))


@query("active_jobs", with_(GEN) + "SELECT workspace, count(*) FILTER (status = 'P') AS running, count(*) FILTER (status = 'O') AS queued FROM gen GROUP BY 1")
def active_jobs(spark: SparkSession, d: str) -> DataFrame:
    of = lambda s: F.count_if(F.col("status") == s)
    return generations(spark, d).groupBy("workspace").agg(of("P").alias("running"), of("O").alias("queued"))


OUTCOME_SQL = """WITH e AS (SELECT event_id, user_id, event_type, props AS body FROM events),
f AS (SELECT *, first_value(body) OVER w AS one, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id))
SELECT event_id, CASE WHEN n = 1 THEN 'created' WHEN body = one THEN 'duplicate' ELSE 'conflict' END AS outcome FROM f"""


@query("idempotency_outcome", OUTCOME_SQL)
def idempotency_outcome(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    rows = table(spark, d, "events").withColumn("body", F.col("props")).withColumns({"one": F.first("body").over(w), "n": F.row_number().over(w)})
    return rows.select("event_id", F.when(F.col("n") == 1, "created").when(F.col("body") == F.col("one"), "duplicate").otherwise("conflict").alias("outcome"))


@query(
    "event_dedup",
    """WITH e AS (SELECT *, user_id || ':' || event_type || ':' || (event_id % 40) AS eid FROM events),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY eid ORDER BY event_id) = 1)
SELECT eid, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM f""",
)
def event_dedup(spark: SparkSession, d: str) -> DataFrame:
    eid = F.concat_ws(":", "user_id", "event_type", F.col("event_id") % 40)
    firsts = ops.latest(table(spark, d, "events").withColumn("eid", eid), ["eid"], [F.asc("event_id")])
    return firsts.select("eid", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("sequence"))


MANIFEST = """stored AS (SELECT p_partkey AS id, p_size AS version, TIMESTAMP '2024-01-01' + to_days(p_size) AS seen, CASE WHEN p_partkey % 9 = 0 THEN 'gone' END AS removed FROM part WHERE p_partkey % 4 <> 0),
incoming AS (SELECT p_partkey AS id, (p_size * 7) % 50 AS version, TIMESTAMP '2024-01-01' + to_days((p_size * 7) % 50) AS seen, CASE WHEN p_partkey % 10 = 0 THEN 'late' END AS removed FROM part WHERE p_partkey % 3 <> 0)"""


def manifests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, d, "part")

    def one(version: str, keep: str, removed: str, mod: int, tag: str) -> DataFrame:
        return part.where(keep).select(
            F.col("p_partkey").alias("id"), F.expr(version).alias(f"version{tag}"),
            F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval({version})").alias(f"seen{tag}"),
            F.when(F.col("p_partkey") % mod == 0, removed).alias(f"removed{tag}"),
        )

    return one("p_size", "p_partkey % 4 <> 0", "gone", 9, "_s"), one("(p_size * 7) % 50", "p_partkey % 3 <> 0", "late", 10, "_i")


@query(
    "manifest_merge",
    with_(MANIFEST) + """SELECT id, greatest(s.version, i.version) AS version, strftime(greatest(s.seen, i.seen), '%Y-%m-%d %H:%M:%S') AS seen, coalesce(s.removed, i.removed) AS removed
FROM stored s FULL JOIN incoming i USING (id)""",
)
def manifest_merge(spark: SparkSession, d: str) -> DataFrame:
    stored, incoming = manifests(spark, d)
    rows = stored.join(incoming, "id", "full")
    return rows.select("id", F.greatest("version_s", "version_i").alias("version"), F.date_format(F.greatest("seen_s", "seen_i"), "yyyy-MM-dd HH:mm:ss").alias("seen"), F.coalesce("removed_s", "removed_i").alias("removed"))


@query(
    "manifest_conflicts",
    with_(MANIFEST) + """SELECT id, i.version < s.version AS downgrade, s.removed IS NOT NULL AND i.removed IS NULL AS lost_tombstone FROM stored s JOIN incoming i USING (id)
WHERE i.version < s.version OR (s.removed IS NOT NULL AND i.removed IS NULL)""",
)
def manifest_conflicts(spark: SparkSession, d: str) -> DataFrame:
    stored, incoming = manifests(spark, d)
    lower, lost = F.col("version_i") < F.col("version_s"), F.col("removed_s").isNotNull() & F.col("removed_i").isNull()
    return stored.join(incoming, "id").where(lower | lost).select("id", lower.alias("downgrade"), lost.alias("lost_tombstone"))


PROGRESS_SQL = "SELECT user_id, value AS state, event_id AS version FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


@query("progress_latest", PROGRESS_SQL)
def progress_latest(spark: SparkSession, d: str) -> DataFrame:
    newest = F.max_by(F.struct(F.col("value").alias("state"), F.col("event_id").alias("version")), "event_id").alias("x")
    return table(spark, d, "events").groupBy("user_id").agg(newest).select("user_id", "x.state", "x.version")


@query(
    "revoke_sessions",
    with_(GEN) + f"SELECT gen_id, coalesce(strftime(CASE WHEN gen_id % 4 = 0 THEN created END, '%Y-%m-%d %H:%M:%S'), CASE WHEN workspace % 3 = 0 THEN '{NOW}' END) AS revoked FROM gen",
)
def revoke_sessions(spark: SparkSession, d: str) -> DataFrame:
    before = F.when(F.col("gen_id") % 4 == 0, stamp("created"))
    return generations(spark, d).select("gen_id", F.coalesce(before, F.when(F.col("workspace") % 3 == 0, F.lit(NOW))).alias("revoked"))


@query("rotation_cas", with_(WS) + "SELECT workspace, CASE WHEN workspace % 5 = 2 THEN workspace % 5 + 1 ELSE workspace % 5 END AS version, workspace % 5 = 2 AS rotated FROM ws WHERE NOT deleted")
def rotation_cas(spark: SparkSession, d: str) -> DataFrame:
    version = F.col("workspace") % 5
    return workspaces(spark, d).where(~F.col("deleted")).select("workspace", F.when(version == 2, version + 1).otherwise(version).alias("version"), (version == 2).alias("rotated"))


@query("ready_documents", with_(DOC, TOMB, ADM) + "SELECT d.doc_id, d.workspace FROM doc d LEFT JOIN adm a USING (doc_id) WHERE a.doc_id IS NULL AND d.pages > 0 AND d.doc_id NOT IN (SELECT id FROM tomb WHERE kind = 'doc')")
def ready_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = ops.not_retired(registry_documents(spark, d).where("pages > 0"), retired(spark, d, "doc"), "doc_id")
    return ops.not_retired(rows, admissions(spark, d), "doc_id").select("doc_id", "workspace")


@query(
    "recovery_candidates",
    with_(DOC, TOMB, ADM) + "SELECT d.doc_id, coalesce(a.attempts, 0) AS attempts FROM doc d LEFT JOIN adm a USING (doc_id) WHERE (a.state = 'failed' OR d.pages % 10 = 0) AND coalesce(a.attempts, 0) < 2 AND d.doc_id NOT IN (SELECT id FROM tomb WHERE kind = 'doc')",
)
def recovery_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = ops.not_retired(registry_documents(spark, d), retired(spark, d, "doc"), "doc_id").join(admissions(spark, d), "doc_id", "left")
    rows = rows.where("(state = 'failed' or pages % 10 = 0) and coalesce(attempts, 0) < 2")
    return rows.select("doc_id", F.coalesce("attempts", F.lit(0)).alias("attempts"))


@query("admission_slots", with_(DOC) + "SELECT doc_id, workspace, row_number() OVER (PARTITION BY workspace ORDER BY price, doc_id) = 1 AS admitted FROM doc WHERE pages > 25")
def admission_slots(spark: SparkSession, d: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("workspace").orderBy("price", "doc_id")) == 1
    return registry_documents(spark, d).where("pages > 25").select("doc_id", "workspace", first.alias("admitted"))


@query("due_cleanup", with_(GEN) + "SELECT gen_id FROM gen WHERE gen_id > 100 AND (primary_doc IS NULL OR primary_doc <= 500) ORDER BY gen_id LIMIT 50")
def due_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return generations(spark, d).where("gen_id > 100 and (primary_doc is null or primary_doc <= 500)").select("gen_id").orderBy("gen_id").limit(50)


@query(
    "missing_effects",
    with_(GEN, LINK, TOMB) + """SELECT DISTINCT gen_id FROM (SELECT g.gen_id FROM gen g JOIN tomb t ON t.kind = 'doc' AND t.id = g.primary_doc
UNION ALL SELECT l.gen_id FROM link l JOIN tomb t ON t.kind = 'doc' AND t.id = l.doc_id) x WHERE gen_id NOT IN (SELECT id FROM tomb WHERE kind = 'gen')""",
)
def missing_effects(spark: SparkSession, d: str) -> DataFrame:
    dead = retired(spark, d, "doc")
    own = generations(spark, d).select("gen_id", F.col("primary_doc").alias("doc_id")).join(dead, "doc_id", "left_semi").select("gen_id")
    by_link = links(spark, d).join(dead, "doc_id", "left_semi").select("gen_id")
    return own.union(by_link).distinct().join(retired(spark, d, "gen"), "gen_id", "left_anti")


@query("ack_effects", with_(GEN) + "SELECT a.gen_id, b.gen_id IS NOT NULL AS acknowledged FROM gen a LEFT JOIN (SELECT * FROM gen WHERE status = 'F') b ON a.gen_id = b.gen_id AND a.workspace = b.workspace AND a.created = b.created")
def ack_effects(spark: SparkSession, d: str) -> DataFrame:
    done = generations(spark, d).where("status = 'F'").select("gen_id", "workspace", "created", F.lit(True).alias("ack"))
    return generations(spark, d).join(done, ["gen_id", "workspace", "created"], "left").select("gen_id", F.coalesce("ack", F.lit(False)).alias("acknowledged"))


@query("related_generations", with_(GEN, LINK) + "SELECT gen_id FROM link WHERE doc_id BETWEEN 10 AND 30 UNION SELECT gen_id FROM gen WHERE primary_doc BETWEEN 10 AND 30")
def related_generations(spark: SparkSession, d: str) -> DataFrame:
    own = generations(spark, d).where("primary_doc between 10 and 30").select("gen_id")
    return links(spark, d).where("doc_id between 10 and 30").select("gen_id").union(own).distinct()


@query("purge_projection", with_(GEN, TOMB) + "SELECT g.gen_id, CASE WHEN t.id IS NULL THEN g.primary_doc END AS primary_doc FROM gen g LEFT JOIN tomb t ON t.kind = 'doc' AND t.id = g.primary_doc WHERE g.gen_id NOT IN (SELECT id FROM tomb WHERE kind = 'gen')")
def purge_projection(spark: SparkSession, d: str) -> DataFrame:
    dead = retired(spark, d, "doc").select(F.col("doc_id").alias("primary_doc"), F.lit(True).alias("gone"))
    rows = ops.not_retired(generations(spark, d), retired(spark, d, "gen"), "gen_id").join(dead, "primary_doc", "left")
    return rows.select("gen_id", F.when(F.col("gone").isNull(), F.col("primary_doc")).alias("primary_doc"))


@query("generation_sources", with_(GEN, LINK) + "SELECT g.gen_id, coalesce(l.s, CAST(g.primary_doc AS VARCHAR), '') AS sources FROM gen g LEFT JOIN (SELECT gen_id, string_agg(doc_id, ',' ORDER BY doc_id) AS s FROM link WHERE doc_id % 3 = 0 GROUP BY 1) l USING (gen_id)")
def generation_sources(spark: SparkSession, d: str) -> DataFrame:
    lists = links(spark, d).where("doc_id % 3 = 0").groupBy("gen_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("s"))
    return generations(spark, d).join(lists, "gen_id", "left").select("gen_id", F.coalesce("s", F.col("primary_doc").cast("string"), F.lit("")).alias("sources"))


@query(
    "retained_outputs",
    "SELECT user_id, event_type, event_id FROM events WHERE value <= 50 AND ts + INTERVAL 24 HOUR > TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1",
)
def retained_outputs(spark: SparkSession, d: str) -> DataFrame:
    alive = table(spark, d, "events").where("value <= 50").where(F.expr("ts + interval 24 hours") > now())
    return alive.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query(
    "job_transitions",
    with_(GEN) + """SELECT gen_id, CASE WHEN status = 'O' AND gen_id % 4 = 0 THEN 'running' WHEN status = 'O' AND gen_id % 4 = 1 THEN 'cancelled' WHEN status = 'P' AND gen_id % 4 = 2 THEN 'completed'
WHEN status = 'P' AND gen_id % 4 = 3 THEN 'failed' ELSE status END AS after, status = 'F' AS terminal FROM gen""",
)
def job_transitions(spark: SparkSession, d: str) -> DataFrame:
    event, status = F.col("gen_id") % 4, F.col("status")
    after = (
        F.when((status == "O") & (event == 0), "running").when((status == "O") & (event == 1), "cancelled")
        .when((status == "P") & (event == 2), "completed").when((status == "P") & (event == 3), "failed").otherwise(status)
    )
    return generations(spark, d).select("gen_id", after.alias("after"), (status == "F").alias("terminal"))


@query("intent_sources", with_(GEN, DOC, ADM) + "SELECT g.gen_id, d.brand, coalesce(a.state, 'none') AS state FROM gen g LEFT JOIN doc d ON d.doc_id = g.primary_doc LEFT JOIN adm a ON a.doc_id = g.primary_doc")
def intent_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = registry_documents(spark, d).select(F.col("doc_id").alias("primary_doc"), "brand")
    adm = admissions(spark, d).select(F.col("doc_id").alias("primary_doc"), "state")
    return generations(spark, d).join(docs, "primary_doc", "left").join(adm, "primary_doc", "left").select("gen_id", "brand", F.coalesce("state", F.lit("none")).alias("state"))


@query("events_since", "SELECT event_id, user_id, event_type FROM events WHERE event_id > 9000")
def events_since(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_id > 9000").select("event_id", "user_id", "event_type")


@query("retention_dates", "SELECT p_partkey AS id, strftime(max(TIMESTAMP '2024-01-01' + to_days(p_size) + INTERVAL 30 DAY), '%Y-%m-%d') AS purge_after FROM part WHERE p_partkey % 17 = 0 GROUP BY 1")
def retention_dates(spark: SparkSession, d: str) -> DataFrame:
    asked = F.max(F.date_add(F.to_date(F.lit("2024-01-01")), F.col("p_size")))
    rows = table(spark, d, "part").where("p_partkey % 17 = 0").groupBy(F.col("p_partkey").alias("id")).agg(asked.alias("asked"))
    return rows.select("id", F.date_format(F.date_add("asked", 30), "yyyy-MM-dd").alias("purge_after"))


@query(
    "registry_rebuild",
    with_(MANIFEST, TOMB) + """SELECT i.id, CASE WHEN t.id IS NOT NULL THEN 'retired' WHEN s.id IS NULL THEN 'new' WHEN sha256(CAST(s.version AS VARCHAR)) <> sha256(CAST(i.version AS VARCHAR)) THEN 'hash mismatch' ELSE 'kept' END AS action
FROM incoming i LEFT JOIN stored s USING (id) LEFT JOIN tomb t ON t.kind = 'doc' AND t.id = i.id""",
)
def registry_rebuild(spark: SparkSession, d: str) -> DataFrame:
    stored, incoming = manifests(spark, d)
    dead = retired(spark, d, "doc").select(F.col("doc_id").alias("id"), F.lit(True).alias("dead"))
    rows = incoming.join(stored, "id", "left").join(dead, "id", "left")
    other = F.sha2(F.col("version_s").cast("string"), 256) != F.sha2(F.col("version_i").cast("string"), 256)
    return rows.select("id", F.when(F.col("dead"), "retired").when(F.col("version_s").isNull(), "new").when(other, "hash mismatch").otherwise("kept").alias("action"))


@query(
    "rebuild_plan",
    with_(MANIFEST, TOMB, ADM) + """SELECT coalesce(i.id, s.id) AS id, CASE WHEN i.id IS NULL THEN 'drop orphan' WHEN t.id IS NOT NULL THEN 'skip deleted' WHEN a.state = 'failed' THEN 'skip unadmitted' ELSE 'rechunk' END AS step
FROM incoming i FULL JOIN stored s ON i.id = s.id LEFT JOIN tomb t ON t.kind = 'doc' AND t.id = i.id LEFT JOIN adm a ON a.doc_id = i.id""",
)
def rebuild_plan(spark: SparkSession, d: str) -> DataFrame:
    stored, incoming = manifests(spark, d)
    dead = retired(spark, d, "doc").select(F.col("doc_id").alias("id"), F.lit(True).alias("dead"))
    own = incoming.select("id").join(dead, "id", "left").join(admissions(spark, d).select(F.col("doc_id").alias("id"), "state"), "id", "left")
    steps = own.select("id", F.when(F.col("dead"), "skip deleted").when(F.col("state") == "failed", "skip unadmitted").otherwise("rechunk").alias("step"))
    return steps.union(stored.select("id").join(incoming, "id", "left_anti").withColumn("step", F.lit("drop orphan")))


@query(
    "publication_check",
    with_(DOC, LINK, TOMB) + """SELECT d.doc_id, concat_ws(',', CASE WHEN t.id IS NOT NULL THEN 'retired' END, CASE WHEN d.pages <= 0 THEN 'no pages' END, CASE WHEN coalesce(l.n, 0) < 20 THEN 'few links' END,
CASE WHEN d.brand NOT LIKE 'Brand#1%' THEN 'brand' END) AS violations FROM doc d LEFT JOIN tomb t ON t.kind = 'doc' AND t.id = d.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM link GROUP BY 1) l USING (doc_id)""",
)
def publication_check(spark: SparkSession, d: str) -> DataFrame:
    dead = retired(spark, d, "doc").withColumn("dead", F.lit(True))
    uses = links(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = registry_documents(spark, d).join(dead, "doc_id", "left").join(uses, "doc_id", "left")
    codes = [F.when(F.col("dead"), "retired"), F.when(F.col("pages") <= 0, "no pages"), F.when(F.coalesce("n", F.lit(0)) < 20, "few links"), F.when(~F.col("brand").startswith("Brand#1"), "brand")]
    return rows.select("doc_id", F.array_join(F.array_compact(F.array(*codes)), ",").alias("violations"))


@query("queue_expired", with_(GEN) + "SELECT gen_id, CASE WHEN status = 'O' AND epoch(TIMESTAMP '1998-08-02 00:00:00') - epoch(created) > 300 THEN 'failed' ELSE status END AS after FROM gen")
def queue_expired(spark: SparkSession, d: str) -> DataFrame:
    late = (F.col("status") == "O") & (F.col("created") < F.expr("timestamp_ntz'1998-08-02 00:00:00' - interval 300 seconds"))
    return generations(spark, d).select("gen_id", F.when(late, "failed").otherwise(F.col("status")).alias("after"))


@query("orphaned_jobs", with_(GEN) + "SELECT gen_id, CASE WHEN status IN ('O', 'P') THEN 'interrupted' ELSE status END AS after FROM gen")
def orphaned_jobs(spark: SparkSession, d: str) -> DataFrame:
    return generations(spark, d).select("gen_id", F.when(F.col("status").isin("O", "P"), "interrupted").otherwise(F.col("status")).alias("after"))


@query("expired_workspaces", with_(WS) + f"SELECT workspace FROM ws WHERE expires <= TIMESTAMP '{NOW}' AND NOT deleted")
def expired_workspaces(spark: SparkSession, d: str) -> DataFrame:
    return workspaces(spark, d).where((F.col("expires") <= now()) & ~F.col("deleted")).select("workspace")


@query(
    "activity_renewal",
    """WITH e AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, CASE WHEN before IS NULL OR epoch(ts) - epoch(before) >= 300 THEN strftime(ts + INTERVAL 30 DAY, '%Y-%m-%d %H:%M:%S') END AS renewed FROM e""",
)
def activity_renewal(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("before", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    idle = F.col("before").isNull() | (F.col("ts") >= F.expr("before + interval 300 seconds"))
    return rows.select("event_id", F.when(idle, F.date_format(F.expr("ts + interval 30 days"), "yyyy-MM-dd HH:mm:ss")).alias("renewed"))


@query(
    "page_sets",
    "SELECT p_partkey AS doc_id, array_to_string(list_sort(list_filter(range(1, p_size + 1), lambda x: x % 5 <> 0)), ',') AS processed, array_to_string(list_filter(range(1, p_size + 1), lambda x: x % 5 = 0), ',') AS omitted, len(list_filter(range(1, p_size + 1), lambda x: x % 5 = 0)) = 0 AS complete FROM part",
)
def page_sets(spark: SparkSession, d: str) -> DataFrame:
    pages = F.sequence(F.lit(1), F.col("p_size"))
    omitted = F.filter(pages, lambda x: x % 5 == 0)
    said = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), said(F.array_sort(F.array_except(pages, omitted))).alias("processed"), said(omitted).alias("omitted"), (F.size(F.array_intersect(pages, omitted)) == 0).alias("complete"))


@query("json_ops", "SELECT user_id, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, '[' || string_agg(json_extract_string(props, '$.k'), ',' ORDER BY event_id) || ']' AS listed FROM events GROUP BY 1")
def json_ops(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", k.alias("k")))), lambda x: x["k"])
    return table(spark, d, "events").groupBy("user_id").agg(F.sum(k).alias("total"), F.to_json(ordered).alias("listed"))


@query("scope_hash", with_(GEN) + """SELECT gen_id, sha256('{"format":"' || format || '","status":"' || status || '","workspace":' || workspace || '}') AS scope FROM gen""")
def scope_hash(spark: SparkSession, d: str) -> DataFrame:
    return generations(spark, d).select("gen_id", F.sha2(F.to_json(F.struct("format", "status", "workspace")), 256).alias("scope"))


@query("backoff_bounds", "SELECT event_id, (event_id % 8)::INT AS attempt, greatest(0.5 * pow(2, event_id % 8) * 0.75, 3.0) AS least, greatest(0.5 * pow(2, event_id % 8) * 1.25, 3.0) AS most FROM events WHERE event_type = 'error'")
def backoff_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Between which times the retry of each failed call waits, by the number of its attempt."""
    attempt = F.col("event_id") % 8
    step = F.lit(0.5) * F.pow(F.lit(2.0), attempt)
    at_least = lambda x: F.greatest(step * x, F.lit(3.0))
    return table(spark, d, "events").where("event_type = 'error'").select("event_id", attempt.cast("int").alias("attempt"), at_least(0.75).alias("least"), at_least(1.25).alias("most"))


@query(
    "prune_references",
    with_(GEN, LINK, TOMB) + "SELECT g.gen_id, coalesce(string_agg(l.doc_id, ',' ORDER BY l.doc_id) FILTER (t.id IS NULL), '') AS kept, count(t.id) AS pruned FROM gen g JOIN link l USING (gen_id) LEFT JOIN tomb t ON t.kind = 'doc' AND t.id = l.doc_id GROUP BY 1",
)
def prune_references(spark: SparkSession, d: str) -> DataFrame:
    dead = retired(spark, d, "doc").withColumn("dead", F.lit(True))
    rows = links(spark, d).join(dead, "doc_id", "left").join(generations(spark, d).select("gen_id"), "gen_id", "left_semi")
    kept = F.array_sort(F.collect_list(F.when(F.col("dead").isNull(), F.col("doc_id"))))
    return rows.groupBy("gen_id").agg(F.array_join(F.transform(kept, lambda x: x.cast("string")), ",").alias("kept"), F.count("dead").alias("pruned"))


@query(
    "comparable_classes",
    with_(GEN, LINK) + """, s AS (SELECT g.gen_id, g.workspace, coalesce(string_agg(l.doc_id % 5, ',' ORDER BY l.doc_id % 5), '') AS sources FROM gen g LEFT JOIN (SELECT DISTINCT gen_id, doc_id % 5 AS doc_id FROM link) l USING (gen_id) GROUP BY 1, 2)
SELECT gen_id, min(gen_id) OVER w AS class_id, count(*) OVER w - 1 AS partners FROM s WINDOW w AS (PARTITION BY workspace, sources)""",
)
def comparable_classes(spark: SparkSession, d: str) -> DataFrame:
    """Generations of one workspace from the same sources can be compared: the class of each, and with how many others. A class stands for all its pairs."""
    sets = links(spark, d).groupBy("gen_id").agg(F.sort_array(F.collect_set(F.col("doc_id") % 5)).alias("sources"))
    rows = generations(spark, d).select("gen_id", "workspace").join(sets, "gen_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<bigint>")))
    classes = rows.groupBy("workspace", "sources").agg(F.min("gen_id").alias("class_id"), (F.count("*") - 1).alias("partners"))
    return rows.join(classes, ["workspace", "sources"]).select("gen_id", "class_id", "partners")


@query(
    "comparable_pairs",
    with_(GEN, LINK) + """, s AS (SELECT g.gen_id, g.workspace, coalesce(string_agg(l.doc_id % 5, ',' ORDER BY l.doc_id % 5), '') AS sources FROM gen g LEFT JOIN (SELECT DISTINCT gen_id, doc_id % 5 AS doc_id FROM link) l USING (gen_id) GROUP BY 1, 2)
SELECT a.gen_id AS one, b.gen_id AS two FROM s a JOIN s b ON a.workspace = b.workspace AND a.sources = b.sources AND a.gen_id < b.gen_id WHERE a.gen_id % 20 = 0 OR b.gen_id % 20 = 0""",
)
def comparable_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each generation of the stated query set, whose id is divisible by 20, with all that it can be compared with."""
    classes = comparable_classes(spark, d)
    asked = classes.where("gen_id % 20 = 0").select(F.col("gen_id").alias("query"), "class_id")
    pairs = asked.join(classes.select("gen_id", "class_id"), "class_id").where("query <> gen_id")
    return pairs.select(F.least("query", "gen_id").alias("one"), F.greatest("query", "gen_id").alias("two")).distinct()


TREE = """tree AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN NULL ELSE (turn - 1) // 2 END AS parent FROM conversations)"""


@query(
    "prune_tree",
    f"""WITH RECURSIVE {TREE}, dead AS (SELECT conv_id, turn FROM tree WHERE turn % 5 = 3 OR conv_id % 11 = 4 AND turn = 1
UNION SELECT t.conv_id, t.turn FROM tree t JOIN dead d ON d.conv_id = t.conv_id AND d.turn = t.parent)
SELECT conv_id, turn FROM tree EXCEPT SELECT conv_id, turn FROM dead""",
)
def prune_tree(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each content tree when nodes with a retired reference go with all that hangs on them."""
    parent = F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2))
    dead = (F.col("turn") % 5 == 3) | (F.col("conv_id") % 11 == 4) & (F.col("turn") == 1)
    return trees.surviving(table(spark, d, "conversations").select("conv_id", "turn", parent.alias("parent"), dead.alias("dead")), "conv_id", "turn", "parent", "dead")[0]


# all lines of a part in the order of its orders, each one below the one before: chains as deep as a part has lines
@query(
    "prune_chain",
    """WITH RECURSIVE n AS (SELECT DISTINCT l_partkey AS part, l_orderkey AS line FROM lineitem), c AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY line) AS place FROM n),
dead AS (SELECT part, min(place) AS first FROM c WHERE line % 9 = 4 GROUP BY 1) SELECT c.part, c.line FROM c LEFT JOIN dead USING (part) WHERE first IS NULL OR place < first""",
)
def prune_chain(spark: SparkSession, d: str) -> DataFrame:
    """Chains of a part's lines: what stands below a retired one goes with it, however deep."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("line"))
    parts = parts_for(spark, lines.count())
    before = F.lag("line").over(Window.partitionBy("part").orderBy("line"))
    chains = lines.repartition(parts, "part").distinct().select("part", "line", before.alias("parent"), (F.col("line") % 9 == 4).alias("dead"))
    return trees.surviving(chains, "part", "line", "parent", "dead", parts)[0]


@query(
    "object_listing",
    """WITH names AS (SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS name FROM documents),
page AS (SELECT source_name, (row_number() OVER (PARTITION BY source_name ORDER BY name) - 1) // 25 AS page, name FROM (SELECT name, split_part(name, '/', 1) AS source_name FROM names)),
listed AS (SELECT source_name, page, max(name) AS cursor FROM page GROUP BY 1, 2),
told AS (SELECT source_name, page, CASE WHEN page > 0 AND page % 3 = 2 THEN lag(cursor) OVER (PARTITION BY source_name ORDER BY page) ELSE cursor END AS cursor FROM listed)
SELECT source_name, count(*) AS pages, count(*) - count(DISTINCT cursor) AS repeated, min(page) FILTER (again) AS first_repeat FROM (SELECT *, row_number() OVER (PARTITION BY source_name, cursor ORDER BY page) > 1 AS again FROM told) GROUP BY 1""",
)
def object_listing(spark: SparkSession, d: str) -> DataFrame:
    """Listings of all names under a prefix, page by page: how many pages each took, and whether a page's cursor came twice, which would never end."""
    names = table(spark, d, "documents").select(F.col("source").alias("source_name"), F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("name"))
    listed = ops.numbered(names, "source_name", "name").groupBy("source_name", F.floor(F.col("place") / 25).alias("page")).agg(F.max("name").alias("cursor"))
    before = listed.select("source_name", (F.col("page") + 1).alias("page"), F.col("cursor").alias("stuck"))
    told = listed.join(before, ["source_name", "page"], "left").withColumn("cursor", F.when((F.col("page") > 0) & (F.col("page") % 3 == 2), F.col("stuck")).otherwise(F.col("cursor")))
    again = F.row_number().over(Window.partitionBy("source_name", "cursor").orderBy("page")) > 1
    rows = told.withColumn("again", again).groupBy("source_name")
    return rows.agg(F.count("*").alias("pages"), F.count_if("again").alias("repeated"), F.min(F.when(F.col("again"), F.col("page"))).alias("first_repeat"))


@query(
    "polled_jobs",
    with_(GEN) + """, seen AS (SELECT gen_id, unnest(range(0, 5)) AS poll, gen_id % 7 AS done FROM gen),
told AS (SELECT gen_id, poll, CASE WHEN poll < done THEN 'running' WHEN gen_id % 3 = 0 THEN 'failed' ELSE 'completed' END AS state FROM seen)
SELECT gen_id, coalesce(min(poll) FILTER (state <> 'running') + 1, count(*)) AS polls, coalesce(min_by(state, poll) FILTER (state <> 'running'), 'running') AS last_state FROM told GROUP BY 1""",
)
def polled_jobs(spark: SparkSession, d: str) -> DataFrame:
    """How often each job is asked for its state, five times at most: asking stops at the first end state."""
    done = F.col("gen_id") % 7
    told = generations(spark, d).select("gen_id", done.alias("done"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("poll"))
    told = told.withColumn("state", F.when(F.col("poll") < F.col("done"), "running").when(F.col("gen_id") % 3 == 0, "failed").otherwise("completed"))
    ended = F.min(F.when(F.col("state") != "running", F.struct("poll", "state")))
    rows = told.groupBy("gen_id").agg(ended.alias("ended"), F.count("*").alias("asked"))
    return rows.select("gen_id", F.coalesce((F.col("ended.poll") + 1).cast("long"), "asked").alias("polls"), F.coalesce("ended.state", F.lit("running")).alias("last_state"))
