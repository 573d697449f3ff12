"""Secret scans with an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its content. A ledger
holds each (blob, rule version) pair that was scanned, with its findings. A
scan takes only one copy of each blob that the ledger doesn't know, applies the
rules, and adds to the ledger; the findings of old and new blobs join back to
every path that has the blob. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import whole_text

RULE_VERSION = "1"
#: Parts that the paths of a blob are dealt to.
SALTS = 8
KEYWORD = "".join(f"[{c.upper()}{c}]" for c in "password") + "|" + "".join(f"[{c.upper()}{c}]" for c in "passwd") + "|" + "".join(f"[{c.upper()}{c}]" for c in "secret") + "|" + "".join(f"[{c.upper()}{c}]" for c in "token") + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"(?:{KEYWORD})[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
#: What stands before the value of an assignment. The value can't hold a colon or quote, but it can start with "=" signs, which the pattern gives to the separator only once.
LEAD = rf"^(?:{KEYWORD})[\"']?\x20*[:=]\x20*[\"']?"
ACCESS = r"AKIA[A-Z0-9]+"
#: Its matches are whole runs, so the least length can stand in the pattern.
HEX = r"[0-9a-f]{24,}"
#: Added by the method: a header of a private key, and a bearer token.
KEY = r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"
BEARER = r"Bearer\x20[A-Za-z0-9._~+/-]{20,512}"

#: kind, pattern, least length, in the listed order; a length under it drops the match.
RULES = (("assign", ASSIGN, 0), ("access", ACCESS, 20), ("hex", HEX, 0), ("key", KEY, 0), ("bearer", BEARER, 0))
BASE = ("assign", "access", "hex")


def sizes(text: Column, kind: int) -> Column:
    """array<struct<b, m, good>>: the lengths of a rule's matches and of what lies before each, and whether the match counts."""
    name, pattern, least = RULES[kind]
    good = (lambda m: F.length(F.regexp_replace(m, LEAD, "")) >= 6) if name == "assign" else (lambda m: F.length(m) >= least)
    said = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.zip_with(F.slice(F.split(text, pattern), F.lit(1), F.size(said)), said, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m"), good(m).alias("good")))
    # most texts have no match, and a search that only looks stops at the first
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<b:int,m:int,good:boolean>>"))


def rule_findings(blobs: DataFrame) -> DataFrame:
    """blob, spans array<struct<at, kind, until>> by position and then kind, of blob, text; blobs are unique.

    Places are running sums over the rows of a blob's matches, so the work grows with their number, not with its square.
    """
    rules = F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), sizes(F.col("text"), k).alias("sizes")) for k in range(len(RULES)))), lambda r: F.size(r["sizes"]) > 0)
    each = blobs.select("blob", F.explode_outer(rules).alias("rule")).select("blob", "rule.kind", F.posexplode_outer("rule.sizes").alias("place", "size"))
    until = F.sum(F.col("size.b") + F.col("size.m")).over(Window.partitionBy("blob", "kind").orderBy("place")).cast("int")
    told = each.select("blob", "kind", "size.m", "size.good", until.alias("until"))
    span = F.when(F.col("good"), F.struct((F.col("until") - F.col("m")).alias("at"), "kind", "until"))
    return told.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def unseen(docs: DataFrame, ledger: DataFrame | None, rule_version: str) -> DataFrame:
    """blob, text: one copy of each content that the ledger lacks at this rule version."""
    blobs = docs.select("blob", "text")
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    return blobs.dropDuplicates(["blob"])


def spelled(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k, _, _ in RULES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["at"].cast("string"), s["until"].cast("string"))), ",")


def scan(docs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """The ledger after docs: blob, rule_version, spans, a row for each pair scanned so far.

    docs: any version of any document, as doc_id and text; other columns are
    ignored. A blob is scanned once for each rule version, however many rows
    and earlier scans have it. Null text counts as empty; ids may be null or
    repeat. Write the ledger before it is used for the next scan.
    """
    rows = docs.select(whole_text().alias("text")).withColumn("blob", F.sha2("text", 256))
    now = rule_findings(unseen(rows, ledger, rule_version)).select("blob", F.lit(rule_version).alias("rule_version"), "spans")
    return now if ledger is None else ledger.select("blob", "rule_version", "spans").unionByName(now)


def by_document(docs: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """A row for each row of docs with the findings that the ledger has of its blob: counts and digest of the base rules, and all spans.

    Spans come by position, and by kind in the listed order where positions tie.
    A blob that the ledger lacks at this rule version has no findings. Paths of
    one blob are dealt to SALTS parts, so copies of one text aren't one task.
    """
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    paths = docs.select("doc_id", F.sha2(whole_text(), 256).alias("blob"), salt.alias("salt"))
    known = ledger.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spans = F.coalesce(F.col("spans"), F.array().cast("array<struct<at:int,kind:int,until:int>>"))
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    rows = paths.join(known, ["blob", "salt"], "left").withColumn("spans", spans)
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return rows.select("doc_id", *counts, F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def _oracle() -> str:
    literal = lambda p: p.replace("'", "''")
    own = {"hex": "[0-9a-f]+"}
    parts = "\nUNION ALL ".join(
        f"SELECT rid, {k} AS kind, t, regexp_extract_all(t, '{literal(own.get(name, pattern))}') AS ms, string_split_regex(t, '{literal(own.get(name, pattern))}') AS bs FROM d WHERE regexp_matches(t, '{literal(pattern)}')"
        for k, (name, pattern, _) in enumerate(RULES)
    )
    lead = literal(LEAD)
    names = ", ".join(f"'{name}'" for name, _, _ in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({parts}),
each AS (SELECT rid, kind, unnest(ms) AS m, unnest(bs[1:len(ms)]) AS b, unnest(range(len(ms))) AS i FROM raw),
placed AS (SELECT rid, kind, m, sum(length(b) + length(m)) OVER (PARTITION BY rid, kind ORDER BY i) AS until FROM each),
good AS (SELECT rid, kind, (until - length(m))::BIGINT AS p, until::BIGINT AS u FROM placed
  WHERE CASE kind WHEN 0 THEN length(regexp_replace(m, '{lead}', '')) >= 6 WHEN 1 THEN length(m) >= 20 WHEN 2 THEN length(m) >= 24 ELSE true END),
said AS (SELECT rid, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
  coalesce(string_agg([{names}][kind + 1] || ':' || p || ':' || u, ',' ORDER BY p, kind) FILTER (kind < 3), '') AS base,
  string_agg([{names}][kind + 1] || ':' || p || ':' || u, ',' ORDER BY p, kind) AS spans FROM good GROUP BY rid)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN said USING (rid)"""


ORACLE = _oracle()
