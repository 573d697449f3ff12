"""Text guards, normal forms, tokens, terms and structural text over `documents` and literal fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.plans.base import CATALOG
from lectern.session import spread, table
from lectern.sources import decks

query = CATALOG.query
RE_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
WORDS_SQL = {k: ", ".join(f"'{w}'" for w in v) for k, v in t.STOP_WORDS.items()}


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query("text_guard", r"SELECT doc_id, NOT regexp_matches(text, '[\x00-\x08\x0B\x0E-\x1F\x7F]') AS plain, trim(text) = '' AS blank FROM documents")
def text_guard(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", (F.expr("is_valid_utf8(text)") & ~F.col("text").rlike(t.CONTROL)).alias("plain"), (F.trim("text") == "").alias("blank"))


@query("text_normalize", "SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '^﻿', ''), '\\r\\n|\\r|\\f', E'\\n', 'g')) AS digest, len(string_split(text, E'\\n')) AS lines FROM documents")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    clean = t.normalized(F.col("text"))
    return docs(spark, d).select("doc_id", F.sha2(clean, 256).alias("digest"), F.size(F.split(clean, "\n")).cast("bigint").alias("lines"))


@query("content_hash", "SELECT sha256(text) AS content, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).groupBy(F.sha2("text", 256).alias("content")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


@query("etag_check", "SELECT doc_id, substr(sha256(text), 1, 32) AS etag, substr(sha256(text), 1, 32) = substr(sha256(CASE WHEN doc_id % 6 = 0 THEN lang ELSE text END), 1, 32) AS matches FROM documents")
def etag_check(spark: SparkSession, d: str) -> DataFrame:
    etag = lambda c: F.substring(F.sha2(c, 256), 1, 32)
    held = F.when(F.col("doc_id") % 6 == 0, F.col("lang")).otherwise(F.col("text"))
    return docs(spark, d).select("doc_id", etag(F.col("text")).alias("etag"), (etag(F.col("text")) == etag(held)).alias("matches"))


@query("object_list_page", "SELECT name, n_chars, row_number() OVER (ORDER BY name) AS place FROM (SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS name, n_chars FROM documents) WHERE name LIKE 'src1%' AND name > 'src10/000000300' QUALIFY place <= 25")
def object_list_page(spark: SparkSession, d: str) -> DataFrame:
    names = docs(spark, d).select(F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("name"), "n_chars")
    page = names.where(F.col("name").startswith("src1") & (F.col("name") > "src10/000000300")).orderBy("name").limit(25)
    return page.withColumn("place", F.row_number().over(Window.orderBy("name")))


@query("token_counts", f"SELECT doc_id, len(regexp_extract_all(text, '{RE_TOKEN}')) AS tokens FROM documents")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return spread(docs(spark, d).select("doc_id", "text")).select("doc_id", t.tokens(F.col("text")).cast("bigint").alias("tokens"))


@query("evidence_cost", f"""SELECT source, len(regexp_extract_all('[' || string_agg('{{"chunk_id":' || doc_id || ',"text":' || to_json(text) || '}}', ',') || ']', '{RE_TOKEN}'))::BIGINT AS cost FROM documents GROUP BY 1""")
def evidence_cost(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the JSON list of a source's evidence. Punctuation is a token each, so the list costs its items, the commas between them and two brackets; it is never built."""
    written = F.to_json(F.struct(F.col("doc_id").alias("chunk_id"), "text"))
    return docs(spark, d).groupBy("source").agg((F.sum(t.tokens(written)) + F.count("*") + 1).alias("cost"))


@query("text_identity", r"SELECT sha256(trim(regexp_replace(text, '[ \t\n\r\x0B\f]+', ' ', 'g'))) AS identity, count(*) AS n FROM documents GROUP BY 1")
def text_identity(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).groupBy(F.sha2(t.identity(F.col("text")), 256).alias("identity")).agg(F.count("*").alias("n"))


@query(
    "html_field",
    """SELECT doc_id, sha256('<span>' || replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '[', '&#91;'), ']', '&#93;'), E'\\n', '<br>'), E'\\t', '&#9;') || '</span>') AS field FROM documents""",
)
def html_field(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.sha2(t.html_field(F.col("text")), 256).alias("field"))


@query(
    "tag_normalize",
    r"""WITH raw AS (SELECT p_partkey, [p_name || ' / ' || p_type, ' ' || p_type || ' ', p_type, '-' || p_brand, 'e' || chr(769) || lower(p_name), '-' || p_brand] AS raws FROM part),
each AS (SELECT p_partkey, list_transform(raws, lambda r: regexp_replace(trim(nfc_normalize(r)), '[^\p{L}\p{N}_:.\-]', '_', 'g')) AS cleans FROM raw),
named AS (SELECT p_partkey, list_transform(cleans, lambda x: CASE WHEN x LIKE '-%' THEN 'nm_' || x ELSE x END) AS tags FROM each)
SELECT p_partkey, array_to_string(list_filter(tags, lambda x, i: list_position(tags, x) = i), ' ') AS tags FROM named""",
)
def tag_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Tags in composed form, each once, in the order they came."""
    brand = F.concat(F.lit("-"), "p_brand")
    raws = F.array(F.concat_ws(" / ", "p_name", "p_type"), F.concat(F.lit(" "), "p_type", F.lit(" ")), F.col("p_type"), brand, F.concat(F.lit("é"), F.lower("p_name")), brand)
    return table(spark, d, "part").select("p_partkey", F.array_join(t.tags(raws), " ").alias("tags"))


@query(
    "markdown_text",
    r"""SELECT doc_id, sha256(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\`*_{}\[\]()#+.!|>~-])', '\\\1', 'g')) AS body,
sha256(regexp_replace(replace(replace(replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\`*_{}\[\]()#+.!|>~-])', '\\\1', 'g')) AS heading FROM documents""",
)
def markdown_text(spark: SparkSession, d: str) -> DataFrame:
    """The text as Markdown shows it unchanged, as it stands and as one line."""
    return docs(spark, d).select("doc_id", F.sha2(t.markdown_text(F.col("text")), 256).alias("body"), F.sha2(t.markdown_text(F.col("text"), one_line=True), 256).alias("heading"))


@query("config_fingerprint", """SELECT p_partkey, substr(sha256('{"overlap":' || p_size || ',"target":' || (700 + p_size) || '}'), 1, 16) AS fingerprint FROM part""")
def config_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A digest of a chunking configuration, from its JSON with sorted keys."""
    config = F.to_json(F.struct(F.col("p_size").alias("overlap"), (F.lit(700) + F.col("p_size")).alias("target")))
    return table(spark, d, "part").select("p_partkey", F.substring(F.sha2(config, 256), 1, 16).alias("fingerprint"))


@query("stable_ids", "SELECT doc_id, CAST('0x' || substr(sha256(source || ':' || doc_id), 1, 12) AS BIGINT) AS stable_id FROM documents")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", t.stable_id(F.concat_ws(":", "source", "doc_id")).alias("stable_id"))


@query(
    "lang_tag",
    """SELECT doc_id, raw, CASE WHEN low = 'mixto' THEN low ELSE split_part(low, '-', 1) END AS tag FROM (SELECT doc_id, raw, replace(lower(trim(raw)), '_', '-') AS low FROM (
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN upper(lang) || '-US' WHEN 2 THEN ' ' || lang || '_BR ' WHEN 3 THEN 'Mixto' ELSE upper(lang) END AS raw FROM documents))""",
)
def lang_tag(spark: SparkSession, d: str) -> DataFrame:
    """The languages of documents, written in five ways, as tags."""
    kind = F.col("doc_id") % 5
    raw = F.when(kind == 0, F.col("lang")).when(kind == 1, F.concat(F.upper("lang"), F.lit("-US"))).when(kind == 2, F.concat(F.lit(" "), "lang", F.lit("_BR "))).when(kind == 3, "Mixto").otherwise(F.upper("lang"))
    return docs(spark, d).select("doc_id", raw.alias("raw")).withColumn("tag", t.language_tag(F.col("raw")))


LANG = r"""w AS (SELECT doc_id, source, lang, regexp_extract_all(lower(text), '[\p{L}]+') AS words FROM documents),
n AS (SELECT doc_id, source, """ + ", ".join(f"len(list_filter(words, lambda x: x IN ({v}))) AS {k}" for k, v in WORDS_SQL.items()) + """ FROM w),
told AS (SELECT doc_id, source, CASE WHEN es >= en AND es >= pt THEN 'es' WHEN en >= pt THEN 'en' ELSE 'pt' END AS language FROM n)"""


@query("detect_language", f"WITH {LANG} SELECT doc_id, language FROM told")
def detect_language(spark: SparkSession, d: str) -> DataFrame:
    return spread(docs(spark, d).select("doc_id", "text")).select("doc_id", t.language(F.col("text")).alias("language"))


@query("collective_language", f"WITH {LANG} SELECT source, CASE WHEN count(DISTINCT language) = 1 THEN min(language) ELSE 'mixto' END AS language FROM told GROUP BY 1")
def collective_language(spark: SparkSession, d: str) -> DataFrame:
    told = spread(docs(spark, d).select("source", "text")).select("source", t.language(F.col("text")).alias("language"))
    return told.groupBy("source").agg(F.when(F.min("language") == F.max("language"), F.min("language")).otherwise("mixto").alias("language"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "said"))


@query(
    "line_offsets",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, E'\\n')) AS said, generate_subscripts(string_split(text, E'\\n'), 1) - 1 AS line FROM documents)
SELECT doc_id, line, coalesce(sum(length(said) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_index FROM l""",
)
def line_offsets(spark: SparkSession, d: str) -> DataFrame:
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines(spark, d).select("doc_id", F.col("line").cast("bigint").alias("line"), F.coalesce(F.sum(F.length("said") + 1).over(before), F.lit(0)).alias("start_index"))


CHUNK_SQL = """c AS (SELECT doc_id, source, lang, generate_subscripts(string_split(text, E'\\n'), 1) - 1 AS idx, unnest(string_split(text, E'\\n')) AS said FROM documents),
chunk AS (SELECT * FROM c WHERE trim(said) <> '')"""


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """Paragraph chunks of the documents: a line that isn't blank."""
    return docs(spark, d).select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("idx", "said")).where(F.trim("said") != "")


@query("chunk_ids", f"""WITH {CHUNK_SQL} SELECT doc_id, idx::BIGINT AS idx, 'chk_' || substr(sha256('["' || source || '",' || doc_id || ',' || idx || ',"' || sha256(said) || '"]'), 1, 24) AS chunk_id FROM chunk""")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    recipe = F.concat(F.lit('["'), "source", F.lit('",'), "doc_id", F.lit(","), "idx", F.lit(',"'), F.sha2("said", 256), F.lit('"]'))
    return chunk_rows(spark, d).select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.concat(F.lit("chk_"), F.substring(F.sha2(recipe, 256), 1, 24)).alias("chunk_id"))


SECTION_SQL = "CASE WHEN doc_id % 4 = 0 THEN 'sec_' || (idx % 3) WHEN doc_id % 4 = 1 THEN 'pagina:' || (idx + 1) WHEN doc_id % 4 = 2 AND trim(lang) <> '' THEN lang ELSE 'documento' END"


def sectioned(spark: SparkSession, d: str) -> DataFrame:
    kind, idx = F.col("doc_id") % 4, F.col("idx")
    section_id = F.when(kind == 0, F.concat(F.lit("sec_"), idx % 3))
    page = F.when(kind == 1, F.concat(F.lit("pagina:"), idx + 1))
    title = F.when((kind == 2) & (F.trim("lang") != ""), F.col("lang"))
    return chunk_rows(spark, d).withColumn("section", F.coalesce(section_id, page, title, F.lit("documento")))


@query("section_key", f"WITH {CHUNK_SQL} SELECT doc_id, idx::BIGINT AS idx, {SECTION_SQL} AS section FROM chunk")
def section_key(spark: SparkSession, d: str) -> DataFrame:
    return sectioned(spark, d).select("doc_id", F.col("idx").cast("bigint").alias("idx"), "section")


@query("section_inventory", f"WITH {CHUNK_SQL}, s AS (SELECT doc_id, {SECTION_SQL} AS section, min(idx) AS first_idx FROM chunk GROUP BY 1, 2) SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id ORDER BY first_idx, section) AS place FROM s")
def section_inventory(spark: SparkSession, d: str) -> DataFrame:
    firsts = sectioned(spark, d).groupBy("doc_id", "section").agg(F.min("idx").alias("first_idx"))
    return firsts.select("doc_id", "section", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_idx", "section")).alias("place"))


@query("ambiguous_sections", f"WITH {CHUNK_SQL} SELECT doc_id, trim(said) AS title, count(*) AS n FROM chunk WHERE doc_id % 4 >= 2 GROUP BY 1, 2 HAVING count(*) > 1")
def ambiguous_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = chunk_rows(spark, d).where("doc_id % 4 >= 2").groupBy("doc_id", F.trim("said").alias("title"))
    return rows.agg(F.count("*").alias("n")).where("n > 1")


# Fixed patterns of terms with Unicode boundaries; True marks identifiers. Possessive word runs keep the last one from looking back into words.
WORD = r"[\p{L}\p{N}_]"
TERM_PATTERNS = (
    (r"`([^`\n]{1,100})`", True),
    (rf"(?<!{WORD})([A-Z][A-Z0-9_-]{{1,15}}(?:\.[A-Za-z_][\p{{L}}\p{{N}}_.]*)?)(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))", True),
    (rf"(?<!{WORD})((?:Oracle|Google|Amazon|Microsoft)(?:[ \t]+[A-Z][\p{{L}}\p{{N}}_-]*){{1,4}})", True),
    (rf"(?<!{WORD})(IPv[46]|[A-Za-z]+_[A-Za-z0-9_]+|(?:[A-Z][a-z]+){{2,}}|[a-z]+(?:[A-Z][a-z0-9]*)+)(?!{WORD})", True),
    (r"\*\*([^*\n]{2,100})\*\*", False),
    (r"(?m)^#{1,6}[ \t]+(.{2,100})$", False),
    (r"(?<![\p{L}\p{N}_])([\p{L}\p{N}_×÷][\p{L}\p{N}_×÷-]*+(?:[ \t]++[\p{L}\p{N}_×÷][\p{L}\p{N}_×÷-]*+){0,5})[ \t]++(?iu:es|son|is|are|é|são)[ \t]++", False),
)
ARTICLE = r"^(?:una?|las?|los?|the|an?|uma?|os|as)\s+"
# the same in the other engine, which has no look-around: a letter beside a match is taken along and the match is then dropped
_BESIDE = r"[^\x00-\x7F]?"
_DOUBLED = r"regexp_replace(said, '([^\x00-\x7F])', '\1\1', 'g')"  # so that a letter between two matches goes with both
_SQL_PATTERNS = (
    (r"`([^`\n]{1,100})`", True, False),
    (rf"{_BESIDE}\b[A-Z][A-Z0-9_-]{{1,15}}(?:\.[A-Za-z_][\p{{L}}\p{{N}}_.]*)?\b{_BESIDE}", True, True),
    (rf"{_BESIDE}\b(?:Oracle|Google|Amazon|Microsoft)(?:[ \t]+[A-Z][\p{{L}}\p{{N}}_-]*){{1,4}}", True, True),
    (rf"{_BESIDE}\b(?:IPv[46]|[A-Za-z]+_[A-Za-z0-9_]+|(?:[A-Z][a-z]+){{2,}}|[a-z]+(?:[A-Z][a-z0-9]*)+)\b{_BESIDE}", True, True),
    (r"\*\*([^*\n]{2,100})\*\*", False, False),
    (r"(?m)^#{1,6}[ \t]+(.{2,100})$", False, False),
    (r"(?i)([\p{L}\p{N}_À-ÿ][\p{L}\p{N}_À-ÿ-]*(?:[ \t]+[\p{L}\p{N}_À-ÿ][\p{L}\p{N}_À-ÿ-]*){0,5})[ \t]+(?:es|son|is|are|é|são)[ \t]+", False, False),
)
TERM_SQL = CHUNK_SQL + ", raw AS (" + "\nUNION ALL ".join(
    f"SELECT doc_id, idx, {str(flag).lower()} AS identifier, {str(beside).lower()} AS beside, unnest(regexp_extract_all({_DOUBLED if beside else 'said'}, '{p}'{'' if beside else ', 1'})) AS said FROM chunk"
    for p, flag, beside in _SQL_PATTERNS
) + r"""), own AS (SELECT doc_id, idx, identifier, CASE WHEN beside THEN trim(said, '“”‘’«»„…–—') ELSE said END AS said FROM raw WHERE NOT beside OR NOT regexp_matches(regexp_replace(said, '^[\x00-\x7F].*[\x00-\x7F]$', ''), '^[\p{L}\p{N}]|[\p{L}\p{N}]$')),
clean AS (SELECT doc_id, idx, identifier, CASE WHEN identifier THEN trim(regexp_replace(said, '\s+', ' ', 'g')) ELSE regexp_replace(trim(trim(regexp_replace(said, '\s+', ' ', 'g')), '.,:;()'), '^(una?|las?|los?|the|an?|uma?|os|as)\s+', '', 'i') END AS term FROM own),
term AS (SELECT *, lower(term) AS key FROM clean WHERE length(term) BETWEEN 2 AND 100 AND upper(term) NOT IN (""" + ", ".join(f"'{w}'" for w in t.NOISE) + "))"


def terms(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, idx, identifier, key of every sighting of a term, from one scan."""
    said = lambda flag: lambda x: F.struct(F.lit(flag).alias("identifier"), x.alias("said"))
    found = F.concat(*(F.transform(F.regexp_extract_all("said", F.lit(p), F.lit(1)), said(flag)) for p, flag in TERM_PATTERNS))
    rows = spread(chunk_rows(spark, d).select("doc_id", "idx", "said")).select("doc_id", "idx", F.explode(found).alias("m")).select("doc_id", "idx", "m.*")
    flat = F.trim(F.regexp_replace("said", r"\s+", " "))
    bare = F.regexp_replace(F.regexp_replace(flat, r"^[.,:;()]+|[.,:;()]+$", ""), "(?i)" + ARTICLE, "")
    rows = rows.withColumn("term", F.when(F.col("identifier"), flat).otherwise(bare)).where(F.length("term").between(2, 100) & ~F.upper("term").isin(*t.NOISE))
    return rows.select("doc_id", "idx", "identifier", F.lower("term").alias("key"))


@query(
    "term_candidates",
    f"""WITH {TERM_SQL}, merged AS (SELECT doc_id, key, bool_or(identifier) AS identifier, count(*) AS sightings FROM term GROUP BY 1, 2)
SELECT doc_id, key, identifier, sightings, place, greatest(0, n - 64) AS omitted FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY identifier DESC, key) AS place, count(*) OVER (PARTITION BY doc_id) AS n FROM merged) WHERE place <= 64""",
)
def term_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The 64 first terms of each document, identifiers ahead, and how many more it has."""
    merged = terms(spark, d).groupBy("doc_id", "key").agg(F.bool_or("identifier").alias("identifier"), F.count("*").alias("sightings"))
    own = Window.partitionBy("doc_id")
    placed = merged.withColumns({"place": F.row_number().over(own.orderBy(F.desc("identifier"), "key")), "omitted": F.greatest(F.lit(0), F.count("*").over(own) - 64)})
    return placed.where("place <= 64")


@query("term_locations", f"WITH {TERM_SQL}, l AS (SELECT DISTINCT doc_id, key, idx FROM term) SELECT doc_id, key, idx::BIGINT AS idx, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY idx) AS place FROM l) WHERE place <= 8")
def term_locations(spark: SparkSession, d: str) -> DataFrame:
    """The first 8 chunks of a document that hold each of its terms."""
    places = terms(spark, d).select("doc_id", "key", F.col("idx").cast("bigint").alias("idx")).distinct()
    return places.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("idx"))).where("place <= 8")


@query("glossary_search", f"WITH {TERM_SQL} SELECT DISTINCT key, translate(key, 'áéíóúüñàèìòùâêîôûç', 'aeiouunaeiouaeiouc') AS sort_key FROM term WHERE contains(key, 'ta')")
def glossary_search(spark: SparkSession, d: str) -> DataFrame:
    plain = F.translate("key", "áéíóúüñàèìòùâêîôûç", "aeiouunaeiouaeiouc")
    return terms(spark, d).where(F.col("key").contains("ta")).select("key", plain.alias("sort_key")).distinct()


@query(
    "fence_length",
    """SELECT conv_id, turn, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(said, '`+'), lambda x: length(x))), 0) + 1)::INT) AS fence
FROM (SELECT conv_id, turn, role || repeat('`', (turn % 6)::INT) || text || repeat('`', (conv_id % 9)::INT) AS said FROM conversations)""",
)
def fence_length(spark: SparkSession, d: str) -> DataFrame:
    """The fence that each turn needs around it, when it has runs of marks itself."""
    marks = lambda n: F.repeat(F.lit("`"), n.cast("int"))
    said = F.concat("role", marks(F.col("turn") % 6), "text", marks(F.col("conv_id") % 9))
    return table(spark, d, "conversations").select("conv_id", "turn", t.fence(said).alias("fence"))


@query(
    "section_ranges",
    """WITH h AS (SELECT conv_id, turn * 3 + 1 AS line, role || ' ' || turn AS title FROM conversations WHERE turn % 2 = 0), n AS (SELECT conv_id, max(turn) * 3 + 3 AS lines FROM conversations GROUP BY 1)
SELECT conv_id, title, line AS line_start, coalesce(lead(line) OVER (PARTITION BY conv_id ORDER BY line) - 1, lines) AS line_end FROM h JOIN n USING (conv_id)""",
)
def section_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Three lines for each turn, of which every second one has a heading: a section ends before the next heading or with the text."""
    turns = table(spark, d, "conversations")
    lines = turns.groupBy("conv_id").agg((F.max("turn") * 3 + 3).alias("lines"))
    heads = turns.where("turn % 2 = 0").select("conv_id", (F.col("turn") * 3 + 1).alias("line"), F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("title"))
    following = F.lead("line").over(Window.partitionBy("conv_id").orderBy("line")) - 1
    return heads.withColumn("following", following).join(lines, "conv_id").select("conv_id", "title", F.col("line").alias("line_start"), F.coalesce("following", "lines").alias("line_end"))


# pages as files of seven kinds of names, some a thousand times as large, half of them with the mark of a PDF
FILES_SQL = """f AS (SELECT page_id, 'p' || page_id || ['.PDF', '.markdown', '.txt', '.exe', '.pdf', '.TXT', '.md'][(page_id % 7 + 1)::INT] AS label, octet_length(encode(html)) * CASE WHEN page_id % 3 = 0 THEN 10000 ELSE 1 END AS size, CASE WHEN page_id % 2 = 0 THEN '%PDF-1.7 ' || html ELSE html END AS head FROM pages)"""


@query(
    "gate_files",
    f"""WITH {FILES_SQL}, r AS (SELECT *, lower(regexp_extract(label, '[^.]+$')) AS raw FROM f), x AS (SELECT *, CASE raw WHEN 'markdown' THEN 'md' ELSE raw END AS ext FROM r)
SELECT page_id, label, ext, CASE WHEN ext NOT IN ('pdf', 'md', 'txt') THEN 'type' WHEN size > CASE ext WHEN 'pdf' THEN 20 ELSE 5 END * 1048576 THEN 'size' WHEN ext = 'pdf' AND NOT contains(substr(head, 1, 1024), '%PDF-') THEN 'magic' ELSE 'ok' END AS verdict FROM x""",
)
def gate_files(spark: SparkSession, d: str) -> DataFrame:
    """What the gate says of each page as a file: its kind, its size, and what it starts with."""
    page = F.col("page_id")
    ends = F.array(*(F.lit(x) for x in (".PDF", ".markdown", ".txt", ".exe", ".pdf", ".TXT", ".md")))
    label = F.concat(F.lit("p"), page.cast("string"), F.get(ends, (page % 7).cast("int")))
    size = F.octet_length("html").cast("long") * F.when(page % 3 == 0, 10_000).otherwise(1)
    rows = table(spark, d, "pages").select("page_id", label.alias("label"), size.alias("size"), F.when(page % 2 == 0, F.concat(F.lit("%PDF-1.7 "), "html")).otherwise(F.col("html")).alias("head"))
    rows = rows.withColumn("raw", F.lower(F.regexp_extract("label", "[^.]+$", 0))).withColumn("ext", F.when(F.col("raw") == "markdown", "md").otherwise(F.col("raw")))
    most = F.when(F.col("ext") == "pdf", 20 << 20).otherwise(5 << 20)
    no_magic = (F.col("ext") == "pdf") & ~F.substring("head", 1, 1024).contains("%PDF-")
    verdict = F.when(~F.col("ext").isin("pdf", "md", "txt"), "type").when(F.col("size") > most, "size").when(no_magic, "magic").otherwise("ok")
    return rows.select("page_id", "label", "ext", verdict.alias("verdict"))


@query(
    "raster_budget",
    """SELECT p_partkey, round(s, 6) AS scale, (258 * ceil(w * s / 360) * ceil(h * s / 360))::BIGINT AS tokens FROM (SELECT p_partkey, w, h, least(2.5, 2000.0 / greatest(w, h), sqrt(3e6 / w / h)) AS s FROM (SELECT p_partkey, 300.0 + p_size * 20 AS w, 400.0 + p_partkey % 1000 AS h FROM part))""",
)
def raster_budget(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.lit(300.0) + F.col("p_size") * 20, F.lit(400.0) + F.col("p_partkey") % 1000
    s = F.least(F.lit(2.5), F.lit(2000.0) / F.greatest(w, h), F.sqrt(F.lit(3e6) / w / h))
    return table(spark, d, "part").select("p_partkey", F.round(s, 6).alias("scale"), (258 * F.ceil(w * s / 360) * F.ceil(h * s / 360)).cast("bigint").alias("tokens"))


@query(
    "export_matrix",
    """SELECT kind, format, format IN ('json', 'md', 'pdf') OR kind = 'flashcards' AS allowed, count(*) AS asked FROM (
SELECT ['flashcards', 'quiz', 'summary', 'tutorial', 'script'][(o_custkey % 5 + 1)::INT] AS kind, ['json', 'md', 'pdf', 'csv', 'tsv', 'apkg'][(o_orderkey % 6 + 1)::INT] AS format FROM orders) GROUP BY ALL""",
)
def export_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Which exports that were asked for are allowed, and how often each was: cards in every format, the others as text or pages."""
    pick = lambda names, at: F.get(F.array(*(F.lit(x) for x in names)), at.cast("int"))
    kind = pick(("flashcards", "quiz", "summary", "tutorial", "script"), F.col("o_custkey") % 5)
    form = pick(("json", "md", "pdf", "csv", "tsv", "apkg"), F.col("o_orderkey") % 6)
    asked = table(spark, d, "orders").select(kind.alias("kind"), form.alias("format")).groupBy("kind", "format").agg(F.count("*").alias("asked"))
    return asked.withColumn("allowed", F.col("format").isin("json", "md", "pdf") | (F.col("kind") == "flashcards"))


HTML_SQL = "'<span>' || replace(replace(replace(replace(replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), '[', '&#91;'), ']', '&#93;'), E'\\n', '<br>'), E'\\t', '&#9;') || '</span>'"


@query(
    "deck_rows",
    f"""WITH heads AS (SELECT unnest([chr(65279) || '#separator:Comma', '#html:true', '#tags column:3', '#guid column:4', '#deck column:5', '#columns:Front,Back,Tags,GUID,Deck']) AS line, unnest(range(0, 6)) AS place),
cards AS (SELECT conv_id, 6 + turn AS place, list_transform([{HTML_SQL.format("role")}, {HTML_SQL.format("text")}, role || ' doc_' || conv_id, substr(sha256(conv_id || ':' || turn), 1, 12), 'deck ' || conv_id], lambda f: '"' || replace(f, '"', '""') || '"') AS fields FROM conversations)
SELECT conv_id AS deck_id, place, line FROM heads, (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT conv_id, place, array_to_string(fields, ',') FROM cards""",
)
def deck_rows(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a deck's file for each conversation."""
    cards = table(spark, d, "conversations").select(
        F.col("conv_id").alias("deck_id"), F.col("turn").alias("place"), t.html_field(F.col("role")).alias("front"), t.html_field(F.col("text")).alias("back"),
        F.concat_ws(" ", t.tag(F.col("role")), t.tag(F.concat(F.lit("doc_"), "conv_id"))).alias("tags"), F.substring(F.sha2(F.concat_ws(":", "conv_id", "turn"), 256), 1, 12).alias("guid"),
        F.concat(F.lit("deck "), "conv_id").alias("deck"),
    )
    return decks.deck_lines(cards)


@query(
    "footnote_text",
    """WITH firsts AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1, 2),
notes AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY first_line, l_partkey) AS note FROM firsts),
lines AS (SELECT l_orderkey, l_linenumber, string_agg(DISTINCT '[^' || note || ']', '' ORDER BY '[^' || note || ']') AS marks FROM lineitem JOIN notes USING (l_orderkey, l_partkey) GROUP BY 1, 2),
body AS (SELECT l_orderkey, string_agg('line ' || l_linenumber || marks, E'\\n' ORDER BY l_linenumber) AS said FROM lines GROUP BY 1),
foot AS (SELECT l_orderkey, string_agg('[^' || note || ']: part ' || l_partkey, E'\\n' ORDER BY note) AS said FROM notes GROUP BY 1)
SELECT l_orderkey, sha256(body.said || E'\\n\\n' || foot.said) AS page FROM body JOIN foot USING (l_orderkey)""",
)
def footnote_text(spark: SparkSession, d: str) -> DataFrame:
    """Each order's lines as Markdown, with footnotes numbered by their first use."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    firsts = lines.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("first_line"))
    notes = firsts.withColumn("note", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("first_line", "l_partkey")))
    mark = F.concat(F.lit("[^"), "note", F.lit("]"))
    each = lines.join(notes, ["l_orderkey", "l_partkey"]).groupBy("l_orderkey", "l_linenumber").agg(F.array_join(F.array_sort(F.collect_set(mark)), "").alias("marks"))
    written = lambda struct: F.transform(F.array_sort(F.collect_list(struct)), lambda x: x["said"])
    body = each.groupBy("l_orderkey").agg(F.array_join(written(F.struct("l_linenumber", F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), "marks").alias("said"))), "\n").alias("body"))
    foot = notes.groupBy("l_orderkey").agg(F.array_join(written(F.struct("note", F.concat(mark, F.lit(": part "), F.col("l_partkey").cast("string")).alias("said"))), "\n").alias("foot"))
    return body.join(foot, "l_orderkey").select("l_orderkey", F.sha2(F.concat_ws("\n\n", "body", "foot"), 256).alias("page"))


@query("footnote_numbers", "SELECT l_orderkey, l_partkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY first_line, l_partkey) AS note FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1, 2)")
def footnote_numbers(spark: SparkSession, d: str) -> DataFrame:
    firsts = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("first_line"))
    return firsts.select("l_orderkey", "l_partkey", F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("first_line", "l_partkey")).alias("note"))
