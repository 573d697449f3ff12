"""Structural text and content queries over Markdown, quizzes and drawings made from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import markdown as md
from lectern.functions import structure, table_functions
from lectern.functions import text as t
from lectern.operators import trees
from lectern.operators.batches import batched
from lectern.plans.base import CATALOG
from lectern.session import spread, table

query = CATALOG.query


# one Markdown text for each conversation: plain text, fences with headings inside, tables and headings take turns
MARKDOWN_SQL = """md AS (SELECT conv_id, string_agg(CASE turn % 4 WHEN 3 THEN '## ' || role || E'\\n' || text WHEN 1 THEN E'```\\n# ' || text || E'\\n```'
  WHEN 2 THEN text || E'\\n| role | n |\\n|---|:---:|\\n| ' || role || ' | ' || turn || ' |' ELSE text END, E'\\n\\n' ORDER BY turn) AS text FROM conversations GROUP BY 1),
raw AS (SELECT conv_id, unnest(string_split(text, E'\\n')) AS said, generate_subscripts(string_split(text, E'\\n'), 1) AS line FROM md),
marked AS (SELECT *, starts_with(said, '```') AS edge, sum(starts_with(said, '```')::INT) OVER (PARTITION BY conv_id ORDER BY line) AS fences FROM raw),
l AS (SELECT *, edge OR fences % 2 = 1 AS inside, NOT edge AND fences % 2 = 0 AND regexp_full_match(said, ' {0,3}#{1,6}\\s+.*') AS heading FROM marked)"""


def markdown(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("turn") % 4
    part = (
        F.when(turn == 3, F.concat(F.lit("## "), "role", F.lit("\n"), "text"))
        .when(turn == 1, F.concat(F.lit("```\n# "), "text", F.lit("\n```")))
        .when(turn == 2, F.concat("text", F.lit("\n| role | n |\n|---|:---:|\n| "), "role", F.lit(" | "), F.col("turn").cast("string"), F.lit(" |")))
        .otherwise(F.col("text"))
    )
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("turns"))
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda x: x["part"]), "\n\n").alias("text"))


SECTIONS_SQL = f"""WITH {MARKDOWN_SQL}, h AS (SELECT conv_id, trim(regexp_extract(said, '#\\s+(.*)$', 1)) AS title, line FROM l WHERE heading),
size AS (SELECT conv_id, max(line) AS lines FROM l GROUP BY 1), f AS (SELECT conv_id, min(line) AS first FROM h GROUP BY 1),
starts AS (SELECT * FROM h UNION ALL SELECT DISTINCT l.conv_id, '(introducción)', 1 FROM l JOIN f ON f.conv_id = l.conv_id AND l.line < f.first WHERE trim(said) <> ''
  UNION ALL SELECT conv_id, '(sin encabezados)', 1 FROM size WHERE conv_id NOT IN (SELECT conv_id FROM f))
SELECT conv_id, title, line::INT AS line_start, coalesce(lead(line) OVER (PARTITION BY conv_id ORDER BY line) - 1, lines)::INT AS line_end FROM starts JOIN size USING (conv_id)"""


@query("markdown_sections", SECTIONS_SQL)
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return md.sections(markdown(spark, d), "conv_id", "text")


@query(
    "text_blocks",
    f"""WITH {MARKDOWN_SQL}, k AS (SELECT *, NOT inside AND contains(said, '|') AND trim(replace(said, '|', ' ')) <> '' AS is_row FROM l),
starts AS (SELECT *, is_row AND coalesce(regexp_full_match(lead(said) OVER w, '\\|?[-:| ]*-{{3,}}[-:| ]*\\|?') AND contains(lead(said) OVER w, '|'), false) AS top, sum((NOT is_row)::INT) OVER w AS island FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY line)),
cls AS (SELECT *, CASE WHEN inside THEN 'fence' WHEN trim(said) = '' THEN '' WHEN is_row AND bool_or(top) OVER (PARTITION BY conv_id, island, is_row ORDER BY line) THEN 'table' ELSE 'paragraph' END AS kind FROM starts),
fresh AS (SELECT *, (kind <> lag(kind, 1, '?') OVER w OR edge AND fences % 2 = 1)::INT AS new FROM cls WINDOW w AS (PARTITION BY conv_id ORDER BY line)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY line) AS block FROM fresh)
SELECT conv_id, kind, min(line)::INT AS line_start, max(line)::INT AS line_end FROM numbered WHERE kind <> '' GROUP BY conv_id, block, kind""",
)
def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    return md.blocks(markdown(spark, d), "conv_id", "text")


@query("lateral_sections", SECTIONS_SQL)
def lateral_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections by the table function that SQL calls."""
    table_functions.register(spark)
    return spark.sql("SELECT m.conv_id, s.* FROM {md} m, LATERAL sections(m.text) s", md=markdown(spark, d))


@query(
    "table_rows",
    rf"""WITH {MARKDOWN_SQL} SELECT conv_id, line::INT AS line, said LIKE '%|%' AND trim(trim(said), '|') <> '' AS is_row, regexp_full_match(trim(trim(said), '|'), '\s*:?-{{3,}}:?\s*(\|\s*:?-{{3,}}:?\s*)*') AS is_delimiter FROM raw""",
)
def table_rows(spark: SparkSession, d: str) -> DataFrame:
    """Which lines of a Markdown text are rows of a table, and which its delimiter."""
    lines = markdown(spark, d).select("conv_id", F.posexplode(F.split("text", "\n")).alias("at", "said"))
    bare = F.regexp_replace(F.trim("said"), r"^\|+|\|+$", "")
    return lines.select("conv_id", (F.col("at") + 1).alias("line"), (F.col("said").contains("|") & (bare != "")).alias("is_row"), bare.rlike(r"^\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*$").alias("is_delimiter"))


@query(
    "logical_cut",
    """WITH d AS (SELECT doc_id, text, (length(text) // 2)::INT AS upto FROM documents),
parts AS (SELECT *, unnest(regexp_extract_all(substr(text, 1, upto), '\\S*\\s+')) AS said, generate_subscripts(regexp_extract_all(substr(text, 1, upto), '\\S*\\s+'), 1) AS pos FROM d),
placed AS (SELECT *, sum(length(said)) OVER (PARTITION BY doc_id ORDER BY pos) AS done, regexp_extract(said, '^\\S*') AS word FROM parts),
gaps AS (SELECT doc_id, done, word, substr(said, length(word) + 1) AS space, regexp_extract(substr(text, done::INT + 1, 300), '^\\s*(\\S*)', 1) AS following FROM placed),
worth AS (SELECT doc_id, CASE WHEN contains(space, E'\\n\\n') THEN 3 WHEN contains(space, E'\\n') THEN 2 WHEN regexp_matches(word, '[.!?;]$') THEN 1 ELSE 0 END AS worth,
  done - CASE WHEN contains(space, E'\\n') THEN position(CASE WHEN contains(space, E'\\n\\n') THEN E'\\n\\n' ELSE E'\\n' END IN reverse(space)) - 1 ELSE 0 END AS cut
  FROM gaps WHERE lower(word) NOT IN ('no', 'not', 'não', 'sin', 'excepto') AND following NOT IN ('ms', 's', 'MB', 'GB', 'KB', '%', 'kg'))
SELECT doc_id, coalesce(cut, CASE WHEN upto >= length(text) THEN length(text) ELSE upto END)::INT AS cut FROM d LEFT JOIN (SELECT doc_id, max({'worth': worth, 'cut': cut}).cut AS cut FROM worth GROUP BY 1) USING (doc_id)""",
)
def logical_cut(spark: SparkSession, d: str) -> DataFrame:
    """Where each document would be cut in about half."""
    cut = batched(structure.logical_cut, "int", F.col("text"), F.expr("cast(length(text) div 2 as int)"))
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", cut.alias("cut"))


@query("repair_text", "SELECT doc_id, sha256(text) AS content FROM documents")
def repair_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose accented letters were written as entities and codes are those texts again."""
    damaged = F.col("text")
    for pattern, form in (("é", "&eacute;"), ("ü", "&#252;"), ("è", "&egrave"), ("ß", "&#xDF;"), ("ç", "&ccedil;"), ("(?<=[a-z])ä(?=[a-z])", "%e4"), ("(?<=[a-z])ö", r"\\u00f6"), ("(?<=[b-z]ci)ó(?=n[ .,])", "3")):
        damaged = F.regexp_replace(damaged, pattern, form)
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.sha2(batched(structure.repair, "string", damaged), 256).alias("content"))


JSON_SQL = """SELECT event_id, CASE event_id % 4 WHEN 1 THEN replace(props, '}', ', "k": ' || event_id || '}') WHEN 2 THEN regexp_replace(props, '[0-9]+', 'NaN') WHEN 3 THEN substr(props, 1, length(props) - 1) ELSE props END AS raw FROM events"""


@query(
    "strict_json",
    f"""WITH e AS ({JSON_SQL}), k AS (SELECT *, regexp_extract_all(raw, '"([^"]*)"\\s*:', 1) AS keys FROM e)
SELECT event_id, CASE WHEN NOT json_valid(replace(raw, 'NaN', '0')) THEN 'syntax' WHEN len(list_distinct(keys)) < len(keys) THEN 'duplicate key' WHEN contains(raw, 'NaN') THEN 'not finite' ELSE 'ok' END AS verdict FROM k""",
)
def strict_json(spark: SparkSession, d: str) -> DataFrame:
    kind, props = F.col("event_id") % 4, F.col("props")
    twice = F.replace(props, F.lit("}"), F.concat(F.lit(', "k": '), F.col("event_id").cast("string"), F.lit("}")))
    raw = F.when(kind == 1, twice).when(kind == 2, F.regexp_replace(props, "[0-9]+", "NaN")).when(kind == 3, F.expr("substring(props, 1, length(props) - 1)")).otherwise(props)
    return table(spark, d, "events").select("event_id", batched(structure.strict_json, "string", raw).alias("verdict"))


# a quiz for each conversation, a question for each turn: some lack options, repeat an option's id or have a key that is no option
QUIZ_SQL = """q AS (SELECT conv_id, turn, 'q' || turn AS id, text, CASE WHEN turn % 7 = 6 THEN 'z' ELSE chr(97 + (turn % 3)::INT) END AS key, role AS why,
  list_transform(range(CASE WHEN turn % 5 = 4 THEN 2 ELSE 4 END), lambda i: {'id': chr(97 + (CASE WHEN i = 1 AND turn % 6 = 5 THEN 0 ELSE i END)::INT), 'text': role || ' ' || i}) AS options FROM conversations)"""


def quizzes(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("turn") % 5 == 4, 2).otherwise(4)
    letter = lambda n: F.char(F.lit(97) + n)
    option = lambda i: F.struct(letter(F.when((i == 1) & (F.col("turn") % 6 == 5), 0).otherwise(i)).alias("id"), F.concat_ws(" ", "role", i.cast("string")).alias("text"))
    item = F.struct(
        F.concat(F.lit("q"), "turn").alias("id"), "text", F.when(F.col("turn") % 7 == 6, "z").otherwise(letter(F.col("turn") % 3)).alias("key"), F.col("role").alias("why"),
        F.transform(F.sequence(F.lit(0), size - 1), option).alias("options"),
    )
    asked = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("item")))).alias("turns"))
    return asked.select("conv_id", F.transform("turns", lambda x: x["item"]).alias("items"))


@query("quiz_student_view", f"""WITH {QUIZ_SQL} SELECT conv_id, '[' || string_agg('{{"id":"' || id || '","text":' || to_json(text) || ',"options":' || len(options) || '}}', ',' ORDER BY turn) || ']' AS items FROM q GROUP BY 1""")
def quiz_student_view(spark: SparkSession, d: str) -> DataFrame:
    """Questions without key and reason."""
    shown = F.transform("items", lambda q: q.dropFields("key", "why").withField("options", F.size(q["options"])))
    return quizzes(spark, d).select("conv_id", F.to_json(shown).alias("items"))


@query(
    "quiz_violations",
    f"""WITH {QUIZ_SQL}, i AS (SELECT *, list_transform(options, lambda o: o.id) AS ids FROM q)
SELECT conv_id, id AS item, concat_ws(',', CASE WHEN len(ids) <> 4 THEN 'count' END, CASE WHEN len(list_distinct(ids)) < len(ids) THEN 'ids' END, CASE WHEN NOT list_contains(ids, key) THEN 'key' END) AS violations FROM i""",
)
def quiz_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = quizzes(spark, d).select("conv_id", F.explode("items").alias("q"))
    ids = F.transform("q.options", lambda o: o["id"])
    codes = F.array(F.when(F.size(ids) != 4, "count"), F.when(F.size(F.array_distinct(ids)) < F.size(ids), "ids"), F.when(~F.array_contains(ids, F.col("q.key")), "key"))
    return rows.select("conv_id", F.col("q.id").alias("item"), F.array_join(F.array_compact(codes), ",").alias("violations"))


@query(
    "content_segments",
    f"""WITH {QUIZ_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM q), o AS (SELECT conv_id, i, key, unnest(options) AS option, generate_subscripts(options, 1) - 1 AS j FROM n)
SELECT conv_id, '/items/' || i || '/text' AS path, text AS said FROM n UNION ALL SELECT conv_id, '/items/' || i || '/options/' || j || '/text', option.text FROM o WHERE option.id = key""",
)
def content_segments(spark: SparkSession, d: str) -> DataFrame:
    """Texts of a content tree with their paths; wrong options don't count."""
    items = quizzes(spark, d).select("conv_id", F.posexplode("items").alias("i", "q"))
    item = items.select("conv_id", F.concat(F.lit("/items/"), "i", F.lit("/text")).alias("path"), F.col("q.text").alias("said"))
    options = items.select("conv_id", "i", F.col("q.key").alias("key"), F.posexplode("q.options").alias("o", "option")).where("option.id = key")
    return item.union(options.select("conv_id", F.concat(F.lit("/items/"), "i", F.lit("/options/"), "o", F.lit("/text")), "option.text"))


# each conversation as a content tree below 0 to 30 more levels: a question for each turn, with citations of its own, of its level, or none
CONTENT_SQL = """c AS (SELECT conv_id, '{"tipo":"quiz","titulo":"' || conv_id || '",' || CASE WHEN conv_id % 3 = 0 THEN '"referencias":[{"chunk_id":"c' || conv_id || '"}],' ELSE '' END || '"a/b~c":[' || string_agg('{"id":"q' || turn || '","pregunta":' || to_json(text) ||
  CASE WHEN turn % 2 = 0 THEN ',"referencias":[{"chunk_id":"t' || turn || '"},{"chunk_id":"u"}]' ELSE '' END || ',"correct_option_id":"' || (turn % 3) || '","opciones":[' || '{"option_id":"0","texto":"' || role || ' 0"},{"option_id":"1","texto":"' || role || ' 1"},{"option_id":"2","texto":" "}' || ']}', ',' ORDER BY turn) || ']}' AS body FROM conversations GROUP BY 1),
wrapped AS (SELECT conv_id, repeat('{"nivel":[7,', (conv_id % 31)::INT) || body || repeat(']}', (conv_id % 31)::INT) AS content FROM c)"""


def contents(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("turn").cast("string")
    cited = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(',"referencias":[{"chunk_id":"t'), turn, F.lit('"},{"chunk_id":"u"}]'))).otherwise("")
    said = F.expr("substring(to_json(named_struct('t', text)), 6, length(to_json(named_struct('t', text))) - 6)")
    option = lambda n: F.concat(F.lit(f'{{"option_id":"{n}","texto":"'), "role", F.lit(f' {n}"}},'))
    options = F.concat(F.lit(',"correct_option_id":"'), (F.col("turn") % 3).cast("string"), F.lit('","opciones":['), option(0), option(1), F.lit('{"option_id":"2","texto":" "}]}'))
    asked = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit('{"id":"q'), turn, F.lit('","pregunta":'), said, cited, options).alias("item")))).alias("turns"))
    conv = F.col("conv_id").cast("string")
    level = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit('"referencias":[{"chunk_id":"c'), conv, F.lit('"}],'))).otherwise("")
    body = F.concat(F.lit('{"tipo":"quiz","titulo":"'), conv, F.lit('",'), level, F.lit('"a/b~c":['), F.array_join(F.transform("turns", lambda t: t["item"]), ","), F.lit("]}"))
    deep = (F.col("conv_id") % 31).cast("int")
    whole = F.concat(F.repeat(F.lit('{"nivel":[7,'), deep), body, F.repeat(F.lit("]}"), deep))
    return asked.select("conv_id", F.parse_json(whole).alias("content"), F.array(F.lit("all")).alias("cites"))


@query(
    "deep_segments",
    f"""WITH RECURSIVE {CONTENT_SQL}, w AS (SELECT conv_id, '' AS path, content::JSON AS value, ['all'] AS cites, NULL::VARCHAR AS pick FROM wrapped
UNION ALL SELECT conv_id, path || '/' || replace(replace(k, '~', '~0'), '/', '~1'), v, CASE WHEN len(own) > 0 THEN own ELSE cites END, CASE WHEN k = 'opciones' THEN value->>'$.correct_option_id' END FROM (
  SELECT *, unnest(ks) AS k, unnest(CASE WHEN kind = 'OBJECT' THEN list_transform(ks, lambda n: json_extract(value, '/' || replace(replace(n, '~', '~0'), '/', '~1'))) ELSE json_extract(value, '$[*]') END) AS v FROM (
    SELECT *, json_extract_string(value, '$.referencias[*].chunk_id') AS own, json_type(value) AS kind, CASE WHEN json_type(value) = 'OBJECT' THEN json_keys(value) ELSE list_transform(range(json_array_length(value)::BIGINT), lambda n: n::VARCHAR) END AS ks FROM w WHERE json_type(value) IN ('OBJECT', 'ARRAY')))
WHERE (kind = 'ARRAY' OR k NOT IN ('referencias', 'tipo', 'id', 'option_id', 'correct_option_id')) AND (pick IS NULL OR v->>'$.option_id' = pick))
SELECT conv_id, path, value->>'$' AS said, array_to_string(cites, ',') AS cites FROM w WHERE json_type(value) = 'VARCHAR' AND trim(value->>'$') <> ''""",
)
def deep_segments(spark: SparkSession, d: str) -> DataFrame:
    """Texts of content trees of any depth with their JSON pointers and the citations they have or inherit; keys without facts and wrong options don't count."""
    return trees.segments(contents(spark, d), "conv_id").withColumn("cites", F.array_join("cites", ","))


# a page for each order, a drawing operator for each of its lines
DRAWN_SQL = """ops AS (SELECT l_orderkey AS page, CASE WHEN l_suppkey % 40 = 0 THEN 'Do' ELSE ['m', 'l', 're', 're', 'S', 'f', 're', 'n', 'l', 're'][(l_suppkey % 10 + 1)::INT] END AS op, l_quantity AS x, floor(l_extendedprice / 20000) AS y,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem),
paths AS (SELECT *, coalesce(sum((op IN ('S', 'f', 'n'))::INT) OVER (PARTITION BY page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS path FROM ops),
points AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM paths WHERE op IN ('m', 'l') WINDOW w AS (PARTITION BY page, path ORDER BY pos)),
rects AS (SELECT page, sum(n) AS n FROM (SELECT page, path, count(*) FILTER (op = 're') AS n FROM paths GROUP BY 1, 2 HAVING bool_or(op = 'S')) GROUP BY 1)"""


def drawings(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in ("m", "l", "re", "re", "S", "f", "re", "n", "l", "re")))
    op = F.when(F.col("l_suppkey") % 40 == 0, "Do").otherwise(F.get(names, (F.col("l_suppkey") % 10).cast("int")))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.struct(op.alias("op"), F.col("l_quantity").alias("x"), F.floor(F.col("l_extendedprice") / 20000).cast("double").alias("y")).alias("op"))
    pages = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return pages.select("page", F.transform("lines", lambda x: x["op"]).alias("ops"))


@query(
    "visual_pages",
    f"""WITH {DRAWN_SQL} SELECT DISTINCT page, page IN (SELECT page FROM ops WHERE op = 'Do') OR page IN (SELECT page FROM points WHERE op = 'l' AND abs(x - x0) > 0.1 AND abs(y - y0) > 0.1)
OR page IN (SELECT page FROM rects WHERE n >= 3) AS visual FROM ops""",
)
def visual_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with an image, a curve, a diagonal, or three stroked rectangles."""
    return drawings(spark, d).select("page", t.drawn(F.col("ops")).alias("visual"))


@query(
    "mask_ranges",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND length(text) > 1 OR length(text) < 30 THEN NULL ELSE sha256(repeat(' ', 5) || substr(text, 6, 10) || repeat(' ', 10) || substr(text, 26)) END AS masked FROM documents""",
)
def mask_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Two ranges of each text blanked out; null where they overlap or the text is shorter."""
    one = lambda s, e: F.struct(F.lit(s).alias("s"), F.lit(e).alias("e"))
    ranges = F.when(F.col("doc_id") % 5 == 0, F.array(one(0, 5), one(4, 25))).otherwise(F.array(one(0, 5), one(15, 25)))
    beyond = F.when(F.length("text") < 30, F.array(one(0, 5), one(15, 31))).otherwise(ranges)
    return table(spark, d, "documents").select("doc_id", F.sha2(t.masked(F.col("text"), beyond), 256).alias("masked"))


@query("blind_review", "SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 12) AS case_code, lang, n_chars FROM documents JOIN labels USING (doc_id)")
def blind_review(spark: SparkSession, d: str) -> DataFrame:
    """What a reviewer may see: no label, no source."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id")
    return rows.select("doc_id", F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 12).alias("case_code"), "lang", "n_chars")


@query("visual_chunks", "SELECT page_id, 'vis_' || substr(sha256(url || '#' || page_id), 1, 24) AS chunk_id, CASE WHEN page_id % 4 = 0 THEN 'Ambiguous: ' ELSE '' END || url || ' Limitations: none' AS text FROM pages")
def visual_chunks(spark: SparkSession, d: str) -> DataFrame:
    lead = F.when(F.col("page_id") % 4 == 0, "Ambiguous: ").otherwise("")
    chunk = F.concat(F.lit("vis_"), F.substring(F.sha2(F.concat_ws("#", "url", "page_id"), 256), 1, 24))
    return table(spark, d, "pages").select("page_id", chunk.alias("chunk_id"), F.concat(lead, F.col("url"), F.lit(" Limitations: none")).alias("text"))


@query("document_coverage", "SELECT source, sum(CASE WHEN n_chars >= 200 THEN 1 ELSE 0 END)::BIGINT AS processed, count(*) AS pages, sum(CASE WHEN n_chars >= 200 THEN 1 ELSE 0 END)::BIGINT || '/' || count(*) AS coverage FROM documents GROUP BY 1")
def document_coverage(spark: SparkSession, d: str) -> DataFrame:
    done = F.count_if(F.col("n_chars") >= 200)
    rows = table(spark, d, "documents").groupBy("source").agg(done.alias("processed"), F.count("*").alias("pages"))
    return rows.withColumn("coverage", F.format_string("%d/%d", "processed", "pages"))
