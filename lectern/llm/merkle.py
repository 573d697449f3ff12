"""A Merkle manifest of a table of documents, as a trie over exact ranks.

A leaf's rank in its source comes from digit histograms of doc_id
(`radix.ranked`), so nothing is sorted as a whole. Ranks are written in base
FAN: at each level the nodes that differ in their last digit alone become one.
Nodes with one longest prefix are reduced first: LEVELS digits at a time, so a
task holds FAN^LEVELS nodes however large a source is, and a source of n leaves
takes log(n) / LEVELS shuffles. The way back down adds to each block of nodes
the steps from its own node to the root, one joined row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed, crc32_sql, dropped
from lectern.llm.radix import ranked

FAN, LEVELS = 3, 6
BLOCK = FAN**LEVELS
STEP = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that neighbouring fields can't be mistaken for each other."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(text: Column) -> Column:
    return digest(*map(field, map(F.col, ("doc_id", "source", "lang", "n_chars"))), field(text))


def packed(nodes: DataFrame) -> DataFrame:
    """group, block, n and the nodes of each block in order. nodes: group, at, digest, n (nodes of the group), any others."""
    item = F.struct("at", *(c for c in nodes.columns if c not in ("group", "at", "n")))
    block = F.expr(f"at div {BLOCK}").alias("block")
    return checkpointed(nodes.groupBy("group", block).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(item)).alias("items")))


def with_levels(blocks: DataFrame) -> DataFrame:
    """The digests of each block's nodes at every level (level_0 ... ); a level that a group doesn't have is the one before."""
    out = blocks.withColumn("level_0", F.col("items.digest"))
    for k in range(LEVELS):
        nodes = F.col(f"level_{k}")
        run = lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, F.lit(FAN)), ""), 256)  # noqa: B023, E731
        reduced = F.transform(F.sequence(F.lit(0), F.expr(f"cast((size(level_{k}) - 1) div {FAN} as int)")), run)
        out = out.withColumn(f"level_{k + 1}", F.when(F.col("n") > FAN**k, reduced).otherwise(nodes))
    return out


def tops(blocks: DataFrame) -> DataFrame:
    """The node that each block becomes."""
    above = F.expr(f"cast((n - 1) div {BLOCK} + 1 as long)")
    return with_levels(blocks).select("group", F.col("block").alias("at"), F.col(f"level_{LEVELS}")[0].alias("digest"), above.alias("n"))


def steps(at: Column) -> Column:
    """The siblings left and right of a node and of the nodes above it in its block, level by level."""
    made = []
    for k in range(LEVELS):
        place = F.floor(at / FAN**k).cast("int")
        in_run = place % FAN
        side = lambda start, size: F.array_join(F.slice(F.col(f"level_{k}"), start, size), "")  # noqa: B023, E731
        step = F.struct(side(place - in_run + 1, in_run).alias("left"), side(place + 2, F.lit(FAN - 1) - in_run).alias("right"))
        made.append(F.when(F.col("n") > FAN**k, step))
    return F.array_compact(F.array(*made)).cast(STEP)


def opened(blocks: DataFrame) -> DataFrame:
    """The nodes of blocks, each with its steps up to the root. blocks: group, block, n, items, above (steps from the block's node on), any others."""
    kept = [c for c in blocks.columns if c not in ("block", "n", "items", "above")]
    names = blocks.schema["items"].dataType.elementType.names
    node = lambda i: F.struct(*(F.col("items")[i][c].alias(c) for c in names), F.concat(steps(i), F.col("above")).alias("path"))
    nodes = F.transform(F.sequence(F.lit(0), F.size("items") - 1), node)
    return with_levels(blocks).select(*kept, F.inline(nodes))


class Trie:
    """The blocks of all levels of the trees of some groups, and their roots. nodes as for `packed`."""

    def __init__(self, nodes: DataFrame) -> None:
        self.tables = [packed(nodes)]
        while (self.tables[-1].agg(F.max("n").alias("n")).first()["n"] or 0) > BLOCK:
            self.tables.append(packed(tops(self.tables[-1])))
        self.roots = tops(self.tables[-1]).select("group", "digest")

    def paths(self, above: DataFrame) -> DataFrame:
        """The nodes with their steps up; above (group, above, any others) has the steps that follow each group's root."""
        blocks = self.tables[-1].join(above, "group")
        for table in reversed(self.tables[:-1]):
            kept = [c for c in above.columns if c not in ("group", "above")]
            higher = opened(blocks).select("group", F.col("at").alias("block"), F.col("path").alias("above"), *kept)
            blocks = table.join(higher, ["group", "block"])
        return opened(blocks)


def in_order(parts: DataFrame, key: str) -> DataFrame:
    """Rows with at, the place of each by its unique key, and n. A `part` of the rows has a range of keys; parts are sorted by themselves and added up."""
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per part
    sizes = parts.groupBy("part").agg(F.count("*").alias("size")).withColumns({"start": before, "n": F.sum("size").over(Window.partitionBy())})
    place = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return parts.withColumn("place", place).join(sizes, "part").withColumn("at", F.col("start") + F.col("place")).drop("part", "place", "start", "size")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of docs (doc_id, source, lang, n_chars, text; others don't count).

    Null fields count as such in a leaf, and an empty text has length 0. Rows
    without a source are a source of their own, the first one; rows without an id come first in theirs
    and aren't tampered with. Repeated ids are ordered by leaf; equal rows are leaves of their own. An empty table has no rows.
    """
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = F.when(hit, leaf(F.translate("text", "\n", ""))).otherwise(leaf(F.col("text")))
    # the empty name stands for null: names begin with a blank, so that order stays that of their bytes
    name = F.coalesce(F.concat(F.lit(" "), "source"), F.lit(""))
    leaves = ranked(docs.select(name.alias("group"), "doc_id", leaf(F.col("text")).alias("digest"), tampered.alias("tampered")), "group", "doc_id", "digest")
    sizes = leaves.groupBy("group").agg(F.count("*").alias("n"))
    trees = Trie(leaves.withColumnRenamed("rank", "at").join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "group"))
    dropped(leaves)
    parts = checkpointed(trees.roots.repartitionByRange("group").withColumn("part", F.spark_partition_id()))
    names = in_order(parts, "group").select(F.lit("").alias("group"), "at", "n", F.col("group").alias("name"), "digest")
    top = Trie(names)
    sources = top.paths(top.roots.select("group", F.array().cast(STEP).alias("above"), F.col("digest").alias("root")))
    sources = sources.select(F.col("name").alias("group"), F.col("path").alias("above"), F.col("digest").alias("subroot"), "root")
    nodes = trees.paths(sources)
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    folded = F.aggregate("path", F.col("tampered"), lambda below, s: digest(s["left"], below, s["right"]))
    out = nodes.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    done = checkpointed(out.withColumn("verified", F.col("folded_root") == F.col("root")))
    dropped(parts, *trees.tables, *top.tables)
    return done


def _oracle() -> str:
    said = lambda c: f"coalesce(octet_length(encode(({c})::VARCHAR)) || ':' || ({c})::VARCHAR, '-')"
    own, cut = ("sha256(" + " || ".join(map(said, ("doc_id", "source", "lang", "n_chars", t))) + ")" for t in ("text", "replace(text, chr(10), '')"))
    return f"""WITH RECURSIVE d AS (SELECT doc_id, source, {own} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc32_sql('(doc_id::VARCHAR)')} % 2 = 0 THEN {cut} ELSE {own} END AS tampered FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
-- nodes of each level of the sources' trees
t AS (SELECT source, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM l GROUP BY 1
UNION ALL SELECT source, level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], ''))) FROM t WHERE len(nodes) > 1),
subroots AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM t WHERE len(nodes) = 1),
u AS (SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM subroots UNION ALL SELECT level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], ''))) FROM u WHERE len(nodes) > 1),
trees AS (SELECT source, list(nodes ORDER BY level) FILTER (len(nodes) > 1) AS levels FROM t GROUP BY 1), top AS (SELECT list(nodes ORDER BY level) FILTER (len(nodes) > 1) AS levels, max(nodes[1]) FILTER (len(nodes) = 1) AS root FROM u),
steps AS (SELECT l.*, subroot, root, list_transform(range(coalesce(len(trees.levels), 0)), lambda k: {{'level': trees.levels[k + 1], 'pos': l.pos // pow(3, k)::BIGINT}}) || list_transform(range(coalesce(len(top.levels), 0)), lambda k: {{'level': top.levels[k + 1], 'pos': s.pos // pow(3, k)::BIGINT}}) AS steps
  FROM l JOIN trees ON trees.source IS NOT DISTINCT FROM l.source JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source, top),
sided AS (SELECT *, list_transform(steps, lambda x: array_to_string(x.level[x.pos - x.pos % 3 + 1:x.pos], '')) AS lefts, list_transform(steps, lambda x: array_to_string(x.level[x.pos + 2:x.pos - x.pos % 3 + 3], '')) AS rights FROM steps),
-- the tampered leaf is folded up one step after the other
f AS (SELECT doc_id, leaf, subroot, root, lefts, rights, tampered AS folded, 0 AS k FROM sided UNION ALL SELECT doc_id, leaf, subroot, root, lefts, rights, sha256(lefts[k + 1] || folded || rights[k + 1]), k + 1 FROM f WHERE k < len(lefts))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(range(len(lefts)), lambda k: lefts[k + 1] || rights[k + 1]), '')) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM f WHERE k = len(lefts)"""


#: The trees as lists of nodes, level by level.
ORACLE = _oracle()
