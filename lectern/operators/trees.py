"""Trees of any depth: what is left when nodes go with all below them, and the texts of a content tree with their places.

Both go on in rounds over rows, with a table for each, so no tree is held in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import parts_for, rounds


def surviving(nodes: DataFrame, tree: str, node: str, parent: str, dead: str, parts: int | None = None) -> tuple[DataFrame, int]:
    """tree, node of the nodes that are left when each dead one goes with all that hangs on it, and how many rounds that took.

    Pointer jumping: in each round a node learns what its ancestor knows and looks twice as far up, so a
    depth of n takes log2(n) rounds, in whatever order the rows are. A parent that isn't there counts as
    none. Nodes on a cycle hang on no root: they go. Of repeated rows of a node one dead one is enough.
    Only nodes that still look up are joined. parts: partitions of each step, else by the number of nodes.
    """
    spark = nodes.sparkSession
    parts = parts or parts_for(spark, nodes.count())
    start = nodes.repartition(parts, tree, node).groupBy(F.col(tree).alias("tree"), F.col(node).alias("node")).agg(F.max(parent).alias("up"), F.max(F.coalesce(dead, F.lit(False))).alias("dead"))
    done = 0
    with rounds(spark) as kept:
        rows = kept(start)
        size = rows.count()
        looks_up = F.col("up").isNotNull() & ~F.col("dead")
        while not rows.where(looks_up).isEmpty() and 2**done <= 2 * size:
            above = rows.select("tree", F.col("node").alias("up"), F.col("up").alias("further"), F.col("dead").alias("above")).repartition(parts, "tree", "up")
            told = rows.where(looks_up).repartition(parts, "tree", "up").join(above, ["tree", "up"], "left")
            told = told.select("tree", "node", F.when(~F.coalesce("above", F.lit(False)), F.col("further")).alias("up"), F.coalesce("above", F.lit(False)).alias("dead"))
            rows = kept(rows.where(~looks_up).unionByName(told))
            done += 1
            kept.drop(but=1)
    left = rows.where("up is null and not dead").select(F.col("tree").alias(tree), F.col("node").alias(node))
    return left, done


# Keys of a content tree that hold no facts, and those that are left out besides for metadata.
NO_FACTS = ("tipo", "id", "option_id", "correct_option_id", "perfil_aplicado", "formato_generado", "nicho_sector", "nivel_detalle", "idioma_origen", "idioma_salida", "seccion_id", "secciones_cubiertas")
METADATA = ("metadatos", "titulo", "frente")
# Where a node's citations, a question's options and its key stand; and the part of a synthesis that inherits none.
CITES, CITED, OPTIONS, OPTION, KEY, SYNTHESIS = "referencias", "chunk_id", "opciones", "option_id", "correct_option_id", "/contenido_adaptado"


def pointer(key: Column) -> Column:
    """A key as a part of a JSON pointer."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def segments(contents: DataFrame, key: str, synthesis: bool = False, metadata: bool = True) -> DataFrame:
    """key, path, said, cites: the texts of each content (key, content: a variant, cites: what its texts cite unless a node says otherwise).

    A node's own citations hold for all below it. Keys without facts and wrong options are left out, as are blank
    texts; with `synthesis` the adapted content inherits no citations, without `metadata` titles and the like go, too. A null content has no texts.
    """
    skipped = [CITES, *NO_FACTS, *(() if metadata else METADATA)]
    start = contents.where("content is not null").select(F.col(key).alias("owner"), F.lit("").alias("path"), F.col("content").alias("value"), "cites", F.lit(None).cast("string").alias("only"))
    with rounds(contents.sparkSession) as kept:
        open_, texts = kept(start.withColumn("kind", kind())), []
        while True:
            texts.append(open_.where("kind = 'STRING'").select("owner", "path", F.expr("try_variant_get(value, '$', 'string')").alias("said"), "cites").where(r"said rlike '\\S'"))
            nodes = open_.where("kind in ('OBJECT', 'ARRAY<')")
            if nodes.isEmpty():
                break
            for _ in range(STEPS):
                nodes = _opened(nodes, skipped, synthesis)
            open_ = kept(nodes)
        found = texts[0]
        for more in texts[1:]:
            found = found.unionByName(more)
        result = kept(found.withColumnRenamed("owner", key))
    return result



#: Levels that a round opens.
STEPS = 8


def kind() -> Column:
    """What a variant is: the first letters of its type."""
    return F.substring(F.schema_of_variant("value"), 1, 6)


def _opened(rows: DataFrame, skipped: list[str], synthesis: bool) -> DataFrame:
    """Objects and arrays among the rows are replaced by what they hold; texts stay, other values go."""
    own = F.transform(F.expr(f"try_variant_get(value, '$.{CITES}', 'array<struct<{CITED}:string>>')"), lambda r: r[CITED])
    cites = F.when(F.size(own) > 0, own)
    if synthesis:
        cites = F.coalesce(cites, F.when(F.col("path") == SYNTHESIS, F.array().cast("array<string>")))
    is_object = F.col("kind") == "OBJECT"
    told = rows.where("kind in ('OBJECT', 'ARRAY<', 'STRING')").withColumns({
        "cites": F.coalesce(F.when(is_object, cites), F.col("cites")),
        "chosen": F.when(is_object, F.expr(f"try_variant_get(value, '$.{KEY}', 'string')")),
    })
    told.createOrReplaceTempView("lectern_tree_nodes")
    try:
        each = rows.sparkSession.sql("SELECT n.*, c.pos, c.key AS name, c.value AS child FROM lectern_tree_nodes n, LATERAL variant_explode_outer(n.value) c")
    finally:
        rows.sparkSession.catalog.dropTempView("lectern_tree_nodes")
    below = F.col("pos").isNotNull()
    wrong = below & F.col("only").isNotNull() & ~F.coalesce(F.expr(f"try_variant_get(child, '$.{OPTION}', 'string')") == F.col("only"), F.lit(False))
    good = each.where((below | (F.col("kind") == "STRING")) & (F.col("name").isNull() | ~F.col("name").isin(skipped)) & ~wrong)
    place = F.concat(F.lit("/"), F.coalesce(pointer(F.col("name")), F.col("pos").cast("string")))
    return good.select(
        "owner", F.concat("path", F.when(below, place).otherwise("")).alias("path"), F.when(below, F.col("child")).otherwise(F.col("value")).alias("value"),
        "cites", F.when(below & (F.col("name") == OPTIONS), F.col("chosen")).alias("only"),
    ).withColumn("kind", kind())
