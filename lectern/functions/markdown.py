"""Lines, sections and blocks of Markdown texts as column expressions.

Each line has a letter, as in `structure.labels`. What a line is outside of a
fence depends on itself alone. The lines that may open or close a fence are few: one pass
over them gives the fences, and a text's letters are put together from what lies outside, and in them.
Blocks are then runs of letters, found by one pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.structure import NO_HEADINGS, PREFACE

#: A blank as the text functions see it.
SPACE = r"[\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
EDGE = r"^ {0,3}(`{3,}|~{3,})"
HEADING = rf"(?s)^ {{0,3}}#{{1,6}}{SPACE}+(.*)$"
DELIMITER = rf"(?s)^(?=.*\|){SPACE}*\|*{SPACE}*:?-{{3,}}:?{SPACE}*(\|{SPACE}*:?-{{3,}}:?{SPACE}*)*\|*{SPACE}*$"
ROW = rf"(?s)^(?=.*\|).*[^|{SPACE[1:-1]}]"
#: A fence to its end, a header row over a delimiter row and the rows below, a paragraph up to a blank line or the next of these, or a blank line.
BLOCK = r"of*c?|[rd]d[rd]*|(?:(?![rd]d)[rdhp])+|b"
#: Fences are gathered in lists of so many. What is gathered is still copied for each edge, so a text of very many fences takes work with their square.
LIST = 256
FENCE = "struct<first:int,last:int>"


def fences(lines: Column) -> Column:
    """array<struct<first, last>>: the lines from 0 on in which fences open and close; an open one ends after the last line."""
    numbered = F.transform(lines, lambda said, at: F.struct(at.alias("at"), F.regexp_extract(said, EDGE, 1).alias("mark"), said.rlike(rf"{EDGE}{SPACE}*$").alias("bare")))
    edges = F.filter(numbered, lambda x: x["mark"] != "")
    none = F.array().cast(f"array<{FENCE}>")
    start = F.struct(F.lit("").alias("mark"), F.lit(0).alias("first"), F.array().cast(f"array<array<{FENCE}>>").alias("full"), none.alias("last"))

    def step(s: Column, x: Column) -> Column:
        inside = s["mark"] != ""
        closes = inside & x["bare"] & (F.substring(x["mark"], 1, 1) == F.substring(s["mark"], 1, 1)) & (F.length(x["mark"]) >= F.length(s["mark"]))
        crowded = F.size(s["last"]) >= LIST
        made = F.array(F.struct(s["first"].alias("first"), x["at"].alias("last")))
        return F.struct(
            F.when(closes, "").when(inside, s["mark"]).otherwise(x["mark"]).alias("mark"),
            F.when(inside, s["first"]).otherwise(x["at"]).alias("first"),
            F.when(closes & crowded, F.array_append(s["full"], s["last"])).otherwise(s["full"]).alias("full"),
            F.when(~closes, s["last"]).when(crowded, made).otherwise(F.concat(s["last"], made)).alias("last"),
        )

    def finish(s: Column) -> Column:
        rest = F.when(s["mark"] != "", F.array(F.struct(s["first"].alias("first"), F.size(lines).alias("last")))).otherwise(none)
        return F.concat(F.flatten(s["full"]), s["last"], rest)

    return F.aggregate(edges, start, step, finish)


def _outside(said: Column) -> Column:
    kind = F.when(~said.rlike(rf"(?s)^{SPACE}*$"), "p").otherwise("b")
    row = F.when(said.rlike(ROW), F.when(said.rlike(DELIMITER), "d").otherwise("r")).otherwise(kind)
    return F.when(said.rlike(HEADING), "h").otherwise(row)


def labelled(texts: DataFrame, text: str) -> DataFrame:
    """texts with lines (array) and labels (a letter for each)."""
    rows = texts.withColumn("lines", F.split(text, "\n", -1)).withColumns({"fences_": fences(F.col("lines")), "plain_": F.array_join(F.transform("lines", _outside), "")})
    size = F.size("lines")

    def part(fence: Column, at: Column) -> Column:
        before = F.when(at == 0, F.lit(-1)).otherwise(F.get(F.col("fences_"), at - 1)["last"])
        inside = F.repeat(F.lit("f"), F.least(fence["last"], size) - fence["first"] - 1)
        return F.concat(F.substring(F.col("plain_"), before + 2, fence["first"] - before - 1), F.lit("o"), inside, F.when(fence["last"] < size, "c").otherwise(""))

    end = F.coalesce(F.get(F.col("fences_"), F.size("fences_") - 1)["last"], F.lit(-1))
    parts = F.array_join(F.transform("fences_", part), "")
    return rows.withColumn("labels", F.concat(parts, F.substring(F.col("plain_"), end + 2, F.greatest(size - end - 1, F.lit(0))))).drop("fences_", "plain_")


def sections(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, title, line_start, line_end of each section; what stands before the first heading, if it isn't blank, is one, as is a text without headings. Null texts have none."""
    rows = labelled(texts.where(F.col(text).isNotNull()).select(key, text), text)
    heads = F.filter(F.transform("lines", lambda said, at: F.struct((at + 1).alias("line"), F.trim(F.regexp_replace(F.regexp_extract(said, HEADING, 1), rf"^{SPACE}+|{SPACE}+$", "")).alias("title"), (F.substring(F.col("labels"), at + 1, F.lit(1)) == "h").alias("head"))), lambda x: x["head"])
    first = lambda title: F.array(F.struct(F.lit(1).alias("line"), F.lit(title).alias("title"), F.lit(False).alias("head")))
    before = F.regexp_extract("labels", "^[^h]*", 0)
    every = F.when(F.size("heads") == 0, first(NO_HEADINGS)).when(before.rlike("[^b]"), F.concat(first(PREFACE), F.col("heads"))).otherwise(F.col("heads"))
    told = rows.withColumn("heads", heads).withColumn("heads", every).withColumn("size", F.size("lines")).drop("lines", "labels", text)
    ends = F.transform("heads", lambda x, at: F.struct(x["title"].alias("title"), x["line"].alias("line_start"), F.coalesce(F.get(F.col("heads"), at + 1)["line"] - 1, F.col("size")).alias("line_end")))
    return told.select(key, F.inline(ends))


def blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind (fence, table, paragraph), line_start, line_end of the blocks of each text; keys are unique. Null texts have none."""
    rows = labelled(texts.where(F.col(text).isNotNull()).select(key, text), text)
    runs = rows.select(key, F.posexplode(F.regexp_extract_all("labels", F.lit(BLOCK), F.lit(0))).alias("at", "run"))
    until = F.sum(F.length("run")).over(Window.partitionBy(key).orderBy("at")).cast("int")
    kind = F.when(F.col("run").startswith("o"), "fence").when(F.col("run").rlike("^[rd]d"), "table").otherwise("paragraph")
    placed = runs.withColumn("line_end", until).where("run <> 'b'")
    return placed.select(key, kind.alias("kind"), (F.col("line_end") - F.length("run") + 1).cast("int").alias("line_start"), "line_end")
