"""Flashcard decks as delimited text: directive lines, every field quoted, a byte-order mark for commas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import quoted

COLUMNS = ("Front", "Back", "Tags", "GUID", "Deck")
SEPARATORS = {"csv": ("Comma", ","), "tsv": ("Tab", "\t")}
MARK = "\ufeff"


def header(kind: str) -> list[str]:
    """The directive lines of a deck."""
    name, sign = SEPARATORS[kind]
    lines = [f"#separator:{name}", "#html:true", "#tags column:3", "#guid column:4", "#deck column:5", "#columns:" + sign.join(COLUMNS)]
    return [MARK + lines[0], *lines[1:]] if kind == "csv" else lines


def deck_lines(cards: DataFrame, kind: str = "csv") -> DataFrame:
    """deck_id, place, line of each deck's file. cards: deck_id, place (from 0), and front, back, tags, guid, deck."""
    head = header(kind)
    line = F.concat_ws(SEPARATORS[kind][1], *(quoted(F.col(c.lower())) for c in COLUMNS))
    rows = cards.select("deck_id", (F.col("place") + len(head)).cast("long").alias("place"), line.alias("line"))
    heads = cards.select("deck_id").distinct().select("deck_id", F.posexplode(F.array(*map(F.lit, head))).alias("place", "line"))
    return heads.select("deck_id", F.col("place").cast("long").alias("place"), "line").union(rows)


def write_decks(lines: DataFrame, folder: str) -> None:
    """A folder for each deck with its lines in order."""
    ordered = lines.repartition("deck_id").sortWithinPartitions("deck_id", "place")
    ordered.select("deck_id", F.col("line").alias("value")).write.partitionBy("deck_id").text(folder)
