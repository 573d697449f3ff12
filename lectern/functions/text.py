"""Text expressions: guards, normal forms, tokens, language, identifiers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.operators.batches import batched

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
CONTROL = r"[\x00-\x08\x0B\x0E-\x1F\x7F]"

# Frequent function words by which a text's language is told, and words that aren't terms.
STOP_WORDS = {
    "es": ["el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "con", "para", "por", "como", "se"],
    "en": ["the", "of", "and", "to", "in", "is", "a", "with", "for", "as", "that", "this", "are", "on"],
    "pt": ["de", "que", "e", "em", "um", "uma", "com", "para", "por", "como", "os", "as", "do", "da"],
}
NOISE = ["PDF", "TXT", "MD", "NOTA", "IMPORTANTE", "EL", "LA", "LOS", "LAS"]


def tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def normalized(text: Column) -> Column:
    """Without a leading byte-order mark, with one kind of line end."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n|\r|\f", "\n")


def identity(text: Column) -> Column:
    """Blanks collapsed to one space and trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\x0B\f]+", " "))


def language(text: Column) -> Column:
    """es, en or pt by the most stop words; ties in this order, es without any."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+"), F.lit(0))
    n = {k: _hits(words, v) for k, v in STOP_WORDS.items()}
    return F.when((n["es"] >= n["en"]) & (n["es"] >= n["pt"]), "es").when(n["en"] >= n["pt"], "en").otherwise("pt")


def _hits(words: Column, own: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*own)))


def language_tag(tag: Column) -> Column:
    low = F.lower(F.replace(F.trim(tag), F.lit("_"), F.lit("-")))
    return F.when(low == "mixto", low).otherwise(F.split(low, "-")[0])


def html_field(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, "\r\n|\r", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("[", "&#91;"), ("]", "&#93;"), ("\n", "<br>"), ("\t", "&#9;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit("<span>"), out, F.lit("</span>"))


def tag(text: Column) -> Column:
    """One tag; the text is in composed form already (`tags` sees to that)."""
    clean = F.regexp_replace(F.trim(text), r"[^\p{L}\p{N}_:.\-]", "_")
    return F.when(clean.startswith("-"), F.concat(F.lit("nm_"), clean)).otherwise(clean)


def tags(texts: Column) -> Column:
    """The distinct tags of an array of texts, in their order."""
    composed = batched(lambda values: [unicodedata.normalize("NFC", v) for v in values if v is not None], "array<string>", texts)
    return F.array_distinct(F.filter(F.transform(composed, tag), lambda x: x != ""))


# The characters that Markdown gives a meaning.
MARKDOWN_SIGNS = r"[\\`*_{}\[\]()#+.!|>~-]"


def markdown_text(text: Column, one_line: bool = False) -> Column:
    """Text that Markdown shows as it is: no markup, links or headings come from it."""
    out = F.regexp_replace(F.regexp_replace(text, "\r\n|\r", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    out = F.trim(F.regexp_replace(out, r"\s+", " ")) if one_line else out
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return F.regexp_replace(out, f"({MARKDOWN_SIGNS})", r"\\$1")


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def stable_id(text: Column) -> Column:
    """A number from the first 48 bits of the digest."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint")


def fence(text: Column) -> Column:
    """A fence longer than any run of backticks in the text, of three at least."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def masked(text: Column, ranges: Column) -> Column:
    """Blanks out [start, end) ranges, given in order; overlap or a range beyond the text makes it null."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(True).alias("ok"))
    walked = F.aggregate(
        ranges,
        begin,
        lambda s, r: F.struct(
            r["e"].alias("at"),
            F.concat(s["out"], F.substring(text, s["at"] + 1, r["s"] - s["at"]), F.repeat(F.lit(" "), r["e"] - r["s"])).alias("out"),
            (s["ok"] & (r["s"] >= s["at"]) & (r["e"] >= r["s"]) & (r["e"] <= F.length(text))).alias("ok"),
        ),
    )
    return F.when(walked["ok"], F.concat(walked["out"], F.substring(text, walked["at"] + 1, F.length(text))))


STROKES, ENDS, CURVES = ("S", "s", "B", "B*", "b", "b*"), ("S", "s", "B", "B*", "b", "b*", "n", "f", "f*", "F"), ("Do", "c", "v", "y", "sh")


def drawn(ops: Column) -> Column:
    """Whether drawing operators (op, x, y) show an image, a curve, a diagonal, or three stroked rectangles."""
    null = F.lit(None).cast("double")
    begin = F.struct(F.lit(False).alias("seen"), null.alias("x"), null.alias("y"), F.lit(0).alias("open"), F.lit(0).alias("drawn"))

    def step(s: Column, o: Column) -> Column:
        end, at = o["op"].isin(*ENDS), o["op"].isin("m", "l")
        slanted = (o["op"] == "l") & F.coalesce((F.abs(s["x"] - o["x"]) > 0.1) & (F.abs(s["y"] - o["y"]) > 0.1), F.lit(False))
        return F.struct(
            (s["seen"] | o["op"].isin(*CURVES) | slanted).alias("seen"),
            F.when(end, null).when(at, o["x"]).otherwise(s["x"]).alias("x"), F.when(end, null).when(at, o["y"]).otherwise(s["y"]).alias("y"),
            F.when(end, 0).when(o["op"] == "re", s["open"] + 1).otherwise(s["open"]).alias("open"),
            F.when(o["op"].isin(*STROKES), s["drawn"] + s["open"]).otherwise(s["drawn"]).alias("drawn"),
        )

    last = F.aggregate(ops, begin, step)
    return last["seen"] | (last["drawn"] >= 3)
