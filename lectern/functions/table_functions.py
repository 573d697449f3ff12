"""Table functions for SQL: `SELECT d.id, s.* FROM docs d, LATERAL sections(d.text) s`.

Null texts give no rows. Arguments are checked, and the columns stated, when a query is analysed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lectern.functions import chunking, structure


def _text(argument: AnalyzeArgument) -> None:
    if argument.isTable or not isinstance(argument.dataType, StringType):
        raise ValueError("the first argument must be a text")


def _lines(first: str) -> StructType:
    return StructType().add(first, StringType()).add("line_start", IntegerType()).add("line_end", IntegerType())


class Sections:
    """title, line_start, line_end of the sections of a Markdown text."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        _text(text)
        return AnalyzeResult(_lines("title"))

    def eval(self, text: str) -> Iterator[tuple]:
        if text is not None:
            yield from structure.sections(text)


class Blocks:
    """kind, line_start, line_end of the blocks of a Markdown text."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        _text(text)
        return AnalyzeResult(_lines("kind"))

    def eval(self, text: str) -> Iterator[tuple]:
        if text is not None:
            yield from structure.blocks(text)


LIMITS = {"target": chunking.TARGET, "most": chunking.MOST, "overlap": chunking.OVERLAP}


class Chunks:
    """idx, section, line_start, line_end, tokens, content, problem of the chunks of a Markdown text. Limits are whole numbers, named target, most and overlap.
    A text that can't be kept within them gives one row with the problem."""

    @staticmethod
    def analyze(text: AnalyzeArgument, **limits: AnalyzeArgument) -> AnalyzeResult:
        _text(text)
        for name, limit in limits.items():
            if name not in LIMITS:
                raise ValueError(f"{name} isn't one of {', '.join(LIMITS)}")
            if not limit.isConstantExpression or not isinstance(limit.value, int) or limit.value < 0:
                raise ValueError(f"{name} must be a whole number")
        given = LIMITS | {name: limit.value for name, limit in limits.items()}
        if not 0 <= given["overlap"] < given["target"] <= given["most"]:
            raise ValueError("overlap < target <= most must hold")
        told = StructType().add("idx", IntegerType()).add("section", StringType()).add("line_start", IntegerType()).add("line_end", IntegerType())
        return AnalyzeResult(told.add("tokens", IntegerType()).add("content", StringType()).add("problem", StringType()))

    def eval(self, text: str, **limits: int) -> Iterator[tuple]:
        if text is None:
            return
        try:
            found = chunking.chunks(text, **limits)
        except chunking.Oversized as problem:
            yield None, None, None, None, None, None, str(problem)
            return
        for idx, c in enumerate(found):
            yield idx, c.section, c.first_line, c.last_line, c.tokens, c.text, None


def register(spark: SparkSession) -> None:
    """Makes sections, blocks and chunk table functions of this session."""
    for name, kind in (("sections", Sections), ("blocks", Blocks), ("chunk", Chunks)):
        spark.udtf.register(name, udtf(kind))
