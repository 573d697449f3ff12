"""Token-bounded chunks of one text: blocks are packed whole, oversized ones are split where the text allows it.

Tokens are counted once for each block; every budget is then a lookup in the
sorted places where tokens start or end, which are found for blocks that are cut alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

from lectern.functions import structure

TOKEN = re.compile(r"\w+|[^\w\s]")
TARGET, MOST, OVERLAP = 750, 825, 120


class Oversized(ValueError):
    """Content that can't be kept within the limit; nothing is ever truncated."""


class Piece:
    """A block or a part of one: its own text, and what is repeated around it (a fence's edges, a table's header)."""

    def __init__(self, kind: str, line: int, said: str, before: str = "", after: str = "") -> None:
        self.kind, self.line, self.said, self.before, self.after = kind, line, said, before, after
        self.around = len(TOKEN.findall(before)) + len(TOKEN.findall(after))

    @cached_property
    def places(self) -> list[tuple[int, int]]:
        return [m.span() for m in TOKEN.finditer(self.said)]

    @cached_property
    def starts(self) -> list[int]:
        return [a for a, _ in self.places]

    @cached_property
    def own(self) -> int:
        return len(TOKEN.findall(self.said))

    @property
    def tokens(self) -> int:
        return self.around + self.own

    @property
    def text(self) -> str:
        return self.before + self.said + self.after

    @property
    def last_line(self) -> int:
        return self.line + self.said.rstrip("\n").count("\n")

    def part(self, at: int, to: int) -> Piece:
        piece = Piece(self.kind, self.line + self.said.count("\n", 0, at), self.said[at:to], self.before, self.after)
        piece.own = bisect_left(self.starts, to) - bisect_left(self.starts, at)  # no cut is inside a token
        return piece

    def longest(self, at: int, room: int) -> int:
        """The end of the longest stretch from `at` on that has at most `room` tokens."""
        k = bisect_left(self.starts, at) + room
        return self.starts[k] if k < len(self.starts) else len(self.said)

    def tail(self, room: int) -> Piece | None:
        """The last words with at most `room` tokens; none of fences and tables."""
        if not room or self.around or self.kind != "paragraph":
            return None
        at = self.places[-room - 1][1] if self.own > room else 0
        if at:
            blank = re.compile(r"\s+").search(self.said, at)
            at = blank.end() if blank else len(self.said)
        return self.part(at, len(self.said)) if at < len(self.said) else None


@dataclass
class Chunk:
    section: str
    first_line: int
    last_line: int
    tokens: int
    text: str


def split(piece: Piece, context: int, target: int, most: int, overlap: int) -> Iterator[Piece]:
    """Parts of a piece that is too long with `context` tokens ahead of it: whole rows of a table, else up to a logical cut."""
    if not piece.said:
        raise Oversized("a header or fence alone exceeds the limit")
    fixed = context + piece.around
    room = (target - overlap if fixed < target - overlap else most) - fixed
    at, size = 0, len(piece.said)
    while at < size:
        to = piece.longest(at, max(0, room))
        if to <= at or room <= 0:
            raise Oversized("heading and context leave no room for content")
        if piece.kind == "table":
            to = to if to == size else piece.said.rfind("\n", at, to) + 1 or (piece.said.find("\n", at) + 1 or size)
            if fixed + bisect_left(piece.starts, to) - bisect_left(piece.starts, at) > most:
                raise Oversized("a table row with its header exceeds the limit")
        else:
            to = at + structure.logical_cut(piece.said[at : to + 64], to - at) if to < size else size
        yield piece.part(at, to)
        at = to


def pieces(lines: list[str], kinds: str, base: int) -> Iterator[Piece]:
    """The blocks of lines whose first one is line `base`."""
    for m in structure.BLOCK.finditer(kinds):
        a, b = m.span()
        if m.lastgroup == "fence":
            closed = kinds[b - 1] == "c"
            mark = structure.FENCE.match(lines[a])[1]
            inside = lines[a + 1 : b - closed]
            yield Piece("fence", base + a + 1, "\n".join(inside), lines[a] + "\n", "\n" + (lines[b - 1] if closed else mark))
        elif m.lastgroup == "table" and b - a > 2:
            yield Piece("table", base + a + 2, "\n".join(lines[a + 2 : b]), "\n".join(lines[a : a + 2]) + "\n")
        else:
            yield Piece(m.lastgroup if m.lastgroup == "paragraph" else "header", base + a, "\n".join(lines[a:b]))


def chunks(text: str, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> list[Chunk]:
    """Chunks in order. None reaches over a section; a section's heading stands at the start of each of its chunks;
    a chunk starts with the last words of the one before it if that ended in a paragraph and they fit.
    Raises Oversized where content can't be kept within `most` tokens."""
    out: list[Chunk] = []
    lines = text.split("\n")
    kinds = structure.labels(lines)
    for title, first, last in structure.sections(text):
        headed = kinds[first - 1] == "h"
        heading = lines[first - 1] + "\n" if headed else ""
        ahead = len(TOKEN.findall(heading))
        found = list(pieces(lines[first - 1 + headed : last], kinds[first - 1 + headed : last], first + headed))
        if not found and headed:  # a heading without a body is content, too
            heading, ahead, found = "", 0, [Piece("paragraph", first, lines[first - 1])]
        ready = [p for f in found for p in ([f] if ahead + f.tokens <= most else split(f, ahead, target, most, overlap))]
        pack: list[Piece] = []
        size, new = ahead, False

        def close(last: bool = False) -> None:
            nonlocal pack, size, new
            if new:
                if size > most:
                    raise Oversized("content and context exceed the limit")
                out.append(Chunk(title, pack[0].line, pack[-1].last_line, size, heading + "\n\n".join(p.text for p in pack)))
                kept = None if last else pack[-1].tail(overlap)
                pack = [kept] if kept else []
                size, new = ahead + sum(p.tokens for p in pack), False

        for piece in ready:
            if new and size + piece.tokens > target:
                close()
            if not new and size + piece.tokens > most:
                pack, size = [], ahead  # the overlap goes before a unit is broken
            pack.append(piece)
            size, new = size + piece.tokens, True
            if size >= target:
                close()
        close(last=True)
    return out
