"""Structure of one text that depends on what came before it in the text: sections, blocks, cuts, repairs, strict JSON.

Plain functions over a single string; the queries apply them to batches of a column.
"""

from __future__ import annotations

import html.entities
import json
import re

# Titles of the text before the first heading and of a text without headings.
PREFACE, NO_HEADINGS = "(introducción)", "(sin encabezados)"
# Words after which, and units before which, a text isn't cut.
NEGATIONS = ("no", "not", "não", "sin", "excepto")
UNITS = ("ms", "s", "MB", "GB", "KB", "%", "kg")
# Signs besides letters that a repair may give.
SIGNS = "¿¡«»–—“”‘’…·ºª\u00a0"

HEADING = re.compile(r" {0,3}#{1,6}\s+(.*)")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
ROW = re.compile(r"(?=.*\|).*[^|\s]")
DELIMITER = re.compile(r"(?=.*\|)\s*\|*\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|*\s*")
#: Blocks as runs of line labels: a fence to its end, a header row over a delimiter row and the rows below, a paragraph up to a blank line or the next of these.
BLOCK = re.compile("(?P<fence>of*c?)|(?P<table>[rd]d[rd]*)|(?P<paragraph>(?:(?![rd]d)[rdhp])+)")


def labels(lines: list[str]) -> str:
    """A letter for each line: o, f, c (a fence's opening line, inside and closing line; an open fence goes on to the end), b blank, d delimiter row, r other row, h heading, p other."""
    out, closing = [], None
    for line in lines:
        if closing:
            kind = "c" if closing.fullmatch(line) else "f"
        elif edge := FENCE.match(line):
            kind = "o"
        elif not line.strip():
            kind = "b"
        elif ROW.match(line):
            kind = "d" if DELIMITER.fullmatch(line) else "r"
        else:
            kind = "p"
        if kind in "rdp" and HEADING.fullmatch(line):
            kind = "h"
        if kind == "o":
            closing = re.compile(" {0,3}" + edge[1][0] + "{%d,}" % len(edge[1]) + r"\s*")
        elif kind == "c":
            closing = None
        out.append(kind)
    return "".join(out)


def sections(text: str) -> list[tuple[str, int, int]]:
    """(title, first line, last line), lines from 1."""
    lines = text.split("\n")
    kinds = labels(lines)
    heads = [(HEADING.fullmatch(lines[i])[1].strip(), i) for i, kind in enumerate(kinds) if kind == "h"]
    if not heads:
        return [(NO_HEADINGS, 1, len(lines))]
    if kinds[: heads[0][1]].strip("b"):
        heads = [(PREFACE, 0), *heads]
    ends = [i for _, i in heads[1:]] + [len(lines)]
    return [(title, i + 1, end) for (title, i), end in zip(heads, ends, strict=True)]


def blocks(text: str) -> list[tuple[str, int, int]]:
    """(kind, first line, last line) of fences, tables and paragraphs."""
    return [(m.lastgroup, m.start() + 1, m.end()) for m in BLOCK.finditer(labels(text.split("\n")))]


RUN = re.compile(r"\s+")
FOLLOWING = re.compile(r"\s*(\S*)")


def logical_cut(text: str, upto: int) -> int:
    """Where to cut a text that fits up to `upto`: at the last of its best gaps (paragraph, line, sentence, word), not behind a negation nor before a unit; inside a word if it has none."""
    if upto >= len(text):
        return len(text)
    runs = [m.span() for m in RUN.finditer(text, 0, upto)]
    newline, paragraph = text.find("\n", 0, upto) >= 0, text.find("\n\n", 0, upto) >= 0
    for worth in (3,) * paragraph + (2,) * newline + (1, 0):
        for i in range(len(runs) - 1, -1, -1):
            start, end = runs[i]
            if newline and (line := text.rfind("\n", start, end)) >= 0:
                double = text.rfind("\n\n", start, end)
                own, cut = (3, double + 2) if double >= 0 else (2, line + 1)
            else:
                own, cut = int(start > 0 and text[start - 1] in ".!?;"), end
            if own == worth and text[runs[i - 1][1] if i else 0 : start].lower() not in NEGATIONS and FOLLOWING.match(text, end)[1] not in UNITS:
                return cut
    return upto


def _damaged_forms() -> dict[str, str]:
    """What each damaged form of an accented letter or a sign stands for, by rule: entities by name and number, percent and backslash codes."""
    out = {}
    for name, code in html.entities.name2codepoint.items():
        letter = chr(code)
        if letter.isalpha() or letter in SIGNS:
            out[f"&{name};"] = letter
            for mark in ("acute", "grave", "circ", "tilde", "uml", "cedil"):
                if name == name[0] + mark:
                    out[f"&{name}"] = letter  # also without the semicolon
    for code in range(0xA0, 0x10000):
        letter = chr(code)
        if letter.isalpha() or letter in SIGNS:
            out[f"&#{code};"] = out[f"&#x{code:x};"] = letter
            if 0xC0 <= code <= 0xFF:
                out[f"%{code:02x}"] = out[f"\\u{code:04x}"] = letter
    for wrong, right in (("l", "í"), ("L", "Í")):  # an l read for an i
        out[f"&{wrong}acute;"] = out[f"&{wrong}acute"] = right
    return out


FORMS = _damaged_forms()
SUSPECT = re.compile(r"&[A-Za-z](?:acute|grave|circ|tilde|uml|cedil);?|&#?\w+;|%\w\w|\\u\w{4}|3")


def repair(text: str) -> str:
    """Letters that were written as HTML entities, as percent or backslash codes behind a letter, or with a digit in `-ción`."""
    out, done = [], 0
    for m in SUSPECT.finditer(text):
        form, before, after = m[0], text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if form == "3":
            word = text[max(0, m.start() - 3) : m.start()]
            letter = "ó" if len(word) == 3 and word.endswith("ci") and word[0].isalpha() and re.compile(r"n\b").match(text, m.end()) else None
        elif form[0] == "&":
            letter = FORMS.get(form) or FORMS.get(form.lower() if form[1] == "#" else form)
        else:
            whole = form[0] != "%" or not after.isnumeric() and after != "%"
            letter = FORMS.get(form.lower()) if before.isalpha() and whole else None
        if letter:
            out += [text[done : m.start()], letter]
            done = m.end()
    return "".join(out) + text[done:]


def strict_json(text: str) -> str:
    """'ok', or why the text isn't strict JSON: repeated keys, NaN or Infinity, syntax."""
    problems = []

    def pairs(items: list) -> dict:
        if len({k for k, _ in items}) < len(items):
            problems.append("duplicate key")
        return dict(items)

    try:
        json.loads(text, object_pairs_hook=pairs, parse_constant=lambda _: problems.append("not finite"))
    except ValueError:
        return "syntax"
    return problems[0] if problems else "ok"
