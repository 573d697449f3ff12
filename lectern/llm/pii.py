"""Personal data: candidate spans, gradient-boosted trees on format and context, calibrated thresholds.

Exact rules find e-mail addresses, IPv4 addresses, payment cards and
international phone numbers; those spans always stay. High-recall generators
propose further, overlapping spans (national phone numbers, identity and
account numbers, spelled-out addresses); boosted trees score each from its
format and the words around it, and spans over the threshold of their kind are
added where no other span lies. No labels of personal data come with the
tables, so trees and thresholds learn from generated examples (`examples`),
the same at every size of the input.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import whole_text, with_struct

KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("phone", "account", "email")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A start inside a run of digits can't match where the run's first digit doesn't.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBER = re.compile(r"(?:\+|\()?[0-9][0-9().\x20/-]{5,24}[0-9]")
ACCOUNT = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b|\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b")
SPELLED = re.compile(r"\b[A-Za-z0-9._-]{2,40}\x20?(?:\(at\)|\[at\]|\x20at\x20|＠)\x20?[A-Za-z0-9-]{2,40}(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z]{2,12}){1,3}\b")
WORDS = {
    "phone": re.compile(r"tel|phone|call|mobile|cell|fax|dial|whatsapp|sms|numéro|telefon|móvil|handy", re.I),
    "account": re.compile(r"iban|ssn|social|security|account|konto|cuenta|compte|passport|tax|insurance", re.I),
    "email": re.compile(r"mail|write|contact|reach|address", re.I),
    "other": re.compile(r"order|invoice|version|isbn|page|total|price|year|date|size|ref|model|chapter|section|score|\$|€|%", re.I),
}
CONTEXT_CHARS = 28


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1] in "._%+-" or text[start - 1].isascii() and text[start - 1].isalnum()):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the exact rules, by start and then kind."""
    found = [(s, e, "email") for s, e in emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 40 and 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
            found.append((*m.span(), "card"))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Overlapping proposals of the high-recall generators."""
    found = [(*m.span(), "account") for m in ACCOUNT.finditer(text)]
    for m in NUMBER.finditer(text):
        found.append((*m.span(), "phone"))
        for part in re.finditer(r"(?:\([0-9]{2,4}\)\x20?)?[0-9]+(?:[-./][0-9]+)+", m[0]):  # also the parts between blanks
            if part.span() != (0, len(m[0])) and part.end() - part.start() >= 7:
                found.append((m.start() + part.start(), m.start() + part.end(), "phone"))
    if "at" in text or "＠" in text:
        found += [(*m.span(), "email") for m in SPELLED.finditer(text)]
    return found


def features(text: str, span: tuple[int, int, str]) -> list[float]:
    start, end, kind = span
    said, left, right = text[start:end], text[max(0, start - CONTEXT_CHARS) : start], text[end : end + CONTEXT_CHARS]
    groups = re.findall("[0-9]+", said)
    digits = "".join(groups)
    sizes = [len(g) for g in groups][:5] + [0] * (5 - len(groups[:5]))
    near = left + " | " + right
    return [
        float(ADDED_KINDS.index(kind)), len(digits), len(groups), *sizes, said.count("-"), said.count("."), said.count(" "), said.count("/"),
        float("(" in said), float(said[0] == "+"), float(said[0] == "0"), len(set(digits)), float(luhn(digits) if digits else 0),
        sum(c.isupper() for c in said), float("(at)" in said or "[at]" in said), float("(dot)" in said or "[dot]" in said or " dot " in said),
        *(float(bool(p.search(left))) for p in WORDS.values()), float(bool(WORDS["other"].search(near))),
        float(left[-1:].isalnum()), float(right[:1].isalnum()), float(left[-1:] in ".,/-+#=:"), float(right[:1] in "/-%$€"),
    ]


def examples(n: int, seed: int) -> Iterator[tuple[str, tuple[int, int, str], int]]:
    """Generated (text, span, label) rows: formats of personal data and of numbers that aren't, in neutral and telling contexts."""
    rnd = random.Random(seed)
    d = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9)))
    good = [
        ("phone", lambda: f"({d(3)}) {d(3)}-{d(4)}"), ("phone", lambda: f"{d(3)}-{d(3)}-{d(4)}"), ("phone", lambda: f"{d(3)}.{d(3)}.{d(4)}"),
        ("phone", lambda: f"0{d(3)} {d(3)} {d(4)}"), ("phone", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"), ("phone", lambda: f"0{d(3)}/{d(6)}"),
        ("account", lambda: f"{d(3)}-{d(2)}-{d(4)}"), ("account", lambda: f"{rnd.choice(('DE', 'FR', 'ES', 'GB'))}{d(2)} " + " ".join(d(4) for _ in range(rnd.randint(3, 5)))),
        ("email", lambda: f"{word()}.{word()} (at) {word()}.com"), ("email", lambda: f"{word()} [at] {word()} [dot] org"), ("email", lambda: f"{word()} at {word()} dot com"),
    ]
    bad = [
        ("phone", lambda: f"{rnd.randint(1900, 2030)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}"), ("phone", lambda: f"{rnd.randint(1, 28):02d}.{rnd.randint(1, 12):02d}.{rnd.randint(1900, 2030)}"),
        ("phone", lambda: d(rnd.randint(7, 24))), ("phone", lambda: " ".join(d(rnd.randint(1, 8)) for _ in range(rnd.randint(2, 5)))), ("phone", lambda: f"{d(rnd.randint(1, 6))}.{d(rnd.randint(2, 10))}"),
        ("phone", lambda: f"{rnd.randint(1900, 2030)}-{rnd.randint(1900, 2030)}"), ("phone", lambda: f"{d(3)}-{d(1)}-{d(4)}-{d(4)}-{d(1)}"), ("phone", lambda: ".".join(d(rnd.randint(1, 3)) for _ in range(rnd.randint(4, 7)))),
        ("phone", lambda: f"{d(rnd.randint(1, 3))} {d(3)} {d(3)}"), ("phone", lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}"),
        ("account", lambda: f"{rnd.choice(('AB', 'XK', 'ID'))}{d(2)}{d(4)}{d(4)}{d(4)}"), ("email", lambda: f"{word()} at {word()}.{word()}"), ("email", lambda: f"{word()} at {word()}. {word()}"),
    ]
    hints = {"phone": ("call ", "tel: ", "Phone ", "mobile "), "account": ("IBAN ", "SSN: ", "account "), "email": ("mail ", "write to ", "contact ")}
    for _ in range(n):
        label = rnd.random() < 0.4
        kind, make = rnd.choice(good if label else bad)
        lead = " ".join(word() for _ in range(3)) + rnd.choice((" ", ", ", ": "))
        if rnd.random() < 0.3:
            lead += rnd.choice(hints[kind] if label or rnd.random() < 0.1 else ("order ", "version ", "page ", "total ", "ref "))
        said = make()
        text = lead + said + rnd.choice((" ", ". ", ", ")) + word()
        yield text, (len(lead), len(lead) + len(said), kind), int(label)


@dataclass
class Trees:
    """Boosted trees of depth 3: for each, 7 split features, 7 thresholds and 8 leaf values."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float
    cut: dict[str, float]

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(3):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += leaf[at - 7]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3) -> Trees:
    """Second-order boosting of the logistic loss on the features' own cut points."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 24))) for j in range(x.shape[1])]
    start = float(np.log(y.mean() / (1 - y.mean())))
    total, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(7, np.int64), np.full(7, np.inf)
        for k in range(7):
            here = node == k
            gs, hs, best = g[here].sum(), h[here].sum(), 1e-6
            for j, at in enumerate(cuts):
                slot = np.searchsorted(at, x[here, j], side="left")
                gl, hl = np.cumsum(np.bincount(slot, g[here], len(at) + 1))[:-1], np.cumsum(np.bincount(slot, h[here], len(at) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                if len(gain) and gain.max() > best:
                    best, feature[k], threshold[k] = gain.max(), j, at[gain.argmax()]
            node[here] = 2 * k + 1 + (x[here, feature[k]] > threshold[k])
        leaf = -rate * np.bincount(node - 7, g, 8) / (np.bincount(node - 7, h, 8) + 1)
        total += leaf[node - 7]
        trees.append((feature, threshold, leaf))
    return Trees(*(np.array(part) for part in zip(*trees, strict=True)), start, {})


@lru_cache(maxsize=4)
def trained(n: int = 5000, seed: int = 11, precision: float = 0.995) -> Trees:
    """Trees from generated examples; the threshold of a kind is the least that reaches the precision on other ones."""
    fit, held = list(examples(n, seed)), list(examples(n, seed + 1))
    trees = boost(np.array([features(t, s) for t, s, _ in fit]), np.array([y for *_, y in fit], float))
    p = trees.probability(np.array([features(t, s) for t, s, _ in held]))
    for kind in ADDED_KINDS:
        own = [(p[i], y) for i, (_, s, y) in enumerate(held) if s[2] == kind]
        order = sorted(own, reverse=True)
        right = np.cumsum([y for _, y in order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= precision)
        trees.cut[kind] = max(0.6, float(order[good[-1]][0])) if len(good) else 1.1
    return trees


def find(texts: list[str], trees: Trees) -> Iterator[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    proposed = [(i, c) for i, t in enumerate(texts) for c in candidates(t)]
    chosen: dict[int, list] = {}
    if proposed:
        p = trees.probability(np.array([features(texts[i], c) for i, c in proposed]))
        for (i, c), score in zip(proposed, p, strict=True):
            if score >= trees.cut[c[2]]:
                chosen.setdefault(i, []).append((-score, c))
    for i, own in enumerate(base):
        spans = list(own)
        for _, (s, e, kind) in sorted(chosen.get(i, [])):
            if all(e <= a or s >= b for a, b, _ in spans):
                spans.append((s, e, kind))
        yield own, sorted(spans)


def said(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a mark of its kind for each span; overlapping spans become one."""
    out, at = [], 0
    for s, e, kind in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _scan(texts: list[str], trees: Trees) -> Iterator[tuple]:
    for base, spans in find(texts, trees):
        yield (*(sum(k == kind for *_, k in base) for kind in KINDS), hashlib.sha256(said(base).encode()).hexdigest(), said(spans))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, their digest, and all spans, for each row. Null or empty text has none; repeated rows and null ids give a row each."""
    trees = docs.sparkSession.sparkContext.broadcast(trained())  # of fixed size
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(list(_scan(list(texts), trees.value)), columns=names)

    return with_struct(docs.select("doc_id", whole_text().alias("text")), run, SCHEMA, "text").drop("text")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of its text replaced; null text stays null, empty text empty, other columns stay. Repeated rows are redacted alike, each for itself."""
    trees = docs.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            own = [t if t is not None else "" for t in texts]
            out = [redact(t, spans) for t, (_, spans) in zip(own, find(own, trees.value), strict=True)]
            yield pd.Series([None if t is None else o for t, o in zip(texts, out, strict=True)], dtype=object)

    return docs.withColumn("text", clean("text"))
