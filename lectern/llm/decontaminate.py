"""Benchmark decontamination by counted pieces and the exact edit distance.

Each item is cut into disjoint pieces of a few characters. An edit spoils one
piece at most, so of a passage within the edit limit all pieces but that many
stand in the text unchanged, and they lie in line: their places in text and
item differ by about the same number, give or take the limit. Every place of
the whole text is looked up; where enough pieces of an item lie in line, the
exact edit distance of the whole item decides. So no passage within the limit
is lost, wherever its edits are.

The items are a stated set: they go to the executors in blocks of bounded size.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import fresh, whole_text, with_struct
from lectern.llm.hashing import lower_ascii

#: Characters of a piece, fewer where an item is so short that all of its pieces could be spoiled.
PIECE = 5
SLOT_BITS = 20
BLOCK_CHARS = 500_000
#: Texts are looked up together until they have about so many characters; longer ones in parts.
GROUP_CHARS = 1 << 15


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """The q characters from each place on as one number."""
    n = max(0, len(codes) - q + 1)
    out = np.zeros(n, np.uint64)
    for j in range(q):
        out = (out << np.uint64(8)) | codes[j : j + n]
    return out


def slots(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def infix_distance(pattern: bytes, text: bytes) -> int:
    """The least edit distance of the pattern and any part of the text (bit-parallel)."""
    m = len(pattern)
    if not m:
        return 0
    mask, top, places = (1 << m) - 1, 1 << (m - 1), {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    pv, mv, score, best = mask, 0, m, m
    for c in text:
        eq = places.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & mask), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        pv, mv = mh | (~(xv | ph) & mask), ph & xv
        best = min(best, score)
    return best


class Index:
    """The pieces of all items, and how many of each item's must lie in line."""

    def __init__(self, texts: list[str], share: float) -> None:
        self.items = [b" ".join(lower_ascii(t).split()) for t in texts]
        self.length = np.array([len(t) for t in self.items], np.int64)
        self.limit = np.array([int(share * len(t)) for t in self.items], np.int64)
        self.width = np.maximum(1, self.limit)
        self.longest = int((self.length + self.limit).max(initial=1))
        self.group = max(4 * self.longest, GROUP_CHARS)
        # an item of m characters keeps m // q - limit pieces at least; one character is the shortest piece
        sizes = [next((q for q in range(PIECE, 1, -1) if m // q > k), 1) for m, k in zip(self.length.tolist(), self.limit.tolist(), strict=True)]
        self.pieces = self.length // np.array(sizes, np.int64) if sizes else self.length
        self.tables = []
        for q in sorted(set(sizes)):
            own = [i for i, size in enumerate(sizes) if size == q]
            cut = [grams(np.frombuffer(self.items[i], np.uint8), q)[::q] for i in own]
            keys = np.concatenate(cut)
            order = np.argsort(keys, kind="stable")
            known, first, count = np.unique(keys[order], return_index=True, return_counts=True)
            item = np.repeat(own, [len(x) for x in cut])[order]
            offset = np.concatenate([q * np.arange(len(x)) for x in cut])[order]
            used = np.zeros(1 << SLOT_BITS, bool)
            used[slots(known)] = True
            self.tables.append((q, used, known, first, count, item, offset, self.width[item].astype(float)))

    def parts(self, text: bytes) -> Iterator[bytes]:
        """The text in parts that overlap by the longest passage; most texts are one part."""
        for at in range(0, len(text), self.group):
            yield text[at : at + self.group + self.longest]

    def places(self, codes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, start, end, least distance) of all stretches that may hold the item, most pieces in line first.

        The pieces that a passage keeps lie within limit places of one line, so within two neighbouring strips of that width.
        """
        # cells are the strips of all items, one item after the other; the last strip of an item stays empty
        strips = (len(codes) + self.longest) // self.width + 2
        cells = np.cumsum(strips) - strips
        needed = np.repeat(self.pieces - self.limit, strips)
        for q, used, known, first, count, items, offsets, widths in self.tables:
            g = grams(codes, q)
            at = np.flatnonzero(used[slots(g)])
            g = g[at]
            k = np.minimum(np.searchsorted(known, g), len(known) - 1)
            same = known[k] == g
            at, k = at[same], k[same]
            n = count[k]
            entry = np.repeat(first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
            item = items[entry]
            hit = cells[item] + ((np.repeat(at + self.longest, n) - offsets[entry]) / widths[entry]).astype(np.int64)
            inside = np.bincount(hit, minlength=len(needed))
            inside[:-1] += inside[1:]
            enough = inside >= needed
            # of the strips that are left, a piece that stands there several times counts once
            size = int(self.pieces.max()) + 1
            once = []
            for own in (hit, hit - 1):
                left = np.flatnonzero(enough[own])
                once.append(own[left] * size + offsets[entry[left]] // q)
            pairs, inside = np.unique(np.unique(np.concatenate(once)) // size, return_counts=True)
            item = np.searchsorted(cells, pairs, side="right") - 1
            strip = pairs - cells[item]
            missing = self.pieces[item] - inside
            may = np.flatnonzero(missing <= self.limit[item])
            may = may[np.argsort(missing[may], kind="stable")]
            start = strip * self.width[item] - self.longest
            end = start + 2 * self.width[item] + self.length[item] + self.limit[item]
            yield from zip(item[may].tolist(), (start - self.limit[item])[may].tolist(), end[may].tolist(), missing[may].tolist(), strict=True)

    def search(self, group: list[tuple[int, bytes]], found: list[dict[int, int]]) -> None:
        """Adds what the parts (text's number, part) hold to found."""
        ends = np.cumsum([len(part) + 1 for _, part in group]).tolist()
        codes = np.frombuffer(b"\n".join(part for _, part in group), np.uint8)
        for i, start, end, least in self.places(codes):
            for x in range(bisect.bisect_right(ends, start), len(group)):
                d, part = group[x]
                begin = ends[x] - len(part) - 1
                if begin >= end:
                    break
                best = found[d].get(i, int(self.limit[i]) + 1)
                if least < best:
                    apart = infix_distance(self.items[i], part[max(0, start - begin) : end - begin])
                    if apart < best:
                        found[d][i] = apart

    def matches(self, texts: list[bytes]) -> list[dict[int, int]]:
        """For each text the items within the edit share, with their distances."""
        found: list[dict[int, int]] = [{} for _ in texts]
        group: list[tuple[int, bytes]] = []
        size = 0
        for d, text in enumerate(texts if self.items else []):
            for part in self.parts(b" ".join(text.split())):
                group.append((d, part))
                size += len(part)
                if size >= self.group:
                    self.search(group, found)
                    group, size = [], 0
        if group:
            self.search(group, found)
        return found


def _finder(index: Broadcast, *names: str) -> Callable:
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, ids = index.value
        for texts in batches:
            found = own.matches([lower_ascii(t or "") for t in texts])
            yield pd.DataFrame(dict(zip(names, ([[ids[i] for i in sorted(f)] for f in found], [[f[i] for i in sorted(f)] for f in found]), strict=True)))

    return find


def contaminated(docs: DataFrame, items: DataFrame, share: float = 0.15, name: str = "matched") -> DataFrame:
    """docs and a column (matched) array<struct<item_id, distance>>: the items found in the text within share * length edits, letters in lower case and blanks as one.

    Null or empty texts and items match nothing; equal items match alike.
    """
    named = items.select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text")).where(F.trim("text") != "")
    size = named.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    out = docs
    parts = []
    for b in range(blocks):
        rows = named.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("text", "item_id").collect()  # at most about BLOCK_CHARS characters
        index = docs.sparkSession.sparkContext.broadcast((Index([r.text for r in rows], share), [r.item_id for r in rows]))

        item, apart, part = fresh("items", out), fresh("distances", out), fresh(f"part{b}", out)
        rows = with_struct(out, _finder(index, item, apart), f"{item} array<long>, {apart} array<long>", "text")
        pairs = F.zip_with(item, apart, lambda i, d: F.struct(i.alias("item_id"), d.alias("distance")))
        out = rows.withColumn(part, pairs).drop(item, apart)
        parts.append(part)
    return out.withColumn(name, F.concat(*parts)).drop(*(p for p in parts if p != name))


def leaks(docs: DataFrame, items: DataFrame, share: float = 0.15) -> DataFrame:
    """doc_id, item_id, distance of every leak: a row for each document row and item it holds."""
    found = contaminated(docs.select("doc_id", "text"), items, share)
    return found.select("doc_id", F.explode("matched").alias("m")).select("doc_id", F.col("m.item_id").alias("item_id"), F.col("m.distance").alias("distance"))
