"""Bloom filters of bounded size over 64-bit hashes; all bits of a key lie in one 64-bit word."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed, dropped

#: Log2 of the most 64-bit words of a filter: 4,194,304 words, 32 MB. Beyond about 30 million keys a filter lets more through; what it lets through is always looked at.
MOST_BITS = 22
PROBES = 4


def size_for(keys: int) -> int:
    """Log2 of the words for so many keys: two or more words for each, within the bound."""
    return max(10, min(MOST_BITS, int(keys).bit_length()))


def bits_of(h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), np.uint64)
    for j in range(PROBES):
        out |= np.uint64(1) << ((h >> np.uint64(6 * j)) & np.uint64(63))
    return out


def slot_of(h: np.ndarray, size: int) -> np.ndarray:
    return (h >> np.uint64(64 - size)).astype(np.int64)


def holds(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter; those that are always are."""
    bits = bits_of(h)
    return (words[slot_of(h, len(words).bit_length() - 1)] & bits) == bits


def _bits() -> Column:
    bit = lambda j: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {6 * j}) & 63 as int))")
    bits = bit(0)
    for j in range(1, PROBES):
        bits = bits.bitwiseOR(bit(j))
    return bits


#: Log2 of the words that travel as one row.
CHUNK_BITS = 12


def filters(hashes: DataFrame, size: int, **members: Column) -> list[np.ndarray]:
    """A filter for each named condition, of the rows (h long, ...) that meet it.

    Words are put together in Spark and come to the driver one partition after
    the other, in chunks; all together they are at most 2^MOST_BITS words.
    """
    slot = F.expr(f"cast(shiftrightunsigned(h, {64 - size}) as int)")
    none = F.lit(0).cast("long")
    words = hashes.select(slot.alias("slot"), *(F.when(c, _bits()).otherwise(none).alias(k) for k, c in members.items()))
    words = words.groupBy("slot").agg(*(F.bit_or(k).alias(k) for k in members))
    names = list(members)
    chunk = 1 << min(CHUNK_BITS, size)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        first = int(rows["slot"].iloc[0]) // chunk * chunk
        out = {"first": [first]}
        for name in names:
            part = np.zeros(chunk, np.int64)
            part[rows["slot"].to_numpy() - first] = rows[name].to_numpy()
            out[name] = [part.tobytes()]
        return pd.DataFrame(out)

    packed = words.groupBy(F.expr(f"slot div {chunk}")).applyInPandas(pack, "first long, " + ", ".join(f"{k} binary" for k in names))
    out = [np.zeros(1 << size, np.uint64) for _ in names]
    chunks = checkpointed(packed)
    for row in chunks.coalesce(8).toLocalIterator():
        for f, name in zip(out, names, strict=True):
            f[row["first"] : row["first"] + chunk] = np.frombuffer(row[name], np.uint64)
    dropped(chunks)
    return out


def words_in(docs: DataFrame) -> int:
    """About how many words all texts have, from their lengths; sizes filters."""
    return int((docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) // 6)
