"""Substring dedup by fixed-block anchors.

Every document's words are cut into non-overlapping reference blocks of
(window + 1) // 2 words. Any window of words that two documents share holds a
whole block of either. All rolling runs of a block's length are probed against
the index of blocks (a Bloom filter of fixed size; a second one holds blocks
that several documents have, so that a document's own blocks don't count as
hits). A hit is extended to the windows that hold it; these are candidates, with
no false negatives. They alone are hashed, to 96 bits, gathered by hash and held
against the smallest document that has them, and neighbouring windows that repeat
join into maximal repeats.

Within a batch a window is sent on for its smallest document only; the others
are marked at once. So a passage that a third of all rows share gives one row
for each batch. If the corpus outgrows the filter, more windows are candidates
than need be, and the results stay the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.bloom import filters, holds, size_for, words_in
from lectern.llm.common import checkpointed, dropped, whole_text, with_struct
from lectern.llm.hashing import runs, runs_at, word_hashes

WINDOW = 13


def _texts(batch: pd.DataFrame) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in batch["text"]]


def _key(text: bytes) -> bytes:
    """Tells the texts of rows with one id apart."""
    return hashlib.blake2b(text, digest_size=8).digest()


def block_filters(docs: DataFrame, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Bloom filters of all blocks, and of those that stand on several rows."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [np.unique(runs(w, block)[::block]) for w in word_hashes(_texts(batch))]
            found, n = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]), return_counts=True)
            yield pd.DataFrame({"h": found.astype(np.int64), "n": np.minimum(n, 2).astype(np.int8)})

    blocks = docs.mapInPandas(index, "h long, n byte").groupBy("h").agg(F.sum("n").alias("n"))
    one, several = filters(blocks, size_for(words_in(docs) // block), one=F.lit(True), several=F.col("n") > 1)
    return one, several


def window_hits(words: np.ndarray, window: int, block: int, one: np.ndarray, several: np.ndarray) -> np.ndarray:
    """Which windows hold a run that may be a block of another document."""
    rolling = runs(words, block)
    hit = holds(one, rolling)
    hit[::block] &= holds(several, rolling[::block])
    total = np.concatenate([[0], np.cumsum(hit)])
    n = len(words) - window + 1
    span = window - block + 1
    return (total[span : span + n] - total[:n]) > 0


def hashes_at(words: np.ndarray, window: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each of these windows, of 64 and 32 bits."""
    h, g = runs_at(words, window, at)
    return h, (g >> np.uint64(32)).astype(np.uint32).view(np.int32)


def candidates(docs: DataFrame, window: int, block: int) -> DataFrame:
    """doc_id, h, g: the smallest document of each candidate window in a batch; doc_id, marks: windows known to repeat already, as packed bits."""
    shared = docs.sparkSession.sparkContext.broadcast(block_filters(docs, block))  # of fixed size

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, several = shared.value
        names = ["doc_id", "h", "g", "marks"]
        for batch in batches:
            hashes, more, owner, place, sizes = [], [], [], [], []
            data = _texts(batch)
            for i, words in enumerate(word_hashes(data)):
                sizes.append(max(0, len(words) - window + 1))
                if sizes[-1]:
                    at = np.flatnonzero(window_hits(words, window, block, one, several))
                    h, g = hashes_at(words, window, at)
                    hashes.append(h)
                    more.append(g)
                    owner.append(np.full(len(at), i))
                    place.append(at)
            if not hashes:
                continue
            h, g, i, at = np.concatenate(hashes), np.concatenate(more), np.concatenate(owner), np.concatenate(place)
            ids = batch["doc_id"].to_numpy()
            rank = ids[i]
            order = np.lexsort((rank, g, h))
            h, g, i, at, rank = h[order], g[order], i[order], at[order], rank[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            least = rank[new][np.cumsum(new) - 1]
            later = rank > least
            yield pd.DataFrame({"doc_id": rank[new], "h": h[new].astype(np.int64), "g": g[new], "marks": None})
            marked = pd.DataFrame({"i": i[later], "at": at[later]})
            out = []
            for k, own in marked.groupby("i")["at"]:
                flags = np.zeros(sizes[k], np.uint8)
                flags[own.to_numpy()] = 1
                out.append((ids[k], None, None, _key(data[k]) + np.packbits(flags).tobytes()))
            if out:
                yield pd.DataFrame(out, columns=names)

    return docs.mapInPandas(probe, "doc_id long, h long, g int, marks binary")


def found_again(words: np.ndarray, window: int, hs: np.ndarray, gs: np.ndarray) -> np.ndarray:
    """Which windows have one of these pairs of hashes."""
    size = len(words) - window + 1
    h, g = hashes_at(words, window, np.arange(size))
    flags = np.isin(h, hs)
    at = np.flatnonzero(flags)
    known = set(zip(hs.tolist(), gs.tolist(), strict=True))
    flags[at] = [pair in known for pair in zip(h[at].tolist(), g[at].tolist(), strict=True)]
    return flags


def repeats(docs: DataFrame, window: int = WINDOW, keep: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row, and with `keep` the kept text and the removed runs (in words, end exclusive).

    A word goes if a window of words that covers it also starts in a document
    with a smaller id. Null or empty text has no words. Rows without an id are
    neither searched nor held against others. If an id stands on several rows,
    they are one document.
    """
    block = (window + 1) // 2
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    known = texts.where("doc_id is not null")
    found = checkpointed(candidates(known, window, block))
    one = found.where("h is not null").select("h", "g", "doc_id")
    # a window has a row for each batch at most
    held = one.withColumn("least", F.min("doc_id").over(Window.partitionBy("h", "g")))
    later = held.where("doc_id > least").groupBy("doc_id").agg(F.collect_list("h").alias("hs"), F.collect_list("g").alias("gs"))
    marks = found.where("marks is not null").groupBy("doc_id").agg(F.collect_list("marks").alias("marks"))
    again = checkpointed(later.join(marks, "doc_id", "full"))
    dropped(found)
    rows = texts.join(again, "doc_id", "left")

    def cut(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, firsts, seconds, masks in batches:
            out = []
            data = [t.encode("utf-8", "surrogatepass") for t in texts]
            for text, words, hs, gs, marks in zip(data, word_hashes(data), firsts, seconds, masks, strict=True):
                n = len(words)
                gone = np.zeros(n, bool)
                size = n - window + 1
                if size > 0 and (hs is not None or marks is not None):
                    flags = np.zeros(size, bool)
                    if hs is not None:
                        flags |= found_again(words, window, np.asarray(hs, np.int64).astype(np.uint64), np.asarray(gs, np.int32))
                    for m in marks if marks is not None else []:
                        if m[:8] == _key(text):
                            flags |= np.unpackbits(np.frombuffer(m, np.uint8, offset=8), count=size).astype(bool)
                    cover = np.zeros(n + 1, np.int64)
                    cover[np.flatnonzero(flags)] += 1
                    cover[np.flatnonzero(flags) + window] -= 1
                    gone = np.cumsum(cover)[:n] > 0
                own = text.split()
                kept = b" ".join([w for w, g in zip(own, gone.tolist(), strict=True) if not g])
                row = (n, int(gone.sum()), hashlib.sha256(kept).hexdigest())
                if keep:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    row += (kept.decode("utf-8", "replace"), [[int(a), int(b)] for a, b in edge.reshape(-1, 2)])
                out.append(row)
            yield pd.DataFrame(out, columns=names)

    schema = "n_words long, n_removed long, kept_sha256 string" + (", kept string, removed array<array<long>>" if keep else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return with_struct(rows, cut, schema, "text", "hs", "gs", "marks").select("doc_id", *names)


#: The same over words and positions, for window 13.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13 AND doc_id IS NOT NULL),
runs AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS run FROM places),
later AS (SELECT rid, i FROM (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY run) AS least FROM runs) WHERE doc_id > least),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS j FROM later),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
kept AS (SELECT rid, count(g.j) AS n_removed, string_agg(word, ' ' ORDER BY words.j) FILTER (g.j IS NULL) AS said FROM words LEFT JOIN gone g USING (rid, j) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(said, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""
