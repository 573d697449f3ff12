"""Suffix-array dedup: byte strings of 100 or more bytes that also start earlier.

Which suffixes need sorting is settled first, without loss. Each 100-byte
window is owned by its anchor, the 32-byte run in it with the least hash; equal
windows have equal anchors in the same place. Windows whose anchor stands once
in the corpus can't repeat. The windows that neighbour each other under one
anchor make a context, a string of 100 to 168 bytes. Equal contexts are one:
all but the first go whole, already before the shuffle within a batch.

Contexts that share an anchor but differ come together, and a difference-cover
algorithm sorts their suffixes: the triples at places 1 and 2 modulo 3 are
sorted and named, the names are sorted by recursion until they differ, the
other suffixes are merged in, and neighbours in the sorted order are
compared on their first 100 bytes. The first of each run of equal ones stays.
An anchor with very many different contexts isn't gathered in a task: its
windows are grouped by a 128-bit hash, which gives the same groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.bloom import filters, holds, size_for
from lectern.llm.common import checkpointed, dropped, whole_text, with_struct
from lectern.llm.hashing import mix

LENGTH = 100
ANCHOR = 32
REACH = LENGTH - ANCHOR + 1
PIECE = 1 << 20
#: An anchor with over so many different contexts isn't sorted in one task.
HOT_ANCHOR = 4000
#: Bytes of contexts that are sorted together.
BUCKET = 1 << 18
#: Rows that a task looks at together.
ROWS = 2000
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_UP, _DOWN = _powers(PIECE + PIECE // 2)


def _pieces(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, first byte of each part, document number, offset in the document): short texts together, long ones in parts that overlap by LENGTH - 1 bytes."""
    parts: list[tuple[bytes, int, int]] = []
    size = 0

    def made():
        lengths = np.array([len(p) for p, _, _ in parts], np.int64)
        return b"".join(p for p, _, _ in parts), np.cumsum(lengths) - lengths, np.array([d for _, d, _ in parts]), np.array([o for _, _, o in parts])

    for d, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), PIECE // 2):
            part = text[at : at + PIECE // 2 + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if size + len(part) > PIECE:
                yield made()
                parts, size = [], 0
            parts.append((part, d, at))
            size += len(part)
    if parts:
        yield made()


def contexts(texts: list[bytes]) -> Iterator[dict[str, np.ndarray]]:
    """anchor, context (hashes), doc, lo (first window in the document), n (windows), at (in piece) of every context, and the piece."""
    for piece, first, doc, offset in _pieces(texts):
        b = np.frombuffer(piece, np.uint8)
        n = len(b)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=total[1:])
            gram = mix((total[ANCHOR:] - total[:-ANCHOR]) * _DOWN[: n - ANCHOR + 1])
            low = np.uint64((1 << 24) - 1)
            least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
            width = 1
            while 2 * width <= REACH:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < REACH:
                least = np.minimum(least[: len(least) - (REACH - width)], least[REACH - width :])
        anchor = (least & low).astype(np.int64)
        ends = np.append(first[1:], n)
        part = np.repeat(np.arange(len(first)), ends - first)[: len(anchor)]
        valid = np.arange(len(anchor)) + LENGTH <= ends[part]
        start = valid.copy()
        start[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (part[1:] != part[:-1])
        at = np.flatnonzero(start)
        if not len(at):
            continue
        live = np.cumsum(valid)
        upto = np.append(live[at[1:] - 1], live[-1])
        count = upto - live[at] + 1
        with np.errstate(over="ignore"):
            said = mix((total[at + count + LENGTH - 1] - total[at]) * _DOWN[at])
            said = mix(said + (anchor[at] - at).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + count.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        yield {"anchor": gram[anchor[at]], "context": said, "doc": doc[part[at]], "lo": at - first[part[at]] + offset[part[at]], "n": count, "at": at, "piece": piece}


def _bytes(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def repeated_anchors(docs: DataFrame) -> np.ndarray:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[k : k + ROWS] for whole in batches for k in range(0, len(whole), ROWS)):
            for c in contexts(_bytes(batch["text"])):
                h, n = np.unique(c["anchor"], return_counts=True)
                yield pd.DataFrame({"h": h.astype(np.int64), "n": np.minimum(n, 2).astype(np.int8)})

    size = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    anchors = docs.mapInPandas(count, "h long, n byte").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    return filters(anchors, size_for(size // 140), repeated=F.lit(True))[0]


def _ranges(doc: np.ndarray, key: np.ndarray, lo: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """doc_id, key, ranges: the ranges of windows of each document text as pairs of int64."""
    order = np.lexsort((lo, key, doc))
    doc, key, pairs = doc[order], key[order], np.stack([lo[order], n[order]], 1).astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    edges = np.flatnonzero(new)
    return pd.DataFrame({"doc_id": doc[edges], "key": key[edges], "ranges": [x.tobytes() for x in np.split(pairs, edges[1:])] if len(doc) else []})


def located(docs: DataFrame) -> DataFrame:
    """Of docs (doc_id, key, text) the contexts whose anchor repeats, the first in its batch: anchor, context, doc_id, key, lo, n, said; and doc_id, key, ranges of windows of the other ones."""
    shared = docs.sparkSession.sparkContext.broadcast(repeated_anchors(docs))  # of bounded size

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["anchor", "context", "doc_id", "key", "lo", "n", "said", "ranges"]
        for batch in (whole.iloc[k : k + ROWS] for whole in batches for k in range(0, len(whole), ROWS)):
            ids, keys = batch["doc_id"].to_numpy(), batch["key"].to_numpy()
            rows = []
            for c in contexts(_bytes(batch["text"])):
                keep = np.flatnonzero(holds(shared.value, c["anchor"]))
                said = [c["piece"][a : a + n + LENGTH - 1] for a, n in zip(c["at"][keep].tolist(), c["n"][keep].tolist(), strict=True)]
                own = c["doc"][keep]
                rows.append((c["anchor"][keep], c["context"][keep], ids[own], keys[own], c["lo"][keep], c["n"][keep], np.array([*said, None], object)[:-1]))
            if not rows:
                continue
            anchor, context, doc, key, lo, n, said = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.lexsort((lo, doc, context, anchor))
            anchor, context, doc, key, lo, n, said = (x[order] for x in (anchor, context, doc, key, lo, n, said))
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])
            head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, int)
            later = (doc != doc[head]) | (lo != lo[head])
            # rows of one id are one document, so one that stands in the head's place in another text isn't later, but may be held against an earlier one
            first = new | ~later & (key != key[head])
            yield pd.DataFrame({"anchor": anchor[first].astype(np.int64), "context": context[first].astype(np.int64), "doc_id": doc[first], "key": key[first], "lo": lo[first], "n": n[first], "said": said[first], "ranges": None}, columns=names)
            if later.any():
                yield _ranges(doc[later], key[later], lo[later], n[later]).reindex(columns=names)

    return docs.mapInPandas(locate, "anchor long, context long, doc_id long, key long, lo long, n long, said binary, ranges binary")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The places of text in the order of their suffixes, by a difference cover modulo 3. Symbols are positive."""
    n = len(text)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.concatenate([text, np.zeros(4, text.dtype)]).astype(np.int64)
    bits = max(1, int(t.max()).bit_length())
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    if 3 * bits <= 63:  # a triple as one number
        triple = (t[sample] << (2 * bits)) | (t[sample + 1] << bits) | t[sample + 2]
        distinct, names = np.unique(triple, return_inverse=True)
        many = len(distinct)
    else:
        order = np.lexsort((t[sample + 2], t[sample + 1], t[sample]))
        parts = np.stack([t[sample], t[sample + 1], t[sample + 2]], 1)[order]
        new = np.append(True, (parts[1:] != parts[:-1]).any(1))
        names = np.empty(len(sample), np.int64)
        names[order] = np.cumsum(new) - 1
        many = int(new.sum())
    if many < len(sample):
        inner = suffix_array(names + 1)
        place = np.empty(len(sample), np.int64)
        place[inner] = np.arange(len(sample))
    else:
        place = np.empty(len(sample), np.int64)
        place[np.argsort(names)] = np.arange(len(sample))
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = place + 1
    ordered = np.empty(len(sample), np.int64)
    ordered[place] = sample
    ordered = ordered[ordered < n]
    zero = np.arange(0, n, 3)
    high = int(len(sample) + 2).bit_length()
    zero = zero[np.lexsort((rank[zero + 1], t[zero]))]
    # how many samples stand before each of the others: by a symbol and a rank, or two symbols and a rank
    pair = lambda i: (t[i] << high) | rank[i + 1]
    ones, twos = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    before = np.searchsorted(pair(ones), pair(zero))
    if 2 * bits + high <= 63:
        longer = lambda i: (t[i] << (bits + high)) | (t[i + 1] << high) | rank[i + 2]
        before += np.searchsorted(longer(twos), longer(zero))
    else:
        every = np.concatenate([twos, zero])
        order = np.lexsort((np.arange(len(every)) < len(twos), rank[every + 2], t[every + 1], t[every]))
        is_two = order < len(twos)
        seen = np.empty(len(every), np.int64)
        seen[order] = np.cumsum(is_two)
        before += seen[len(twos) :]
    out = np.full(n, -1, np.int64)
    at = before + np.arange(len(zero))
    out[at] = zero
    out[out < 0] = ordered
    return out


def bucket_repeats(said: list[bytes], doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, window) of the windows of these contexts that equal one of an earlier place."""
    text = np.frombuffer(b"".join(said), np.uint8)
    lengths = np.array([len(s) for s in said], np.int64)
    first = np.cumsum(lengths) - lengths
    order = suffix_array(text.astype(np.int64) + 1)
    owner = np.repeat(np.arange(len(said)), lengths)
    inside = np.arange(len(text)) - first[owner]
    starts = order[inside[order] < n[owner[order]]]
    windows = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
    new = np.ones(len(starts), bool)
    for at in range(1, len(starts), 65_536):
        part = starts[at - 1 : at + 65_536]
        said_here = windows[part]
        new[at : at + 65_536] = (said_here[1:] != said_here[:-1]).any(1)
    d, p = doc[owner[starts]], lo[owner[starts]] + inside[starts]
    group = np.cumsum(new) - 1
    by = np.lexsort((p, d, group))
    heads = by[np.searchsorted(group[by], np.arange(group[-1] + 1))] if len(group) else by
    later = (d != d[heads][group]) | (p != p[heads][group])
    return owner[starts][later], p[later]


def _sorted_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """doc_id, key, ranges of repeated windows; rows come sorted by anchor."""
    held: list[pd.DataFrame] = []
    size = 0

    def settle(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        doc, key = rows["doc_id"].to_numpy(np.int64), rows["key"].to_numpy(np.int64)
        c, p = bucket_repeats(list(rows["said"]), doc, rows["lo"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))
        if len(c):
            yield _ranges(doc[c], key[c], p, np.ones(len(p), np.int64))

    for batch in batches:
        sizes = batch["said"].map(len).to_numpy()
        begin = 0
        anchors = batch["anchor"].to_numpy()
        if held and anchors[0] != held[-1]["anchor"].iloc[-1] and size > BUCKET:
            yield from settle(pd.concat(held))
            held, size = [], 0
        for edge in np.flatnonzero(anchors[1:] != anchors[:-1]) + 1:
            size_here = size + int(sizes[begin:edge].sum())
            if size_here > BUCKET:
                yield from settle(pd.concat([*held, batch.iloc[begin:edge]]))
                held, size, begin = [], 0, int(edge)
        held.append(batch.iloc[begin:])
        size += int(sizes[begin:].sum())
    if held:
        yield from settle(pd.concat(held))


def _hashed_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for said, doc, key, lo, n in zip(batch["said"], batch["doc_id"], batch["key"], batch["lo"], batch["n"], strict=True):
            hashes = [hashlib.blake2b(said[k : k + LENGTH], digest_size=16).digest() for k in range(n)]
            yield pd.DataFrame({"window": hashes, "doc_id": doc, "key": key, "lo": lo + np.arange(n)})


def _of_anchors(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """The rows whose anchor may be among these, by a filter of bounded size; whole rows needn't be shuffled to drop the others."""
    (mask,) = filters(anchors.select(F.col("anchor").alias("h")), size_for(anchors.count()), own=F.lit(True))
    shared = rows.sparkSession.sparkContext.broadcast(mask)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[holds(shared.value, batch["anchor"].to_numpy(np.int64).view(np.uint64))]

    return rows.mapInPandas(keep, rows.schema)


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, key, los, ns, ranges: the windows of docs (doc_id, key, text) that also start earlier, as a table."""
    found = checkpointed(located(docs))
    place = F.struct("doc_id", "lo")
    rows = found.where("anchor is not null").drop("ranges")
    # the first place of each context; bytes stay where they are
    heads = checkpointed(rows.groupBy("anchor", "context").agg(F.min(place).alias("head"), F.count("*").alias("rows")))
    later = rows.drop("said").join(heads.where("rows > 1"), ["anchor", "context"]).where(place > F.col("head")).select("doc_id", "key", "lo", "n")
    # the contexts of anchors that have several different ones
    several = heads.groupBy("anchor").agg(F.count("*").alias("contexts"), F.min("context").alias("least"), F.max("context").alias("most"))
    several = checkpointed(several.where("least <> most").select("anchor", "contexts"))
    mixed = _of_anchors(rows, several).join(several, "anchor").withColumn("head", F.min(place).over(Window.partitionBy("anchor", "context")))
    mixed = checkpointed(mixed.where(place == F.col("head")).drop("head"))
    usual = mixed.where(F.col("contexts") <= HOT_ANCHOR).repartition("anchor").sortWithinPartitions("anchor", "doc_id", "lo")
    by_order = usual.select("anchor", "doc_id", "key", "lo", "n", "said").mapInPandas(_sorted_buckets, "doc_id long, key long, ranges binary")
    hot = mixed.where(F.col("contexts") > HOT_ANCHOR).select("doc_id", "key", "lo", "n", "said").mapInPandas(_hashed_windows, "window binary, doc_id long, key long, lo long")
    first = hot.groupBy("window").agg(F.min(place).alias("head"))
    hot_later = hot.join(first, "window").where(place > F.col("head")).select("doc_id", "key", "lo", F.lit(1).cast("long").alias("n"))
    ranges = found.where("ranges is not null").select("doc_id", "key", "ranges").union(by_order).groupBy("doc_id", "key").agg(F.collect_list("ranges").alias("ranges"))
    windows = later.union(hot_later).groupBy("doc_id", "key").agg(F.collect_list("lo").alias("los"), F.collect_list("n").alias("ns"))
    out = checkpointed(windows.join(ranges, ["doc_id", "key"], "full"))
    dropped(found, heads, several, mixed)
    return out


def repeats(docs: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row, and with `keep` the kept bytes.

    A byte goes if a 100-byte string that covers it also starts earlier: in a
    document with a smaller id, or in the same one further up. Null text counts
    as empty. Rows without an id are neither searched nor held against others.
    Rows with one id are the same document: equal places of theirs are not
    earlier than each other.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("key", F.xxhash64("text", F.md5("text")))
    joined = texts.join(marked(texts.where("doc_id is not null")), ["doc_id", "key"], "left")

    def cut(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, los, ns, ranges in batches:
            out = []
            for text, lo, n, packed in zip(texts, los, ns, ranges, strict=True):
                text = text.encode("utf-8", "surrogatepass")
                pairs = [np.zeros((0, 2), np.int64)]
                if lo is not None:
                    pairs.append(np.stack([np.asarray(lo, np.int64), np.asarray(n, np.int64)], 1))
                if packed is not None:
                    pairs.append(np.frombuffer(b"".join(packed), np.int64).reshape(-1, 2))
                at = np.concatenate(pairs)
                change = np.zeros(len(text) + 1, np.int64)
                np.add.at(change, at[:, 0], 1)
                np.add.at(change, at.sum(1) + LENGTH - 1, -1)
                gone = np.cumsum(change)[:-1] > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), *([kept] if keep else [])))
            yield pd.DataFrame(out, columns=names)

    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return with_struct(joined, cut, schema, "text", "los", "ns", "ranges").select("doc_id", *names)
