"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of over `chunk_chars` characters is cut into chunks that overlap by
`overlap` characters, and each is cut into pre-tokens by itself. Where a
chunk starts within a pre-token its first boundaries may be wrong, but from a
boundary on matching looks at nothing before it. So at the first place in an
overlap where both chunks have a boundary they agree from there on, and the
stretches between such places are encoded in parallel. With this pattern, which is made
of runs of four kinds of characters, chunks agree after two runs at the
latest; a run as long as the overlap leaves its seam open, and the chunks
around it become one stretch. Each stretch checks that its end is a boundary.

Decoding concatenates the raw bytes of the tokens.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed, dropped, whole_text, with_struct

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
CHUNK_CHARS, OVERLAP = 32_768, 512
#: Entries of a worker's cache of encoded pre-tokens, in each of two generations, and the longest one it keeps.
CACHE_ENTRIES, CACHE_CHARS = 150_000, 64
#: What a match may look at beyond its end.
SIGHT = 2
CLASSES = (r"\p{L}", r"\p{N}", r"\s")


def ranges(points: list[int]) -> str:
    """A pattern's list of these code points."""
    at = np.array(points)
    cut = np.flatnonzero(np.diff(at) != 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]], strict=True))


class Codec:
    """Ranks and the pre-token pattern, with the library's own classes of characters.

    Two libraries may follow different Unicode versions. Texts whose characters both see alike are split
    by the pattern as it stands, others by one that lists the classes.
    """

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.one = self.model._core_bpe.encode_single_piece
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        letters, numbers, blanks = (self._matched(every, c) for c in CLASSES)
        unlike = set()
        for own, name in zip((letters, numbers, blanks), CLASSES, strict=True):
            unlike |= set(own) ^ {ord(c) for c in regex.findall(name, every)}
        exact = pattern
        for name, own in zip(CLASSES, (letters, numbers, blanks), strict=True):  # inside brackets first
            exact = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(name, ranges(own)), exact)  # noqa: B023
            exact = exact.replace(name, f"[{ranges(own)}]")
        self.exact = re.compile(exact.replace(r"\S", f"[^{ranges(blanks)}]"))
        self.plain = regex.compile(pattern)
        self.unlike = re.compile(f"[{ranges(sorted(unlike))}]") if unlike else None
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    @staticmethod
    def _matched(text: str, pattern: str) -> list[int]:
        """The code points of text that the library's own pattern matches."""
        single = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        return list(map(ord, single.decode_bytes(single.encode_ordinary(text)).decode()))

    def pieces(self, text: str) -> list[str]:
        usual = text.isascii() or not (self.unlike and self.unlike.search(text))
        return (self.plain if usual else self.exact).findall(text)

    def packed(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            found = self.before.get(piece) or np.array(self.one(piece.encode()), "<u4").tobytes()
            if len(piece) <= CACHE_CHARS:
                if len(self.known) >= CACHE_ENTRIES:  # what isn't asked for again goes with the next change
                    self.before, self.known = self.known, {}
                self.known[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.packed, self.pieces(text)))

    def decode(self, packed: bytes) -> bytes:
        return self.model.decode_bytes(np.frombuffer(packed, "<u4").tolist())

    def boundaries(self, text: str, ends_here: bool) -> np.ndarray:
        """Where pre-tokens start or end, as far as what follows the text can't change it."""
        at = np.r_[0, np.cumsum([len(p) for p in self.pieces(text)], dtype=np.int64)]
        return at if ends_here else at[at + SIGHT <= len(text)]

    def stretch(self, chunks: list[tuple[int, str]], start: int, end: int) -> bytes:
        """The tokens from start to end of the text that consecutive chunks (start, text) hold; more of it follows if they go beyond the end."""
        said, at = [], start
        for first, text in chunks:
            said.append(text[at - first :])
            at = first + len(text)
        text = "".join(said)
        found = self.pieces(text)
        ends = np.cumsum([len(p) for p in found], dtype=np.int64)
        n = int(np.searchsorted(ends, end - start))
        if end > start and (n == len(ends) or ends[n] != end - start):
            raise ValueError("a stretch ends inside a pre-token: this pattern needs a longer overlap")
        return b"".join(map(self.packed, found[: n + 1] if end > start else []))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _digest(c: Codec, packed: bytes, keep: bool) -> tuple:
    out = (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(c.decode(packed)).hexdigest())
    return (*out, np.frombuffer(packed, np.int32)) if keep else out


def decode(encoded: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """encoded and a column decoded: the bytes of its ids, which needn't be UTF-8 if ids were cut; null ids give null."""
    path = ranks or public_tokenizers.path(DEFAULT_RANKS)

    def said(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield pd.Series([None if x is None else codec(path, pattern).model.decode_bytes([int(i) for i in x]) for x in ids], dtype=object)

    return encoded.withColumn("decoded", F.pandas_udf(said, "binary")("ids"))


def encode(docs: DataFrame, ranks: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP, keep: bool = False, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, and with `keep` the ids themselves; `decode` gives the bytes of ids.

    Null or empty text has no tokens and decodes to no bytes. Repeated rows and
    null ids give a row each. Other columns of docs are not kept. Special tokens' strings are ordinary text.
    """
    if not SIGHT < overlap <= chunk_chars:
        raise ValueError("the overlap must be over 2 and not over a chunk")
    path = ranks or public_tokenizers.path(DEFAULT_RANKS)
    rows = docs.select("doc_id", whole_text().alias("text"))
    long = F.length("text") > chunk_chars
    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep else "")
    names = [x.split()[0] for x in columns.split(", ")]

    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        for texts in batches:
            yield pd.DataFrame([_digest(c, c.encode(text), keep) for text in texts], columns=names)

    short = with_struct(rows.where(~long), whole, columns, "text").drop("text")
    named = checkpointed(rows.where(long).withColumn("key", F.sha2("text", 256)))
    chunks = chunked(named.select("key", "text").dropDuplicates(["key"]), path, pattern, chunk_chars, overlap)
    stretches = checkpointed(encoded_stretches(chunks, path, pattern))
    dropped(chunks)

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        packed = b"".join(rows.sort_values("part")["ids"])
        return pd.DataFrame([(rows["key"].iloc[0], *_digest(codec(path, pattern), packed, keep))], columns=["key", *names])

    grown = checkpointed(stretches.groupBy("key").applyInPandas(finish, f"key string, {columns}"))
    dropped(stretches)
    slim = checkpointed(named.select("doc_id", "key"))
    dropped(named)
    return short.unionByName(slim.join(grown, "key").drop("key"))


def chunked(texts: DataFrame, path: str, pattern: str, chunk_chars: int, overlap: int) -> DataFrame:
    """key, part, start, text of overlapping chunks of texts (key, text), and head and tail: the boundaries in the overlaps with the chunks before and after."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"], strict=True):
                starts = range(0, len(text), chunk_chars)
                for at in range(0, len(starts), 64):
                    some = starts[at : at + 64]
                    yield pd.DataFrame({"key": key, "part": range(at, at + len(some)), "start": some, "text": [text[s : s + chunk_chars + overlap] for s in some], "ends": [s + chunk_chars + overlap >= len(text) for s in some]})

    def split(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        for said, ends in batches:
            found = [c.boundaries(text, end) for text, end in zip(said, ends, strict=True)]
            yield pd.DataFrame({"head": [b[b <= overlap] for b in found], "tail": [b[b >= chunk_chars] - chunk_chars for b in found]})

    parts = texts.mapInPandas(cut, "key string, part long, start long, text string, ends boolean")
    return checkpointed(with_struct(parts.repartition("key", "part"), split, "head array<long>, tail array<long>", "text", "ends").drop("ends"))


def encoded_stretches(chunks: DataFrame, path: str, pattern: str) -> DataFrame:
    """key, part, ids: the tokens of the stretches between the places where neighbouring chunks agree."""
    tails = chunks.select("key", (F.col("part") + 1).alias("part"), "tail")
    both = F.array_min(F.array_intersect("head", "tail"))
    seams = chunks.select("key", "part", "start", "head", F.length("text").alias("size")).join(tails, ["key", "part"], "left")
    seams = seams.select("key", "part", (F.col("start") + F.col("size")).alias("stop"), F.when(F.col("part") == 0, F.lit(0)).otherwise(F.col("start") + both).alias("at"))
    order = Window.partitionBy("key").orderBy("part")  # narrow rows of one text
    homes = seams.withColumn("home", F.max(F.when(F.col("at").isNotNull(), F.col("part"))).over(order))
    nearest = F.first("at", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    homes = homes.withColumn("to", F.coalesce(nearest, F.max("stop").over(Window.partitionBy("key")))).drop("stop")
    items = chunks.select("key", "part", "start", "text").join(homes, ["key", "part"]).groupBy("key", "home")
    found = items.agg(F.array_sort(F.collect_list(F.struct("part", "start", "text"))).alias("items"), F.max("at").alias("at"), F.max("to").alias("to"))

    def tokens(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for items, starts, ends in batches:
            yield pd.Series([c.stretch([(i["start"], i["text"]) for i in chunk], int(a), int(b)) for chunk, a, b in zip(items, starts, ends, strict=True)], dtype=object)

    return found.select("key", F.col("home").alias("part"), F.pandas_udf(tokens, "binary")("items", "at", "to").alias("ids"))
