"""BPE encoding and decoding by tree concatenation.

A text of over `leaf_chars` characters is cut into leaves anywhere, inside a
word as well. The leaves of all texts are encoded in parallel, and a tree of
joins puts each text's leaves together, FAN of them in a task at a time. At a
join a window of tokens around the seam is encoded anew and grows until its
first and last token are those that both sides have there. BPE by ranks is
right for a sequence exactly if it is right for every adjacent pair, and then
each adjacent pair stands in one of the three right encodings, so the joined
one is right. A window doesn't reach over blanks or special tokens, where this
tokenizer always cuts. A shorter text is one leaf.

Within a leaf, pieces of text are encoded once per worker and kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from lectern.llm.common import checkpointed, whole_text, with_struct

DEFAULT_VOCABULARY = "word_bpe_49k.json"
LEAF_CHARS = 16_384
#: Segments that one task joins at once.
FAN = 64
#: Entries of a worker's cache of encoded pieces, in each of two generations.
CACHE_ENTRIES = 100_000
#: Texts are looked up together until they have about so many characters.
GROUP_CHARS = 1 << 19
#: Texts without these characters are already in composed form, and Python's letters are the tokenizer's there.
UNUSUAL = re.compile(r"[^\x00-\x7E\xA1-\u017F]|[\xB2\xB3\xB9\xBC-\xBE]|<\|")
#: The tokenizer's own split for such texts in lower case.
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xAA\xB5\xBA\xDF-\xF6\xF8-\u017F]+|[0-9]|[^\t-\r 0-9a-z\xAA\xB5\xBA\xDF-\xF6\xF8-\u017F]+")


@dataclass
class Segment:
    """Token ids of a part of a text, how many of them stand before its first and after its last blank or special token, and whether it has none of these."""

    ids: np.ndarray
    head: int
    tail: int
    whole: bool


class Codec:
    """The tokenizer, and its bare merge model for symbols before (`open`) and at (`closed`) a word's end."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.full = Tokenizer.from_str(json.dumps(spec))
        self.full.no_truncation()
        self.full.no_padding()
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.closed = Tokenizer(BPE(model["vocab"], merges, end_of_word_suffix=self.suffix or None))
        self.open = Tokenizer(BPE(model["vocab"], [m for m in merges if not m[1].endswith(self.suffix)] if self.suffix else merges))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.full.get_vocab(with_added_tokens=True).items()}
        blanks = [c for c in map(chr, range(0x3001)) if c.isspace() and not self.full.pre_tokenizer.pre_tokenize_str(c)]
        self.edge = re.compile("|".join(["[" + re.escape("".join(blanks)) + "]", *map(re.escape, self.special)]))
        self.known: dict[bytes | str, tuple[bytes, bytes]] = {}
        self.before: dict[bytes | str, tuple[bytes, bytes]] = {}
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        rest = [b for b in range(256) if b not in kept]
        self.letters = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.byte = {c: b for b, c in self.letters.items()}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if spec["pre_tokenizer"]["type"] == "Sequence" else ""
        self.known_split = split == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def decode(self, ids: list[int]) -> str:
        return self.full.decode(ids, skip_special_tokens=False)

    def learn(self, words: set) -> None:
        """Has the ids and the decoded text of these blank-free pieces (bytes) or pre-tokens in lower case (str) among the known ones."""
        if len(self.known) > CACHE_ENTRIES:  # what isn't asked for again goes with the next change
            self.before, self.known = self.known, {}
        new = words - self.known.keys()
        again = new & self.before.keys()
        self.known.update(zip(again, map(self.before.__getitem__, again), strict=True))
        new -= again
        token = self.token.__getitem__
        for kind in (bytes, str):
            own = [w for w in new if type(w) is kind]
            for at in range(0, len(own), 20_000):
                part = own[at : at + 20_000]
                if kind is bytes:
                    found = self.full.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
                else:
                    found = self.closed.encode_batch_fast([w if w.isascii() and w.isalpha() else w.encode().decode("latin-1").translate(self.letters) for w in part], add_special_tokens=False)
                for word, e in zip(part, found, strict=True):
                    ids = e.ids
                    self.known[word] = array("I", ids).tobytes(), " ".join(map(token, ids)).encode()

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Packed ids and decoded text in UTF-8 of each text."""
        group, size = [], 0
        for text in texts:
            usual = self.known_split and not UNUSUAL.search(text)
            group.append((usual, PRE_TOKEN.findall(text.lower()) if usual else text.encode("utf-8", "replace").split()))
            size += len(text)
            if size > GROUP_CHARS:
                yield from self._encoded(group)
                group, size = [], 0
        yield from self._encoded(group)

    def _encoded(self, group: list[tuple[bool, list]]) -> Iterator[tuple[bytes, bytes]]:
        self.learn(set().union(*(words for _, words in group)))
        for usual, words in group:
            found = list(map(self.known.__getitem__, words))
            if not usual:  # some pieces have no tokens
                found = [x for x in found if x[0]]
            packed, said = zip(*found, strict=True) if found else ((), ())
            yield b"".join(packed), b" ".join(said)

    def safe_cut(self, text: str, at: int) -> int:
        """The first place from `at` on where the text may be cut: not inside a special token, nor before a character that could join with the one before it."""
        while at < len(text):
            inside = [at + k for s in self.special for k in range(1, len(s)) if at + k >= len(s) and text.startswith(s, at + k - len(s))]
            if inside:
                at = max(inside)
            elif text[at].isascii() or unicodedata.category(text[at])[0] in "LN" and not unicodedata.combining(text[at]) and not 0x1100 <= ord(text[at]) <= 0x11FF:
                return at
            else:
                at += 1
        return len(text)

    def leaves(self, text: str, size: int) -> Iterator[str]:
        """The text in parts of about `size` characters."""
        at = 0
        while at < len(text):
            end = self.safe_cut(text, at + size)
            yield text[at:end]
            at = end

    def segments(self, leaves: list[str]) -> Iterator[Segment]:
        parts = []
        for leaf in leaves:
            first = self.edge.search(leaf)
            if not first:
                parts += [leaf, "", ""]
                continue
            last = first.end()
            for found in self.edge.finditer(leaf, max(last, len(leaf) - 200)):
                last = found.end()
            if last == first.end():  # no blank near the end
                for found in self.edge.finditer(leaf, last):
                    last = found.end()
            parts += [leaf[: first.start()], leaf[first.start() : last], leaf[last:]]
        made = [packed for packed, _ in self.encode_texts(parts)]
        for k, leaf in enumerate(leaves):
            head, middle, tail = made[3 * k : 3 * k + 3]
            whole = not self.edge.search(leaf)
            yield Segment(np.frombuffer(head + middle + tail, np.uint32), len(head) // 4, len(head if whole else tail) // 4, whole)

    def spelled(self, ids: list[int]) -> str:
        """The symbols of tokens, without the marks of words' ends."""
        said = [self.token[i] for i in ids]
        return "".join(t.removesuffix(self.suffix) for t in said) if self.suffix else "".join(said)

    def window(self, ids: list[int], closed: bool) -> list[int]:
        """The tokens of what these neighbouring ones spell; none if a character is cut at an end."""
        try:
            text = bytes(map(self.byte.__getitem__, self.spelled(ids))).decode()
        except UnicodeDecodeError:
            return []
        words = [w for w, _ in self.full.pre_tokenizer.pre_tokenize_str(text)]
        out = [i for e in self.closed.encode_batch_fast(words[:-1], add_special_tokens=False) for i in e.ids]
        return out + (self.closed if closed else self.open).encode(words[-1], add_special_tokens=False).ids

    def seam(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring parts of a stretch without blanks."""
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            whole_left, whole_right = k >= len(left), k >= len(right)
            made = self.window(a + b, whole_right or self.token[b[-1]].endswith(self.suffix))
            if made and (whole_left or made[0] == a[0]) and (whole_right or made[-1] == b[-1]):
                return left[:-k] + made + right[k:]
            k *= 2

    def join(self, left: Segment, right: Segment) -> Segment:
        if not left.tail or not right.head:  # a blank or a special token at the seam
            ids = np.concatenate([left.ids, right.ids])
            return Segment(ids, left.head, right.tail, False)
        at = len(left.ids) - left.tail
        made = np.array(self.seam(left.ids[at:].tolist(), right.ids[: right.head].tolist()), np.uint32)
        ids = np.concatenate([left.ids[:at], made, right.ids[right.head :]])
        return Segment(ids, len(made) if left.whole else left.head, len(made) if right.whole else right.tail, left.whole and right.whole)

    def join_tree(self, segments: list[Segment]) -> Segment:
        while len(segments) > 1:
            segments = [self.join(*segments[i : i + 2]) if i + 1 < len(segments) else segments[i] for i in range(0, len(segments), 2)]
        return segments[0]


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _digest(packed: bytes, decoded: bytes, keep: bool) -> tuple:
    out = (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest())
    return (*out, np.frombuffer(packed, np.int32)) if keep else out


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """encoded and a column decoded: the text of its ids; null ids have no text, empty ones the empty text."""
    path = vocabulary or public_tokenizers.path(DEFAULT_VOCABULARY)

    @F.pandas_udf("string")
    def said(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield pd.Series([None if x is None else codec(path).decode([int(i) for i in x]) for x in ids], dtype=object)

    return encoded.withColumn("decoded", said("ids"))


def encode(docs: DataFrame, vocabulary: str | None = None, leaf_chars: int = LEAF_CHARS, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, and with `keep` the ids themselves; `decode` gives the text of ids.

    Null or empty text has no tokens and decodes to the empty text. Repeated
    rows and null ids give a row each. Other columns of docs are not kept.
    """
    path = vocabulary or public_tokenizers.path(DEFAULT_VOCABULARY)
    rows = docs.select("doc_id", whole_text().alias("text"))
    long = F.length("text") > leaf_chars
    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep else "")
    names = [x.split()[0] for x in columns.split(", ")]

    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for texts in batches:
            yield pd.DataFrame([_digest(*x, keep) for x in c.encode_texts(list(texts))], columns=names)

    short = with_struct(rows.where(~long), whole, columns, "text").drop("text")
    named = checkpointed(rows.where(long).withColumn("key", F.sha2("text", 256)))
    most = named.agg(F.max(F.length("text")).alias("n")).first()["n"]
    if most is None:
        return short
    parts = encoded_leaves(named.select("key", "text").dropDuplicates(["key"]), path, leaf_chars)
    n = -(-most // leaf_chars)
    while n > FAN:
        parts, n = joined(parts, path), -(-n // FAN)

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        c = codec(path)
        ids = c.join_tree(_segments(rows)).ids
        return pd.DataFrame([(rows["key"].iloc[0], *_digest(ids.tobytes(), c.decode(ids.tolist()).encode(), keep))], columns=["key", *names])

    grown = parts.groupBy("key").applyInPandas(finish, f"key string, {columns}")
    return short.unionByName(named.select("doc_id", "key").join(grown, "key").drop("key"))


SEGMENT = "key string, part long, ids binary, head long, tail long, whole boolean"


def _frame(keys: list[str], parts: list[int], segments: list[Segment]) -> pd.DataFrame:
    rows = [(key, part, s.ids.tobytes(), s.head, s.tail, s.whole) for key, part, s in zip(keys, parts, segments, strict=True)]
    return pd.DataFrame(rows, columns=["key", "part", "ids", "head", "tail", "whole"])


def _segments(rows: pd.DataFrame) -> list[Segment]:
    rows = rows.sort_values("part")
    return [Segment(np.frombuffer(i, np.uint32), h, t, w) for i, h, t, w in zip(rows["ids"], rows["head"], rows["tail"], rows["whole"], strict=True)]


def encoded_leaves(texts: DataFrame, path: str, leaf_chars: int) -> DataFrame:
    """A segment for each leaf of texts (key, text), encoded wherever the leaf is dealt to."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"], strict=True):
                leaves = list(c.leaves(text, leaf_chars))
                for at in range(0, len(leaves), FAN):
                    part = leaves[at : at + FAN]
                    yield pd.DataFrame({"key": key, "part": range(at, at + len(part)), "leaf": part})

    def encode_each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for batch in batches:
            for at in range(0, len(batch), FAN):
                rows = batch.iloc[at : at + FAN]
                yield _frame(list(rows["key"]), list(rows["part"]), list(c.segments(list(rows["leaf"]))))

    leaves = texts.mapInPandas(cut, "key string, part long, leaf string")
    return leaves.repartition("key", "part").mapInPandas(encode_each, SEGMENT)


def joined(segments: DataFrame, path: str) -> DataFrame:
    """The segments of each key, FAN neighbours joined into one; parts are numbered anew."""

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        return _frame(list(rows["key"].iloc[:1]), [rows["part"].iloc[0] // FAN], [codec(path).join_tree(_segments(rows))])

    return segments.groupBy("key", F.expr(f"part div {FAN}")).applyInPandas(grow, SEGMENT)
