import base64
import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lectern.llm import byte_bpe


def library():
    with open(public_tokenizers.path(byte_bpe.DEFAULT_RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def row(ids, said):
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(said).hexdigest()


def texts():
    rnd = random.Random(4)
    fixed = [
        None, "", " ", "\n\n  \t x", "Plain words, it's 25% off!", "<|endoftext|> stays text", "Ünï中文 Straße İ 😀👍🏽 ١٢٣ é", "x" * 900, " " * 900, "!" * 700 + "'s and'll",
        "a" * 64 + "'re" + " " * 70 + "b", "՘࢏ new letters \U0001e5d0\U00011de1", "same", "same", "\x1c\x1d a\x1eb \x85 c d", "word " * 300 + "'" * 200 + "ve" * 90,
    ]
    pool = ["a", "bc", "'", "'s", "'re", "'l", " ", "  ", "\n", "!", "?!", "1", "23", "é", "中", "😀", "՘", " "]
    return fixed + ["".join(rnd.choice(pool) * rnd.choice((1, 1, 1, 2, 40)) for _ in range(rnd.randint(1, 250))) for _ in range(60)]


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (7, 5), (100, 100)])
def test_encoding_equals_the_library(spark, chunk, overlap):
    said, own = texts(), library()
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(said)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.encode(docs, chunk_chars=chunk, overlap=overlap).collect()}
    assert got == {i: row(own.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(said)}


def test_classes_are_the_librarys(spark):
    """Each code point between two letters, numbers or blanks is split as the library splits it."""
    c, own = byte_bpe.codec(public_tokenizers.path(byte_bpe.DEFAULT_RANKS), public_tokenizers.PATTERN), library()
    rnd = random.Random(1)
    for _ in range(300):
        text = "".join(chr(rnd.choice([rnd.randrange(0xD800), rnd.randrange(0xE000, 0x33000)])) + rnd.choice("a1 !") for _ in range(200))
        assert np.frombuffer(c.encode(text), "<u4").tolist() == own.encode_ordinary(text)


def test_runs_that_the_library_cant_split(spark):
    """Millions of blanks end the library's own splitter; here they are one pre-token, and their round trip is exact."""
    text = " " * 300_000 + "a" * 300_000
    docs = spark.createDataFrame([(None, text), (None, text)], "doc_id long, text string")
    rows = byte_bpe.decode(byte_bpe.encode(docs, keep=True)).collect()
    assert len(rows) == 2 and all(bytes(r.decoded).decode() == text and r.doc_id is None for r in rows)


def test_decoding_and_empty_tables(spark):
    ids = spark.createDataFrame([([72, 105],), ([],), (None,)], "ids array<int>")
    assert [None if r.decoded is None else len(r.decoded) for r in byte_bpe.decode(ids).collect()] == [2, 0, None]
    assert byte_bpe.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode(ids, chunk_chars=5, overlap=9)
