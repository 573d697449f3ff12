import hashlib
import random
import struct

import public_tokenizers
from tokenizers import Tokenizer

from lectern.llm import bpe


def expected(texts):
    t = Tokenizer.from_file(public_tokenizers.path(bpe.DEFAULT_VOCABULARY))
    t.no_truncation()
    t.no_padding()
    for text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        yield len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encoding_equals_the_library(spark):
    rnd = random.Random(1)
    texts = [
        None, "", " \n\t", "Plain words, it's 25% off!", "Ünïcode Straße İstanbul é  nbsp em \u001c x", "a<|endoftext|>b <|startoftext|>",
        "x" * 3000, "ab" * 700 + " " + "".join(rnd.choice("etaoinshr") for _ in range(5000)) + " end", "中文" * 600, "!'s" * 500,
        "y" * 300 + "<|endoftext|>" + "thesand" * 200, "same", "same",
    ]
    texts += ["".join(rnd.choice("aeiorstn'-1 é") for _ in range(rnd.randint(1, 900))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(docs, leaf_chars=64).collect()}
    assert got == dict(enumerate(expected(texts)))


def test_joined_leaves_equal_the_library():
    """Leaves cut anywhere: inside words, contractions, punctuation, before marks, beside special tokens."""
    c = bpe.codec(public_tokenizers.path(bpe.DEFAULT_VOCABULARY))
    rnd = random.Random(5)
    alphabets = ["ab'’-.!? ", "etaoinshr 'lst ", "'s't're've \"--", "<|endoftext|> a", "é\u0301eñ 中文かが\u3099 Ａ\u1112\u1161\u11ab국한국", "0123 9a.b\x1c\x85", "ΣςÅİIıß ﬁ", "\u0323\u0301a b\u0327"]
    for _ in range(2000):
        some = "".join(rnd.sample(alphabets, rnd.randint(1, 3)))
        text = "".join(rnd.choice(some) for _ in range(rnd.randint(0, 120)))
        if rnd.random() < 0.3:
            k = rnd.randint(0, len(text))
            text = text[:k] + rnd.choice(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "'ll", "'re"]) + text[k:]
        leaves = list(c.leaves(text, rnd.choice([1, 2, 3, 5, 8, 16, 40])))
        assert "".join(leaves) == text
        ids = c.join_tree(list(c.segments(leaves))).ids.tolist() if leaves else []
        assert ids == c.full.encode(text, add_special_tokens=False).ids, text


def test_long_texts_take_the_tree(spark, monkeypatch):
    """Texts over a leaf, with and without blanks, go through several levels of joins; the library agrees."""
    monkeypatch.setattr(bpe, "FAN", 3)
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(1, 12)))
    texts = [" ".join(word() for _ in range(400)), "".join(word() for _ in range(300)), "a" * 5000, "x" + " " * 900 + "y"]
    docs = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string")
    long = docs.selectExpr("md5(text) AS key", "text").dropDuplicates(["key"])
    assert bpe.encoded_leaves(long, public_tokenizers.path(bpe.DEFAULT_VOCABULARY), 100).count() > 60
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(docs, leaf_chars=100).collect()}
    assert got == dict(enumerate(expected(texts * 2)))


def test_known_pieces_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 50)
    c = bpe.Codec(public_tokenizers.path(bpe.DEFAULT_VOCABULARY))
    texts = [f"word{i} and ünd{i % 7} 中文{i}" for i in range(400)]
    for text, (packed, said) in zip(texts, (x for t in texts for x in c.encode_texts([t])), strict=True):
        ids = c.full.encode(text, add_special_tokens=False).ids
        assert struct.pack(f"<{len(ids)}I", *ids) == packed and said.decode() == c.decode(ids)
    assert len(c.known) < 70


def test_ids_round_trip_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "hello there world")], "doc_id long, text string")
    row = bpe.decode(bpe.encode(docs, keep=True)).first()
    assert row.decoded.replace("</w>", "") == "hello there world" and row.n_tokens == len(row.ids)
    assert bpe.encode(docs.limit(0)).count() == 0


def test_decode_of_null_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [5, 6])], "doc_id long, ids array<int>")
    said = {r.doc_id: r.decoded for r in bpe.decode(rows).collect()}
    assert said[1] is None and said[2] == "" and said[3]
