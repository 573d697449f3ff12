import hashlib
import random

import numpy as np

from lectern.llm import suffix_dedup


def test_suffix_array_equals_sorting():
    rnd = random.Random(1)
    for _ in range(300):
        n, k = rnd.randint(0, 90), rnd.choice((1, 2, 4, 200))
        t = np.array([rnd.randint(1, k) for _ in range(n)], np.int64)
        assert suffix_dedup.suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
    t = np.tile(np.array([3, 9, 3, 3, 7], np.int64), 400)
    assert suffix_dedup.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def brute(rows):
    first = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for p in range(len(b) - 99 if d is not None else 0):
            s = b[p : p + 100]
            first[s] = min(first.get(s, (d, p)), (d, p))
    out = []
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99 if d is not None else 0):
            if first[b[p : p + 100]] < (d, p):
                gone[p : p + 100] = True
        edges = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out.append((-1 if d is None else d, len(b), int(gone.sum()), edges, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def make(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rnd.randint(15, 90)) for _ in range(6)]
    rows = [(None, passages[0]), (1, None), (2, ""), (3, "a" * 500), (4, "ab" * 300 + "x" + "ab" * 300)]
    for i in range(90):
        t = text(rnd.randint(0, 40))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 2)
            piece = list(p[a : a + rnd.randint(60, 400)])
            if rnd.random() < 0.3:
                piece[len(piece) // 2] = "#"
            t = t[: len(t) // 2] + "".join(piece) + t[len(t) // 2 :]
        if rnd.random() < 0.15:
            t = rows[-1][1]
        rows.append((10 + i, t))
    rows += [rows[-1], (200, rows[40][1] + rows[41][1] + rows[40][1])]
    rnd.shuffle(rows)
    return rows


def test_rows_equal_brute_force(spark, monkeypatch):
    for seed, hot in ((1, 4000), (2, 2)):
        monkeypatch.setattr(suffix_dedup, "HOT_ANCHOR", hot)
        monkeypatch.setattr(suffix_dedup, "BUCKET", 2000)
        rows = make(seed)
        docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, lo int").repartition(3)
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeats(docs).collect())
        assert got == brute(rows)
    assert suffix_dedup.repeats(docs.limit(0)).count() == 0


def test_long_text_in_pieces(spark):
    rnd = random.Random(3)
    a = "".join(rnd.choice("abcdefgh ") for _ in range(700_000))
    docs = spark.createDataFrame([(1, a + a[5000:9000])], "doc_id long, text string")
    row = suffix_dedup.repeats(docs, keep=True).first()
    assert (row.n_removed, row.n_spans, bytes(row.kept)) == (4000, 1, a.encode())


def test_a_batch_without_repeats_of_its_own(spark):
    none = np.zeros(0, np.int64)
    assert not len(suffix_dedup._ranges(none, none, none, none))
    rnd = random.Random(9)
    a = "".join(rnd.choice("abcdefgh ") for _ in range(400))
    docs = spark.createDataFrame([(1, "x" + a), (2, a + "y")], "doc_id long, text string").repartition(2, "doc_id")
    assert {r.doc_id: r.n_removed for r in suffix_dedup.repeats(docs).collect()} == {1: 0, 2: 400}


def test_one_id_on_rows_with_different_texts(spark):
    rnd = random.Random(12)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    p, a, q = text(400), text(300), text(250)
    rows = [(1, p), (5, p), (5, a), (5, q + p[:150]), (5, a), (6, a + q), (6, q + a), (7, p[50:300]), (None, p), (7, None)]
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeats(docs).collect())
        assert got == brute(rows)
