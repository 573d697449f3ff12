import hashlib
import random
import re

from lectern.llm import substring_dedup


def brute(rows, window):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if d is not None:
                first[key] = min(d, first.get(key, d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((-1 if d is None else d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def make(seed, n=120):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["é", "the", "of"]) if rnd.random() < 0.3 else "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 5)))
    passages = [[word() for _ in range(rnd.randint(10, 60))] for _ in range(8)]
    rows = [(None, " ".join(passages[0])), (3, None), (4, "")]
    for i in range(n):
        words = [word() for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 2)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 2)
            at = rnd.randint(0, len(words))
            words[at:at] = p[a : a + rnd.randint(8, 60)]
        if rnd.random() < 0.15 and i:
            words = rows[-1][1].split()
        rows.append((rnd.randint(0, 100) if rnd.random() < 0.1 else 200 + i, rnd.choice((" ", "\n", "  ")).join(words)))
    rows.append(rows[-1])
    rows.append((500, "x y " * 40))
    rows.append((501, "y x " * 40))
    rnd.shuffle(rows)
    return rows


def test_rows_equal_brute_force(spark):
    for seed, window in ((1, 13), (2, 4)):
        rows = make(seed)
        docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_words int").repartition(4)
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeats(docs, window).collect())
        assert got == brute(rows, window)


def test_kept_text_and_empty_table(spark):
    a = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, a), (2, "head " + a + " tail")], "doc_id long, text string")
    row = substring_dedup.repeats(docs, keep=True).where("doc_id = 2").first()
    assert row.kept == "head tail" and row.removed == [[1, 31]]
    assert substring_dedup.repeats(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    rnd = random.Random(5)
    words = [f"w{rnd.randint(0, 10**9)}" for _ in range(120_000)]
    long = "y" * 20_000
    rows = [(1, " ".join(words)), (2, " ".join(["head", *words[70_000:], "tail"])), (3, " ".join([long, *words[:12]])), (4, " ".join([*words[20:32], long]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.n_removed for r in substring_dedup.repeats(docs).collect()}
    assert got == {1: 0, 2: 50_000, 3: 0, 4: 0}
