import hashlib
import random
import re
import struct

import xxhash

from lectern.llm import simhash


def fingerprint(text):
    hashed = lambda numbers, seed: seed if not numbers else hashed(numbers[1:], xxhash.xxh64_intdigest(struct.pack("<Q", numbers[0]), seed))
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    runs = [words[i : i + 5] for i in range(max(1, len(words) - 4))] if words else []
    votes = [0] * 128
    for run in runs:
        low = hashed(run, 42)
        high = xxhash.xxh64_intdigest(struct.pack("<Q", low), xxhash.xxh64_intdigest(struct.pack("<i", 2), 42))
        for k in range(128):
            votes[k] += ((low if k < 64 else high) >> (k % 64)) & 1
    return sum(1 << k for k in range(128) if 2 * votes[k] > len(runs))


def test_rows_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6)))
    rows = [(7 * i * i, " ".join(word() for _ in range(rnd.choice((0, 1, 3, 4, 5, 30, 200))))) for i in range(80)]
    rows += [(7 * 81 * 81, rows[0][1]), (10**12, None), (10**12 + 1, "x  y\tz\n" * 50)]
    rows += [(-(2**63) + 5, "far below"), (2**63 - 1, "far above far above far above")]
    keep = rows[:]
    monkeypatch.setattr(simhash, "BLOCK_DOCS", 16)
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, print string").repartition(3)
    got = {r.doc_id: r for r in simhash.edited(docs).collect()}
    keep.sort()
    for k, (i, t) in enumerate(keep):
        t, after = t or "", keep[(k + 1) % len(keep)][1] or ""
        n = len(t) // 4
        e = t[: len(t) - n] + after[:n]
        a, b, c = fingerprint(t), fingerprint(e), fingerprint(after)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (f"{a:032x}", f"{b:032x}")
        near = sum((a ^ fingerprint(x or "")).bit_count() <= 3 for _, x in keep) - 1
        assert r.n_near == (near if i % 20 == 0 else None)
        assert r.near_edited == 1 - (a ^ b).bit_count() / 128 and r.near_next == 1 - (a ^ c).bit_count() / 128


def test_nulls_repeats_one_row_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "p q"), (1, "p q"), (2, None)], "doc_id long, text string")
    rows = simhash.edited(docs).collect()
    assert sorted(r.near_next for r in rows if r.doc_id == 1)[1] == 1.0
    assert len(rows) == 5 and [r.near_next for r in rows if r.doc_id is None] == [None, None]
    assert len({r.fingerprint for r in rows}) == 3
    one = simhash.edited(docs.where("doc_id = 2")).first()
    assert (one.n_chars, one.near_edited, one.near_next) == (0, 1.0, 1.0)
    assert simhash.edited(docs.limit(0)).count() == 0


def test_very_long_text_and_order_of_words(spark):
    text = " ".join(f"w{i % 997}" for i in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, " ".join(reversed(text.split()))), (3, text)], "doc_id long, text string")
    prints = {r.doc_id: r.fingerprint for r in simhash.edited(docs).collect()}
    assert prints[1] == prints[3] == f"{fingerprint(text):032x}" and prints[2] != prints[1]


def test_radius_search_equals_brute_force(spark):
    rnd = random.Random(6)
    prints = [rnd.getrandbits(128) for _ in range(20)]
    for p in prints[:10]:
        for _ in range(12):
            for _ in range(rnd.randint(0, 5)):
                p ^= 1 << rnd.randrange(128)
            prints.append(p)
    for hot in (200, 3):
        simhash.HOT_BLOCK = hot
        got = {(r.a, r.b, r.apart) for r in simhash.within_radius(spark.createDataFrame([(f"{p:032x}",) for p in prints], "fingerprint string"), 3).collect()}
        own = sorted({f"{p:032x}" for p in prints})
        want = {(a, b, n) for i, a in enumerate(own) for b in own[i + 1 :] if (n := (int(a, 16) ^ int(b, 16)).bit_count()) <= 3}
        assert got == want
    simhash.HOT_BLOCK = 200
