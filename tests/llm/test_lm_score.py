import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import lm_score, recurrent


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_base_score_and_gain(spark, monkeypatch):
    rnd = random.Random(5)
    tongues = [["".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(1, 6))) for _ in range(200)] for _ in range(3)]
    rows = []
    for i in range(260):
        own = rnd.choice(tongues)
        words = [rnd.choice(own[:20] if rnd.random() < 0.6 else own) if rnd.random() < 0.9 else f"R{rnd.randrange(400)}é" for _ in range(rnd.randint(0, 120))]
        rows.append((i, " ".join(words)))
    rows += [(1000, None), (1001, "  "), (None, "Abc abc"), (5, rows[5][1]), (1003, rows[3][1])]
    monkeypatch.setattr(lm_score, "HEAD_WORDS", 300)
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    got = lm_score.score(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter()
    for i, t in rows:
        if not held(i):
            count.update(split(t))
            count[None] += 1
    n, v = sum(count.values()), len(count)
    texts = {(i, t): split(t) for i, t in rows}
    assert len(got) == len(rows)
    by_id = {i: w for (i, _), w in texts.items()}
    gain = 0
    for r in got:
        words = [*by_id[r.doc_id], None]
        want = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert r.held_out == held(r.doc_id) and r.n_tokens == len(words) and r.train_tokens == n
        assert r.n_known == sum(count[w] > 0 for w in words) and abs(r.base_score - want) < 1e-6 * max(1, abs(want))
        assert r.score < 0
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0
    assert lm_score.score(docs.limit(0)).count() == 0


def test_model_is_a_distribution_and_lanes_dont_matter():
    rnd = np.random.default_rng(2)
    w = recurrent.start(rnd, np.ones(recurrent.SYMBOLS))
    head = [7, 900, 33]
    alone = np.exp(recurrent.log_likelihood(w, [np.array([*head, s]) for s in range(recurrent.SYMBOLS)]) - recurrent.log_likelihood(w, [np.array(head)]))
    assert abs(alone.sum() - 1) < 1e-3
    docs = [rnd.integers(0, recurrent.SYMBOLS, n) for n in (300, 5, 1, 77, 64)]
    assert np.allclose(recurrent.log_likelihood(w, docs), [recurrent.log_likelihood(w, [d])[0] for d in docs], rtol=1e-4)


def test_gradients_equal_differences():
    rnd = np.random.default_rng(0)
    docs = [rnd.integers(0, recurrent.SYMBOLS, n) for n in (5, 9, 1, 12)]
    w = {k: x.astype(np.float64) for k, x in recurrent.start(rnd, np.ones(recurrent.SYMBOLS)).items()}
    w = {k: x + rnd.normal(0, 0.1, x.shape) for k, x in w.items()}
    window = next(iter(recurrent._windows(*recurrent.lanes(docs, 2))))
    h = rnd.normal(0, 0.5, (2, recurrent.HIDDEN)).astype(np.float32)
    g, _, _, n = recurrent._gradients(w, *window, h)
    for k in ("u", "out_class", "bias_class"):
        at = tuple(rnd.integers(s) for s in w[k].shape)
        own, w[k][at] = w[k][at], w[k][at] + 1e-3
        high = recurrent._gradients(w, *window, h)[2]
        w[k][at] = own - 1e-3
        low = recurrent._gradients(w, *window, h)[2]
        w[k][at] = own
        assert abs(g[k][at] - (high - low) / 2e-3 / n) < 1e-3


def test_every_training_row_is_learnt_from(spark, monkeypatch):
    rnd = random.Random(8)
    own = [f"w{k}" for k in range(60)]
    chain = lambda n: " ".join(own[(s + 7 * k) % 60] for s in [rnd.randrange(60)] for k in range(n))
    docs = spark.createDataFrame([(i, chain(150)) for i in range(400)], "doc_id long, text string").repartition(4)
    monkeypatch.setattr(lm_score, "TASK_WORDS", 20_000)
    documents, words = docs.count(), lm_score.word_counts(docs)
    counts = lm_score.summarize(words, documents)
    first = lm_score.train(docs, counts, documents, 3, 450)
    weights = lm_score.learn(docs, counts, first)
    texts = [lm_score.symbols(counts, h)[0] for h in lm_score._texts([chain(150) for _ in range(40)])[1]]
    assert recurrent.log_likelihood(weights, texts).sum() > recurrent.log_likelihood(first, texts).sum()
    assert all((weights[k] != first[k]).any() for k in recurrent.NAMES)


def test_texts_without_open_words_are_not_one_task(spark):
    """Words that are all settled leave no key for the join of the others: these rows stay where they are."""
    docs = spark.createDataFrame([(i, "the same few words again") for i in range(400)], "doc_id long, text string").repartition(4)
    rows = lm_score.score(docs)
    assert rows.count() == 400 and rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_first_sample_comes_from_anywhere_in_long_texts(spark):
    """A text far longer than the whole sample gives pieces from all over it, whole words only; copies give each piece once."""
    rnd = random.Random(3)
    long = " ".join(f"w{k}" for k in range(90_000))
    docs = spark.createDataFrame([(1, long), (1, long), (2, long), (3, ""), (4, "x" * 50_000)] + [(10 + i, f"short{rnd.random()}") for i in range(50)], "doc_id long, text string")
    got = [r.text for r in lm_score.sampled(docs, 270_052, 60, 9000).collect()]
    known = set(long.split())
    own = [w for t in got for w in t.split() if w.startswith("w")]
    assert len(set(own)) == len(own) and set(own) <= known and 500 < len(own) < 15_000
    places = sorted(int(w[1:]) for w in own)
    assert places[0] < 30_000 and places[-1] > 60_000
    assert lm_score.sampled(docs.limit(0), 0, 60, 9000).count() == 0


def test_very_long_text(spark):
    rnd = random.Random(6)
    words = [f"v{rnd.randrange(500)}" for _ in range(60_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "v1 v2"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.score(docs).collect()}
    count = Counter(words + ["v1", "v2"] + [None] * 3)
    n, v = sum(count.values()), len(count)
    want = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words, None])
    assert got[1].n_tokens == got[1].n_known == 60_001 and abs(got[1].base_score - want) < 1e-6 * abs(want)
    assert got[1].score < 0 and got[3].n_tokens == 1


def test_arrays_follow_the_words():
    """A text far longer than all others made every lane as long as itself; and a task that learns holds enough words that lanes don't wait for its longest text."""
    docs = [np.zeros(100_000, np.int16)] + [np.zeros(50, np.int16)] * 300
    symbols, owner = recurrent.lanes(docs, recurrent.LANES)
    assert symbols.size == owner.size <= 5 * sum(map(len, docs)) and (owner >= 0).sum() == sum(map(len, docs))
    assert lm_score.LEARN_WORDS >= 20_000 * lm_score.LEARN_LANES


def test_arrays_that_are_used_again_change_nothing():
    """Windows of several sizes one after the other give what each gives alone; logits that exp can't hold are met as well."""
    rnd = np.random.default_rng(4)
    docs = [rnd.integers(0, recurrent.SYMBOLS, n) for n in (150, 40, 7, 90)]
    w = recurrent.start(rnd, np.ones(recurrent.SYMBOLS))
    w = {k: (x + rnd.normal(0, 0.1, x.shape)).astype(np.float32) for k, x in w.items()}
    space = recurrent.Space()
    for before, fresh, target, own in recurrent._windows(*recurrent.lanes(docs, 4)):
        active = (own >= 0).any(0)
        window, h = [x[:, active] for x in (before, fresh, target, own)], np.zeros((active.sum(), recurrent.HIDDEN), np.float32)
        again, alone = recurrent._gradients(w, *window, h, space), recurrent._gradients(w, *window, h)
        assert all((again[0][k] == alone[0][k]).all() for k in w if k != "table") and (again[0]["table"][1] == alone[0]["table"][1]).all() and (again[1] == alone[1]).all()
    wild = {k: x * np.float32(3000 if k.startswith("out") else 1) for k, x in w.items()}
    got = recurrent.log_likelihood(wild, docs)
    assert np.isfinite(got).all() and np.allclose(got, recurrent.log_likelihood({k: x.astype(float) for k, x in wild.items()}, docs), rtol=1e-3)
