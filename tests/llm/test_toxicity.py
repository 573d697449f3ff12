import random

import numpy as np

from lectern.llm import toxicity


def corpus(n, seed, bad=("zorkel", "blaxxing")):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("aeiorstnl") for _ in range(rnd.randint(2, 7)))
    texts, labels = [], []
    for _ in range(n):
        words = [word() for _ in range(rnd.randint(5, 120))]
        y = rnd.random() < 0.3
        for _ in range(rnd.randint(1, 3) * y):
            words[rnd.randrange(len(words))] = rnd.choice(bad)
        texts.append(" ".join(words))
        labels.append(int(y))
    return texts, np.array(labels)


def test_held_out_accuracy_and_misspellings():
    model = toxicity.train(*corpus(600, 1))
    texts, labels = corpus(300, 2)
    p = np.array([toxicity.score(model, t) for t in texts])
    assert ((p >= 0.3) == labels).mean() > 0.95
    assert toxicity.score(model, "the sand is zorkell here again") > toxicity.score(model, "the sand is smooth here again")
    assert 0 <= toxicity.score(model, "") <= 1
    assert toxicity.score(model, " ".join(corpus(40, 5, ("a",))[0]) + " zorkel") > 0.3


def test_rows(spark):
    texts, labels = corpus(120, 4)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)] + [(None, "zorkel", 0.1), (500, None, 0.2), (0, texts[0], 0.5)], "doc_id long, text string, score double")
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.classify(docs, marks).collect()
    assert len(rows) == 123 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert toxicity.classify(docs, marks.limit(0)).count() == 123
    assert toxicity.classify(docs.limit(0), marks).count() == 0


def plain_score(model, text):
    """The score by loops over words and their n-grams."""
    words = text.lower().split()
    words = [w for i, w in enumerate(words) if i == 0 or w != words[i - 1]]
    mask, mix = (1 << 64) - 1, int(toxicity.MIX)
    n = max(1, len(words) // toxicity.WINDOW_WORDS)
    sums, counts = [0.0] * n, [0] * n
    for i, w in enumerate(words):
        at = min(i // toxicity.WINDOW_WORDS, n - 1)
        for size in toxicity.SIZES:
            for k in range(len(w) + 3 - size):
                h = 0
                for c in f" {w} "[k : k + size]:
                    h = (h * mix + ord(c)) & mask
                h = ((h ^ (h >> 29)) * mix) & mask
                sums[at] += float(model.slope[h >> 47])
                counts[at] += 1
    worst = max(s / max(c, toxicity.FULL_WINDOW) for s, c in zip(sums, counts, strict=True))
    p = 1 / (1 + np.exp(-(model.scale * (worst + model.bias) + model.shift)))
    return p if words else min(p, model.base)


def test_scores_equal_plain_loops():
    model = toxicity.train(*corpus(200, 1))
    for text in [*corpus(40, 9)[0], "", " \n", "a", "é ü zorkel zorkel zorkel", "one two " * 30]:
        assert abs(toxicity.score(model, text) - plain_score(model, text)) < 1e-6, text


def test_very_long_text_is_judged_whole():
    model = toxicity.train(*corpus(600, 1))
    clean = " ".join(corpus(1, 5, ("a",))[0] * 6000)
    assert len(clean) > toxicity.PIECE_CHARS and toxicity.score(model, clean) < 0.3 <= toxicity.score(model, clean + " zorkel blaxxing zorkel")
