"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Every character n-gram of a word (blanks stand for its ends) has a row of an
embedding table, shared through a hash, so a misspelt or unseen word lies near
the words whose n-grams it has. The rows of a window of words are averaged and
go to a linear softmax; embeddings and softmax learn together. A document is
judged by its worst window, so a long clean text can't hide a short insult:
in training, too, the loss is that of the document's worst window.
Labels are fitted on a bounded sample of the labelled rows (`sample_docs`,
`sample_chars`); scores use the text alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import whole_text

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 17
WINDOW_WORDS = 24
#: A window with fewer n-grams is averaged as if empty ones filled it up to these.
FULL_WINDOW = 120
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Texts are scored in pieces of so many characters at once; a piece ends at a word's end.
PIECE_CHARS = 1 << 20


@dataclass
class Model:
    """slope: for each n-gram bucket, how far its embedding moves the softmax from label 0 to 1."""

    slope: np.ndarray
    bias: float
    scale: float
    shift: float
    base: float


def features(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket, word number) of every n-gram of the text's words; number of words. A word said again at once counts once."""
    words = [w for w, _ in groupby(text.lower().split())]
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    code = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    blank = code == 32
    word = np.cumsum(blank) - 1
    last = np.maximum.accumulate(np.where(blank, np.arange(len(code)), -1))
    found, at = [], []
    with np.errstate(over="ignore"):
        rolled = code.copy()
        for n in range(2, SIZES[-1] + 1):
            if n > len(code):
                break
            rolled = rolled[:-1] * MIX + code[n - 1 :]
            if n < SIZES[0]:
                continue
            start = np.arange(len(rolled))
            # no blank strictly inside
            good = np.flatnonzero(last[n - 2 : n - 2 + len(rolled)] <= start)
            mixed = (rolled[good] ^ (rolled[good] >> np.uint64(29))) * MIX
            found.append((mixed >> np.uint64(64 - 17)).astype(np.int64))
            at.append(word[good + 1] - blank[good + 1])
    return np.concatenate(found), np.clip(np.concatenate(at), 0, len(words) - 1), len(words)


def windows(word: np.ndarray, n_words: int) -> tuple[np.ndarray, int]:
    """Window number of each n-gram: runs of WINDOW_WORDS words, the last one takes a short rest too."""
    n = max(1, n_words // WINDOW_WORDS)
    return np.minimum(word // WINDOW_WORDS, n - 1), n


def window_means(model: Model, text: str) -> np.ndarray:
    bucket, word, n_words = features(text)
    if not n_words:
        return np.zeros(1)
    window, n = windows(word, n_words)
    total = np.bincount(window, model.slope[bucket], n)
    return total / np.maximum(np.bincount(window, minlength=n), FULL_WINDOW)


def pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE_CHARS:
        end = at + PIECE_CHARS
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def score(model: Model, text: str) -> float:
    """0 to 1, higher if label 1 is likelier; a text without words has none and gets at most the share of label 1 among the rows learnt from."""
    worst = max(window_means(model, p).max() for p in pieces(text))
    p = float(1 / (1 + np.exp(-(model.scale * (worst + model.bias) + model.shift))))
    return p if text.strip() else min(p, model.base)


def train(texts: list[str], labels: np.ndarray, dim: int = 8, epochs: int = 8, rate: float = 0.5, seed: int = 7) -> Model:
    """Adagrad on the worst window of each document; the last fifth of the rows sets scale and shift."""
    rnd = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float64)
    if not len(texts) or labels.min() == labels.max():
        p = float(np.clip(labels.mean() if len(texts) else 0.1, 0.01, 0.99))
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log(p / (1 - p))), p)
    sets = []
    for text in texts:
        bucket, word, n_words = features(text)
        window, n = windows(word, n_words) if n_words else (word, 1)
        order = np.argsort(window, kind="stable")
        ends = np.searchsorted(window[order], np.arange(n + 1))
        sets.append((bucket[order].astype(np.int32), ends))
    table = rnd.normal(0, 0.05, (BUCKETS, dim))
    out = rnd.normal(0, 0.05, (dim, 2))
    bias = np.array([0.0, np.log(labels.mean() / (1 - labels.mean()))])
    table_g, out_g, bias_g = np.full(BUCKETS, 1e-4), np.full((dim, 2), 1e-4), np.full(2, 1e-4)
    n_fit = max(1, int(0.8 * len(texts)))

    def worst(slope: np.ndarray, k: int) -> tuple[float, np.ndarray]:
        bucket, ends = sets[k]
        if not len(bucket):
            return 0.0, bucket
        sums = np.concatenate([[0.0], np.cumsum(slope[bucket])])
        means = (sums[ends[1:]] - sums[ends[:-1]]) / np.maximum(ends[1:] - ends[:-1], FULL_WINDOW)
        at = int(means.argmax())
        return float(means[at]), bucket[ends[at] : ends[at + 1]]

    for epoch in range(epochs):
        order = rnd.permutation(n_fit)
        for start in range(0, n_fit, 32):
            slope = table @ (out[:, 1] - out[:, 0])
            g_out, g_bias = np.zeros_like(out), np.zeros(2)
            rows, grads = [], []
            for k in order[start : start + 32]:
                _, bucket = worst(slope, k)
                if epoch < 2 and len(sets[k][0]):  # the first passes look at whole texts
                    bucket = sets[k][0]
                n = max(len(bucket), FULL_WINDOW)
                mean = table[bucket].sum(0) / n
                z = mean @ out + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                d = p - np.array([1 - labels[k], labels[k]])
                g_out += np.outer(mean, d)
                g_bias += d
                if len(bucket):
                    rows.append(bucket)
                    grads.append(np.broadcast_to(out @ d / n, (len(bucket), dim)))
            g_out /= 32
            g_bias /= 32
            out_g += g_out**2
            bias_g += g_bias**2
            if rows:
                row, grad = np.concatenate(rows), np.concatenate(grads)
                unique, inverse = np.unique(row, return_inverse=True)
                g = np.stack([np.bincount(inverse, grad[:, j], len(unique)) for j in range(dim)], 1)
                table_g[unique] += (g**2).mean(1)
                table[unique] -= rate * g / np.sqrt(table_g[unique])[:, None]
            out -= rate * 0.2 * g_out / np.sqrt(out_g)
            bias -= rate * 0.2 * g_bias / np.sqrt(bias_g)
    slope = (table @ (out[:, 1] - out[:, 0])).astype(np.float32)
    model = Model(slope, float(bias[1] - bias[0]), 1.0, 0.0, float(labels.mean()))
    held = range(n_fit, len(texts)) if len(texts) - n_fit >= 50 and 0 < labels[n_fit:].sum() < len(texts) - n_fit else range(len(texts))
    x = np.array([worst(slope, k)[0] + model.bias for k in held])
    y = labels[list(held)]
    a, b = 1.0, 0.0
    for _ in range(300):  # logistic calibration, with a pull towards a = 1
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * x).sum() + 0.1 * (a - 1), (p - y).sum()])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = max(0.05, a - 0.5 * step[0]), b - 0.5 * step[1]
    return Model(slope, model.bias, a, b, model.base)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_docs: int, sample_chars: int) -> DataFrame:
    """A bounded set of labelled rows, by a hash of their ids; longer texts than sample_chars aren't learnt from. If an id stands on several rows, one of them is."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", "toxic").where(fold != 2).dropDuplicates(["doc_id"])
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = docs.select("doc_id", whole_text().alias("text")).where(F.length("text") <= sample_chars)
    found = rows.join(F.broadcast(chosen), "doc_id")  # at most sample_docs ids
    return found.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 4000, sample_chars: int = 10_000) -> Model:
    """Trains in one task, on the bounded sample; only the model comes to the driver."""

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["text", "toxic"], key=lambda s: s.map(lambda t: zlib.crc32(str(t).encode("utf-8", "replace"))), kind="stable")
        m = train(list(rows["text"]), rows["toxic"].to_numpy())
        return pd.DataFrame([(m.slope.tobytes(), m.bias, m.scale, m.shift, m.base)], columns=["slope", "bias", "scale", "shift", "base"])

    sample = labelled_sample(docs, labels, sample_docs, sample_chars)
    rows = sample.groupBy().applyInPandas(learn, "slope binary, bias double, scale double, shift double, base double").collect()
    if not rows:
        return train([], np.zeros(0))
    r = rows[0]
    return Model(np.frombuffer(bytes(r.slope), np.float32), r.bias, r["scale"], r["shift"], r["base"])


def with_scores(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All rows of docs and a column with the score; null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS numbers

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([score(shared.value, t) for t in texts], dtype="float64")

    return docs.withColumn(name, scored(whole_text()))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Held-out rows, by a hash of the id, aren't learnt from; null ids are never held out."""
    scored = with_scores(docs.select("doc_id", "text"), fit(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
