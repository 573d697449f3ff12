"""Language-model scores: a smoothed unigram base over all training text, and a gated recurrent model.

Words are counted over every training document. The commonest words (a bounded
table) go to the scoring tasks; a rarer word of a training document that a
filter of the repeated words doesn't hold has the count 1, one of a held-out
document that a filter of all words doesn't hold has 0; the few words that this
leaves open are joined with their counts. The recurrent model (`recurrent`)
knows the commonest words as symbols; the other words stand for 32 rare-word
symbols by their last byte, and within such a symbol a word has its smoothed
share of the training counts, so the probabilities of all words sum to one.
It starts from weights learnt in one task from pieces anywhere in the texts (about
`sample_docs` of them with `sample_words` words) and then learns from every training document: in each of ROUNDS
rounds every partition goes on from the same weights over its own documents of
that round, and the weights are averaged by the words they have seen. Counts,
score and state cover whole documents. Words are told apart by hashes of 59
bits and their last byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import recurrent
from lectern.llm.bloom import filters, holds, size_for
from lectern.llm.common import checkpointed, dropped, whole_text, with_struct
from lectern.llm.hashing import BLANK, lower_ascii, word_hashes

ADD = 0.1
#: Most words in the table that goes to every task.
HEAD_WORDS = 150_000
RARE = recurrent.CLASS_WORDS
END = RARE
#: Each training document is learnt from in one of so many rounds.
ROUNDS = 2
RATE = 0.003
#: A task learns from about so many words at once, and from so many in all at least if the input has them. With fewer at once, most lanes would
#: have ended while the longest text goes on.
LEARN_WORDS, TASK_WORDS = 2_000_000, 500_000
LEARN_LANES = 96
#: Weights travel in so many pieces, so that their average spreads.
PIECES = 256
KNOWN = recurrent.SYMBOLS - RARE - 1


def held_out(doc_id: Column) -> Column:
    """One of ten ids by a hash; rows without an id are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


@dataclass
class Counts:
    words: np.ndarray  # sorted hashes of the commonest words
    count: np.ndarray
    symbol: np.ndarray  # of each of them: KNOWN symbols, or -1
    repeated: np.ndarray  # filter of other words with a count over 1
    seen: np.ndarray  # filter of all other words
    total: int
    distinct: int
    rare_mass: np.ndarray  # smoothed count of all words under each rare-word symbol
    frequency: np.ndarray  # of symbols


def _texts(texts: pd.Series) -> tuple[list[bytes], list[np.ndarray]]:
    """The texts as bytes, and the id of each of their words: a hash whose lowest bits are the word's rare-word symbol."""
    data = [lower_ascii(t) for t in texts]
    low = np.uint64(RARE - 1)
    return data, [(h & ~low) | _last_bytes(d).astype(np.uint64) for d, h in zip(data, word_hashes(data), strict=True)]


def _last_bytes(data: bytes) -> np.ndarray:
    """The rare-word symbol of each word: its last byte modulo RARE."""
    b = np.frombuffer(data, np.uint8)
    last = ~BLANK[b]
    last[:-1] &= BLANK[b[1:]]
    return (b[last] % RARE).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """h, n of all words of docs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            _, hashes = _texts(batch["text"])
            h, n = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]), return_counts=True)
            yield pd.DataFrame({"h": h.astype(np.int64), "n": n})

    return docs.mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def summarize(words: DataFrame, documents: int) -> Counts:
    sizes = words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toPandas()  # a row for each different count
    least = 1
    inside = np.cumsum(sizes["words"].to_numpy()) <= HEAD_WORDS
    if not inside.all():
        least = int(sizes["n"][inside].min()) if inside.any() else int(sizes["n"].max()) + 1
    head = words.where(F.col("n") >= least).toPandas().sort_values("h", key=lambda s: s.to_numpy(np.int64).view(np.uint64))
    tail = words.where(F.col("n") < least)
    rest = int(sizes["words"].sum()) - len(head)
    repeated, seen = filters(tail, size_for(rest), repeated=F.col("n") > 1, seen=F.lit(True))
    masses = words.groupBy(F.col("h").bitwiseAND(F.lit(RARE - 1)).alias("rare")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).toPandas()
    mass, count = np.full(RARE, ADD), np.zeros(RARE)
    mass[masses["rare"].to_numpy(np.int64)] += masses["n"].to_numpy(float) + ADD * masses["words"].to_numpy(float)
    count[masses["rare"].to_numpy(np.int64)] += masses["n"].to_numpy(float)
    h, n = head["h"].to_numpy(np.int64).view(np.uint64), head["n"].to_numpy(np.int64)
    rare = (h % np.uint64(RARE)).astype(np.int64)
    top = np.lexsort((h, -n))[:KNOWN]
    symbol = np.full(len(h), -1, np.int64)
    symbol[top] = END + 1 + np.arange(len(top))
    np.subtract.at(mass, rare[top], n[top] + ADD)
    np.subtract.at(count, rare[top], n[top])
    frequency = np.zeros(recurrent.SYMBOLS)
    frequency[:RARE], frequency[END], frequency[symbol[top]] = np.maximum(count, 0), documents, n[top]
    total = int(masses["n"].sum()) + documents if len(masses) else documents
    distinct = int(sizes["words"].sum()) + (documents > 0)
    return Counts(h, n, symbol, repeated, seen, total, distinct, np.maximum(mass, ADD), frequency)


def symbols(counts: Counts, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols with the end, rare-word symbol of each word or -1, count of each word or -1)."""
    if not len(h):
        return np.array([END]), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(counts.words):
        at = np.minimum(np.searchsorted(counts.words, h), len(counts.words) - 1)
        found = counts.words[at] == h
        count, symbol = np.where(found, counts.count[at], -1), np.where(found, counts.symbol[at], -1)
    else:
        count = symbol = np.full(len(h), -1, np.int64)
    rare = np.where(symbol < 0, (h % np.uint64(RARE)).astype(np.int64), -1)
    return np.append(np.where(symbol < 0, rare, symbol), END), rare, count


def sequences(counts: Counts, hashes: list[np.ndarray]) -> list[np.ndarray]:
    """The symbols of each text with its end: what `symbols` gives, from the few words that are symbols alone."""
    own = np.flatnonzero(counts.symbol >= 0)
    words, symbol = counts.words[own], counts.symbol[own]
    out = []
    for h in hashes:
        s = (h % np.uint64(RARE)).astype(np.int64)
        if len(words):
            at = np.minimum(np.searchsorted(words, h), len(words) - 1)
            s = np.where(words[at] == h, symbol[at], s)
        out.append(np.append(s, END))
    return out


def sampled(docs: DataFrame, words: int, pieces: int, sample_words: int) -> DataFrame:
    """text: about so many pieces of docs (of `words` words in all), sample_words in all, each different piece once.

    A hash of the text and the piece's number picks them anywhere in a text, so long texts give as much for
    each of their words as short ones. A piece begins and ends at blanks.
    """
    size = max(200, 6 * sample_words // max(1, pieces))
    share = min(1_000_000, math.ceil(1_000_000 * sample_words / max(1, words)))
    last = F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / size).cast("int")
    # the text's hash is bound to a name, so that a long text isn't hashed again for each of its pieces
    picked = F.transform(F.array(F.xxhash64("text")), lambda h: F.filter(F.sequence(F.lit(0), last), lambda k: F.pmod(F.xxhash64(h, k), F.lit(1_000_000)) < share))[0]

    def piece(k: Column) -> Column:
        opened = F.regexp_replace(F.substring("text", k * size + 1, F.lit(size)), F.when(k > 0, r"^[^\x20\x09-\x0D]+").otherwise("^$"), F.lit(""))
        return F.regexp_replace(opened, F.when(k < last, r"[^\x20\x09-\x0D]+$").otherwise("^$"), F.lit(""))

    return docs.select(F.explode(F.transform(picked, piece)).alias("text")).distinct()


def train(docs: DataFrame, counts: Counts, documents: int, sample_docs: int, sample_words: int) -> dict[str, np.ndarray]:
    """First weights, learnt in one task from a sample of docs: sample_words words in about sample_docs pieces, whatever the input's size."""
    sample = sampled(docs, counts.total - documents, sample_docs, sample_words)
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(rows["text"], key=lambda t: (hash_of(t), t))
        own = [symbols(shared.value, h)[0] for h in _texts(pd.Series(texts, dtype=object))[1]]
        w = recurrent.train(own, shared.value.frequency)
        return pd.DataFrame([[w[k].astype(np.float32).tobytes() for k in recurrent.NAMES]], columns=list(recurrent.NAMES))

    rows = sample.groupBy().applyInPandas(first, ", ".join(f"{k} binary" for k in recurrent.NAMES)).collect()
    like = recurrent.start(np.random.default_rng(3), counts.frequency)
    return {k: np.frombuffer(bytes(rows[0][k]), np.float32).reshape(like[k].shape) for k in recurrent.NAMES} if rows else like


def learn(docs: DataFrame, counts: Counts, weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The weights after every row of docs has been learnt from, by partitions whose weights are averaged after each round."""
    context = docs.sparkSession.sparkContext
    table = context.broadcast(counts)
    tasks = max(1, counts.total // TASK_WORDS)

    def average(rows: pd.DataFrame) -> pd.DataFrame:
        total, words = 0.0, rows["words"].sum()
        for n, part in zip(rows["words"], rows["part"], strict=True):
            total = total + np.frombuffer(part, np.float32).astype(np.float64) * (n / words)
        return pd.DataFrame({"piece": rows["piece"].iloc[:1], "part": [total.astype(np.float32).tobytes()]})

    for turn in range(ROUNDS):
        shared = context.broadcast(weights)

        def walk(batches: Iterator[pd.DataFrame], shared: Broadcast = shared) -> Iterator[pd.DataFrame]:
            adam = recurrent.Adam({k: x.copy() for k, x in shared.value.items()})
            words, own, held = 0, [], 0
            for batch in batches:
                for at in range(0, len(batch), 1000):
                    for sequence in sequences(table.value, _texts(batch["text"].iloc[at : at + 1000])[1]):
                        own.append(sequence.astype(np.int16))
                        held += len(sequence)
                        if held >= LEARN_WORDS:
                            adam.learn(own, RATE, LEARN_LANES)
                            words, own, held = words + held, [], 0
            if own:
                adam.learn(own, RATE, LEARN_LANES)
            if words + held:
                parts = np.array_split(recurrent.flattened(adam.w), PIECES)
                yield pd.DataFrame({"piece": range(PIECES), "words": words + held, "part": [x.tobytes() for x in parts]})

        rows = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == turn).select("text").coalesce(tasks)
        parts = rows.mapInPandas(walk, "piece int, words long, part binary").groupBy("piece").applyInPandas(average, "piece int, part binary").orderBy("piece").collect()  # the weights of one model
        if parts:
            weights = recurrent.shaped(np.concatenate([np.frombuffer(bytes(r["part"]), np.float32) for r in parts]), weights)
    return weights


def hash_of(text: str) -> int:
    h = next(word_hashes([lower_ascii(text)]))
    return int(h[0]) ^ len(h) if len(h) else 0


def score(docs: DataFrame, sample_docs: int = 600, sample_words: int = 250_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; scores are log10 of the text's probability, its end included.

    Null text counts as empty: its only token is the end. Repeated rows count
    as often as they stand, and rows without an id are learnt from. Without
    any training row both models give every token its smoothed share of nothing.
    """
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    learnt = rows.where(~F.col("held_out"))
    documents = learnt.count()
    words = checkpointed(word_counts(learnt))
    counts = summarize(words, documents)
    weights = learn(learnt, counts, train(learnt, counts, documents, sample_docs, sample_words))
    shared = docs.sparkSession.sparkContext.broadcast((counts, weights))
    end = documents + ADD

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        c, w = shared.value
        log_mass = np.log10(c.rare_mass)
        for texts, held in batches:
            _, hashes = _texts(texts)
            out, sequences = [], []
            for h, apart in zip(hashes, held, strict=True):
                sequence, rare, count = symbols(c, h)
                sequences.append(sequence)
                loose = np.flatnonzero(count < 0)
                open_ = holds(c.seen if apart else c.repeated, h[loose])
                count[loose[~open_]] = 0 if apart else 1
                known = count >= 0
                logs = np.log10(count[known] + ADD)
                inside = rare[known] >= 0
                tail = h[loose[open_]].astype(np.int64)
                out.append((len(h) + 1, int((count > 0).sum()), float(logs.sum()), float(logs[inside].sum() - log_mass[rare[rare >= 0]].sum()), tail))
            frame = pd.DataFrame(out, columns=["n_tokens", "known_", "base_", "rare_", "tail_"])
            frame["model_"] = recurrent.log_likelihood(w, sequences) / np.log(10)
            yield frame

    done = with_struct(rows, run, "n_tokens long, known_ long, base_ double, rare_ double, tail_ array<long>, model_ double", "text", "held_out", rows=4000)
    done = checkpointed(done.withColumn("key_", F.when(F.size("tail_") > 0, F.unhex(F.md5(F.concat(F.col("text"), F.col("held_out").cast("string")))))).drop("text"))
    # words whose count isn't settled yet, once for each text
    tails = done.where("key_ is not null").select("key_", "tail_").dropDuplicates(["key_"]).select("key_", F.explode("tail_").alias("h"))
    settled = tails.join(words.select("h", "n"), "h", "left").select("key_", F.coalesce("n", F.lit(0)).alias("n"))
    sums = checkpointed(settled.groupBy("key_").agg(F.sum(F.log10(F.col("n") + ADD)).alias("logs_"), F.count(F.when(F.col("n") > 0, 1)).alias("more_")))
    dropped(words)
    # texts without such words don't meet the join, where their null keys would be one task
    rows = done.where("key_ is not null").join(sums, "key_", "left").unionByName(done.where("key_ is null"), allowMissingColumns=True)
    zero = F.lit(0.0)
    norm = math.log10(counts.total + ADD * (counts.distinct + 1))
    base = F.col("base_") + F.coalesce("logs_", zero) + F.lit(math.log10(end)) - F.col("n_tokens") * F.lit(norm)
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("known_") + F.coalesce("more_", F.lit(0)) + F.lit(int(documents > 0))).alias("n_known"),
        F.lit(counts.total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("model_") + F.col("rare_") + F.coalesce("logs_", zero)).alias("score"),
    )
