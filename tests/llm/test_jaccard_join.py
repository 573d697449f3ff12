import random
import re

from lectern.llm import hashing, jaccard_join
from lectern.llm.graph import components


def brute(rows, k, percent):
    sets = {}
    for doc_id, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        sets[doc_id] = {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def make(seed, n=150):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "An", "in"]) if rnd.random() < 0.3 else "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 6)))
    texts = [None, "", " \t", "One", "one", "two words", "Two  WORDS", "É x y z"]
    line = " ".join(word() for _ in range(12))
    bases = [[word() for _ in range(rnd.randint(3, 220))] for _ in range(12)]
    while len(texts) < n:
        words = list(rnd.choice(bases)) if rnd.random() < 0.8 else [word() for _ in range(rnd.randint(1, 120))]
        for _ in range(rnd.choice((0, 0, 1, 1, 2, 3, 4, 6))):
            words[rnd.randrange(len(words))] = word()
        texts.append(" ".join(words) + ("\n" + line if rnd.random() < 0.3 else ""))
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def test_components_equal_brute_force(spark):
    for seed, percent, k in ((1, 90, 3), (2, 80, 5)):
        rows = make(seed)
        docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string").repartition(3)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.connected(docs, k, percent).collect()}
        assert got == brute(rows, k, percent)


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, None), (5, "a b c d"), (5, "a b c d"), (5, "p q r s"), (7, "p q r s"), (9, "x")], "doc_id long, text string")
    rows = sorted(((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard_join.connected(docs).collect()))
    assert rows == [(-1, 0, -1), (-1, 2, -1), (5, 2, 5), (5, 2, 5), (5, 2, 5), (7, 2, 5), (9, 1, 9)]
    assert jaccard_join.connected(docs.limit(0)).count() == 0


def test_frequent_list_holds_no_small_groups(spark):
    """Copies that stand together are frequent in their batch but not among all documents."""
    rows = [(i, f"a b c d{i // 12} e{i // 12} f{i // 12}") for i in range(15_600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    _, frequent = jaccard_join.shingle_order(docs, 3)
    assert len(frequent) == 1


def test_components_of_chains_stars_and_hubs(spark):
    rnd = random.Random(2)
    chain = [(i, i + 1) for i in range(2000)]
    mixed = list(range(5000, 7000))
    rnd.shuffle(mixed)
    edges = chain + list(zip(mixed, mixed[1:], strict=False)) + [(9000 + i, 8999) for i in range(1, 800)] + [(i, 20_000) for i in range(10_000, 10_500)] + [(3, 3), (None, 4), (5, None)]
    rounds = []
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), rounds).collect()}
    want = {i: 0 for i in range(2001)} | {i: 5000 for i in mixed} | {i: 8999 for i in range(8999, 9800) if i != 9000} | {i: 10_000 for i in [*range(10_000, 10_500), 20_000]}
    assert got == want and len(rounds) < 20
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_words_differ_wherever_they_differ():
    word = bytearray(b"ab" * 2500)
    word[10], word[10 + 4096] = 120, 121
    other = bytearray(word)
    other[10], other[10 + 4096] = 121, 120
    a, b = (next(hashing.word_hashes([bytes(w)])) for w in (word, other))
    assert a[0] != b[0] and a[0] == next(hashing.word_hashes([b"x " + bytes(word)]))[1]


def test_very_long_texts_and_templates(spark):
    """A template that a third of the rows share, with few words of their own; and a text of 60,000 words with its copy."""
    rnd = random.Random(7)
    template = [f"t{i}" for i in range(30)]
    rows = [(i, " ".join(template + [f"own{i}_{j}" for j in range(i % 5)])) for i in range(120)]
    long = [f"w{rnd.randint(0, 900)}" for _ in range(60_000)]
    rows += [(1000, " ".join(long)), (1001, " ".join([*long[:30_000], "changed", *long[30_000:]]))] + [(2000 + i, f"alone {i} x{i} y{i} z{i}") for i in range(200)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, set_key int").repartition(5)
    for k, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.connected(docs, k, percent).collect()}
        assert got == brute(rows, k, percent)


def test_short_sets_without_links_make_no_pairs(spark):
    """Short texts over few words share prefixes by the hundred, yet no two of one size can link: lists give no pair for them."""
    rnd = random.Random(9)
    sets = [(t, 0, n, i, i) for i, (t, n) in enumerate((rnd.randrange(5), rnd.randint(5, 9)) for _ in range(400))]
    rows = spark.createDataFrame([(*r, *[0] * jaccard_join.FOLDED_WORDS) for r in sets], "token long, place int, n long, doc_id long, label long, " + ", ".join(f"{f} long" for f in jaccard_join.FOLDED))
    assert jaccard_join._apart_in_lists(rows, 90).count() == 0
    texts = list({" ".join(rnd.choice("abcdef") for _ in range(rnd.randint(3, 22))): None for _ in range(250)})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for k, percent in ((1, 80), (3, 80), (3, 90)):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.connected(docs, k, percent).collect()} == brute(list(enumerate(texts)), k, percent)
