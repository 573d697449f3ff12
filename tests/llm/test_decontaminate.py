import random

from lectern.llm import decontaminate


def edit_distance_infix(p, t):
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        new = [0]
        for i, a in enumerate(p, 1):
            new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (a != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_distance_equals_dynamic_programming():
    rnd = random.Random(2)
    for _ in range(300):
        p, t = (bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, n))) for n in (20, 40))
        assert decontaminate.infix_distance(p, t) == edit_distance_infix(p, t)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(15, 60)))) for i in range(40)]
    docs, truth = [], set()
    for d in range(250):
        words = [word() for _ in range(rnd.randint(0, 150))]
        if rnd.random() < 0.5:
            i, text = rnd.choice(items)
            chars = list(text.upper() if rnd.random() < 0.2 else text)
            for _ in range(int(rnd.choice((0, 0, 0.02, 0.05, 0.09)) * len(chars))):
                chars[rnd.randrange(len(chars))] = rnd.choice(("", "z", "qq"))
            words[len(words) // 2 : len(words) // 2] = ["".join(chars)]
            truth.add((d, i))
        docs.append((d, "\n ".join(words)))
    return docs, items, truth


def test_recall_and_clean_documents(spark):
    docs, items, _ = corpus(1)
    want = set()
    for d, text in docs:
        low = " ".join(text.lower().split()).encode()
        for i, item in items:
            p = item.encode()
            if decontaminate.infix_distance(p, low) <= int(0.15 * len(p)):
                want.add((d, i))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_nulls_short_items_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "x one two y", 1), (1, None, 1), (1, "", 1), (2, "A long  Passage of words here", 1), (2, "A long  Passage of words here", 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, "one TWO"), (8, None), (9, ""), (None, "long passage of words"), (11, "absent thing entirely")], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id or -1, r.distance) for r in decontaminate.leaks(docs, items).collect())
    assert got == [(-1, 7, 0), (2, -1, 0), (2, -1, 0)]
    assert decontaminate.leaks(docs.limit(0), items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0


def held(edit, n, length, seed):
    """How many of n items of about length characters, changed by edit and put into other text, are found."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8)))
    items = [" ".join(word() for _ in range(length // 6)) for _ in range(n)]
    texts = [" ".join([*(word() for _ in range(50)), edit(rnd, t), *(word() for _ in range(50))]).encode() for t in items]
    return sum(i in f for i, f in enumerate(decontaminate.Index(items, 0.15).matches(texts)))


def test_long_items_with_a_changed_or_missing_start():
    changed = lambda rnd, t: "".join(rnd.choice("qrstuvwxyz") for _ in range(len(t) * 12 // 100)) + t[len(t) * 12 // 100 :]
    missing = lambda rnd, t: t[len(t) * 12 // 100 :]
    assert held(changed, 30, 1350, 3) == 30 and held(missing, 30, 1350, 4) == 30


def test_scattered_edits_up_to_the_limit():
    def every_third_word(rnd, t):
        words = t.split()
        return " ".join("z" + w[1:] if k % 3 == 1 else w for k, w in enumerate(words))

    def substituted(share):
        def edit(rnd, t):
            chars = list(t)
            for k in rnd.sample(range(len(chars)), int(share * len(chars))):
                chars[k] = "z"
            return "".join(chars)

        return edit

    def anything(rnd, t):
        chars = list(t)
        for k in rnd.sample(range(len(chars)), int(0.15 * len(chars))):
            chars[k] = rnd.choice(("", "z", "z" + chars[k]))
        return "".join(chars)

    assert held(every_third_word, 40, 230, 5) == 40 and held(anything, 40, 230, 6) == 40
    assert [held(substituted(share), 40, 230, 7) for share in (0.1, 0.12, 0.14, 0.15)] == [40] * 4
    assert held(substituted(0.15), 40, 90, 8) == 40
