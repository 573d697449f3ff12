import random

import corpus_pipeline
from lectern.llm import pii

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with the names that stages use themselves.
EXTRA = ", toxicity long, worded long, place long, matched long, made long, items long, distances long, part0 long, component_id long, n long"


def tables(spark, folder):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8)))
    item = " ".join(word() for _ in range(30))
    rows, labels = [], []
    for i in range(300):
        words = [word() for _ in range(rnd.randint(20, 90))]
        toxic = rnd.random() < 0.25
        if toxic:
            words[rnd.randrange(len(words)) : 0] = ["zorkelly"] * 1
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(toxic)))
    clean = [r for r, (_, y) in zip(rows, labels, strict=True) if not y]
    rows += [(1000, clean[0][1], "en", "s", 0), (1001, clean[1][1] + " tail", "en", "s", 0)]
    rows += [(1002, clean[2][1] + " " + item + " " + word(), "en", "s", 0), (1003, " ".join(word() for _ in range(30)) + " a.b@mail.com", None, None, None)]
    rows += [(1004, None, None, None, None), (1004, None, None, None, None), (1005, "", "en", "s", 0), (None, " ".join(word() for _ in range(9)), "en", "s", 0), (1006, clean[5][1], "en", "s", 0), (1006, clean[5][1], "en", "s", 0)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, dict(labels), item


def test_stages_take_effect(spark, tmp_path):
    rows, labels, item = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out_{name}")
        docs = spark.read.parquet(f"{tmp_path}/out_{name}")
        seen[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == COLUMNS.replace(",", "").split()[::2]
    clean = [i for i, y in labels.items() if not y]
    kept = [r.doc_id for r in seen["toxicity"]]
    assert len([i for i in kept if labels.get(i) == 0]) >= 0.97 * len(clean) and len([i for i in kept if labels.get(i)]) <= 0.1 * (len(labels) - len(clean))
    copies = [r.doc_id for r in seen["near_copies"]]
    assert not {1000, 1001, 1006} & set(copies) and copies.count(1004) == 2 and copies.count(None) == 1 and 1005 in copies
    assert len(copies) >= len(kept) - 5
    free = {r.doc_id for r in seen["decontaminate"]}
    assert set(copies) - free == {1002} and not any(item in (r.text or "") for r in seen["decontaminate"])
    texts = {r.doc_id: r.text for r in seen["pii"]}
    assert texts[1003].endswith("[email]") and texts[1004] is None and not any(pii.base_spans(t or "") for t in texts.values())
    assert len(seen["bpe"]) == len(seen["pii"]) and all(r.n_tokens == len(r.ids) for r in seen["bpe"])


def test_clashing_columns_and_very_long_texts_stay(spark, tmp_path):
    rows, _, item = tables(spark, tmp_path)
    words = " ".join(f"word{i % 700}" for i in range(50_000))
    some = [(*r, *range(10)) for r in rows[:60]] + [(5000, words, "en", "s", 0, *range(10)), (5001, "x" * 100_000, None, None, None, *range(10)), (5002, words + " " + item, "en", "s", 0, *range(10))]
    docs = spark.createDataFrame(some, COLUMNS + EXTRA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == (COLUMNS + EXTRA).replace(",", "").split()[::2]
        docs.write.parquet(f"{tmp_path}/clash_{name}")
        docs = spark.read.parquet(f"{tmp_path}/clash_{name}")
    kept = {r.doc_id: r for r in docs.collect()}
    assert kept[5000].text == words and kept[5000].place == 2 and len(kept[5001].text) == 100_000 and 5002 not in kept
    encoded = {r.doc_id: r.n_tokens for r in corpus_pipeline.encode_text(spark, docs, str(tmp_path)).collect()}
    assert encoded[5000] >= 50_000 and len(encoded) == len(kept)


def test_run_and_empty_table(spark, tmp_path):
    tables(spark, tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 200
    empty = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
