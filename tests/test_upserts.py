import random
import threading

import pytest

from lectern.sources.upserts import KeyedTable

SCHEMA = "name string, used long, peak long, version long, state string"


def kept(spark, folder, buckets=8):
    return KeyedTable(spark, str(folder), SCHEMA, ["name"], {"used": "sum", "peak": "max", "state": "newest"}, "version", buckets)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def told(table):
    return {r.name: (r.used, r.peak, r.version, r.state) for r in table.rows().collect()}


def test_batches_merge_as_a_recount_does(spark, tmp_path):
    rnd, want, table = random.Random(1), {}, kept(spark, tmp_path / "t")
    assert told(table) == {}
    for batch in range(4):
        rows = [(rnd.choice([None, *"abcdefgh"]), rnd.randint(1, 9), rnd.choice([None, rnd.randint(1, 99)]), batch * 100 + i if rnd.random() < 0.7 else rnd.randint(-900, -1), f"s{batch}.{i}") for i in range(12)]
        rows = [(a, b, c, v * 1000 + i, s) for i, (a, b, c, v, s) in enumerate(rows)]  # no ties within a batch
        for name, used, peak, version, state in rows:
            u, p, v, s = want.get(name, (0, None, None, None))
            newer = v is None or version >= v
            want[name] = (u + used, max((x for x in (p, peak) if x is not None), default=None), version if newer else v, state if newer else s)
        assert table.apply(frame(spark, rows), "changes", batch)
        assert told(table) == want
        assert not table.apply(frame(spark, rows), "changes", batch) and told(table) == want  # again: nothing changes


def test_versions_never_go_back(spark, tmp_path):
    table = kept(spark, tmp_path / "t")
    for batch, (version, state) in enumerate([(5, "five"), (3, "three"), (5, "five again"), (6, "six")]):
        table.apply(frame(spark, [("a", 0, 0, version, state)]), "s", batch)
        assert told(table)["a"][3] == ["five", "five", "five again", "six"][batch]


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = kept(spark, tmp_path / "t", 16)
    table.apply(frame(spark, [(f"n{i}", 1, 1, 1, "x") for i in range(200)]), "s", 0)
    before = dict(table._manifest()["buckets"])
    table.apply(frame(spark, [("n7", 1, 5, 2, "y"), ("n8", 1, 1, 0, "z")]), "s", 1)
    after = table._manifest()["buckets"]
    changed = [b for b in after if after[b] != before[b]]
    assert len(before) == 16 and sorted(map(int, changed)) == table.rewritten and 1 <= len(changed) <= 2
    assert told(table)["n7"] == (2, 5, 2, "y") and told(table)["n8"] == (2, 1, 1, "x") and len(told(table)) == 200
    assert table.apply(frame(spark, []), "s", 2) and table.rewritten == []


def test_writers_at_once_lose_nothing(spark, tmp_path):
    start = kept(spark, tmp_path / "t", 2)
    start.apply(frame(spark, [("a", 1, 1, 1, "x"), ("b", 1, 1, 1, "x")]), "start", 0)
    threads = [threading.Thread(target=lambda k=k: kept(spark, tmp_path / "t", 2).apply(frame(spark, [("a", 10, k, 1, "x"), ("b", 1, 1, 1, "x")]), f"writer {k}", 0)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert told(start)["a"][:2] == (31, 2) and told(start)["b"][0] == 4


def test_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path), "a long, b long", ["a"], {"b": "mean"})
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path), "a long, b long", ["a"], {"b": "newest"})
