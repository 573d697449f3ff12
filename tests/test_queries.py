"""Every query with an oracle against DuckDB on the smallest tables; invariants of the others."""

import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from lectern.operators import selection
from lectern.plans import CATALOG

DATA = os.environ.get("LECTERN_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


def bag(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(CATALOG.oracles))
def test_equals_oracle(spark, duck, name):
    df = CATALOG.queries[name](spark, DATA)
    want = duck.sql(CATALOG.oracles[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert bag(df.collect(), df.columns) == bag(want.fetchall(), want.columns)


def hits(seed, n=30):
    rnd = np.random.default_rng(seed)
    return pd.DataFrame({
        "query_id": 1, "doc": rnd.integers(0, 4, n), "idx": range(n), "chunk_id": [f"c{i}" for i in range(n)], "sim": rnd.random(n).round(2),
        "vec": list(rnd.normal(size=(n, 4))), "text": [f"t{i % 25}" for i in range(n)], "cost": rnd.integers(10, 60, n),
    })


def test_mmr_invariants():
    for seed in range(30):
        h = hits(seed)
        out = selection.mmr(h, 8, 0.7, 200)
        assert out["cost"].sum() <= 200 and len(out) <= 8 and out["text"].is_unique and out["chunk_id"].is_unique
        again = selection.mmr(h.sample(frac=1, random_state=seed), 8, 0.7, 200)
        assert list(out["chunk_id"]) == list(again["chunk_id"])
        assert out.empty or out["sim"].iloc[0] == h.loc[h["cost"] <= 200, "sim"].max()


def test_multi_source_invariants():
    for seed in range(30):
        h = hits(seed)
        out = selection.mmr_sources(h, 6, 0.7, 260)
        assert out["cost"].sum() <= 260 and not out.duplicated(["doc", "text"]).any() and out["chunk_id"].is_unique
        assert out["doc"].nunique() == h.loc[h["sim"] > 0, "doc"].nunique() or len(out) == out["doc"].nunique()
        again = selection.mmr_sources(h.sample(frac=1, random_state=seed), 6, 0.7, 260)
        assert sorted(out["chunk_id"]) == sorted(again["chunk_id"])


def test_evidence_from_before():
    for seed in range(30):
        h = hits(seed)
        prior = h.iloc[[3, 7]]
        out = selection.mmr_sources(h, 6, 0.7, 260, prior)
        assert out["cost"].sum() + prior["cost"].sum() <= 260 and not set(out["chunk_id"]) & set(prior["chunk_id"])
        assert not set(zip(out["doc"], out["text"], strict=True)) & set(zip(prior["doc"], prior["text"], strict=True))
    with pytest.raises(ValueError):
        selection.mmr_sources(h, 6, 0.7, 10, prior)
    one = h[h["doc"] == 1]
    assert len(selection.mmr_sources(one, 6, 0.7, 900, one.iloc[:1])) == min(6, one["text"].nunique() - 1)


def test_admission_counts_accepted_calls_only():
    calls = pd.DataFrame({"second": [0, 1, 2, 3, 60, 61, 62], "tokens": [1] * 7})
    assert selection.admit(calls, 3, 100, 100).tolist() == [True, True, True, False, False, True, True]
    assert selection.admit(calls, 9, 3, 5).tolist() == [True, True, True, False, False, True, True]
    assert selection.admit(calls, 9, 99, 2).sum() == 2


def test_entry(spark):
    import __spark_entry__

    asked = spark.read.parquet(f"{__spark_entry__.SMOKE_DIR}/embeddings.parquet").where("vec_id % 20 = 0").count()
    assert __spark_entry__.entry(spark).count() == 10 * asked > 0
    assert set(CATALOG.queries) <= set(__spark_entry__.queries())
