import hashlib
import random
import zlib

import pytest

from lectern.llm import merkle
from lectern.llm.queries import op12_merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    for level in levels[:-1]:
        a = i // 3 * 3
        yield level[a:i], level[i + 1 : a + 3]
        i //= 3


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for n in names:
        groups[n].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = [tree([leaf(r, r[4]) for r in groups[n]]) for n in names]
    top = tree([t[-1][0] for t in trees])
    for k, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            steps = [*path(trees[k], i), *path(top, k)]
            text = r[4].replace("\n", "") if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            folded = leaf(r, text)
            for left, right in steps:
                folded = h(*left, folded, *right)
            yield r[0], leaf(r, r[4]), trees[k][-1][0], top[-1][0], h(*(x for left, right in steps for x in left + right)), folded, folded == top[-1][0]


def told(rows):
    return sorted(map(tuple, rows), key=repr)


def test_whole_table_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select(*COLUMNS).collect()]
    got = told(op12_merkle(spark, folder).collect())
    assert got == told(brute(rows)) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("ids", ["dense", "wide"])
def test_nulls_ties_and_repeated_rows(spark, ids):
    """Over a block of 729 leaves in one source; ids over the whole range of longs, null ones, repeated ones with equal and other rows."""
    rnd = random.Random(len(ids))
    pool = [None, 5, -3, 2**63 - 1, -(2**63)] if ids == "wide" else [None, 7, 8]
    rows = []
    for i in range(2500):
        doc_id = rnd.choice([*pool, rnd.randint(-(2**63), 2**63 - 1) if ids == "wide" else i, i, i, i])
        rows.append((doc_id, rnd.choice([None, "", "a", "é", "zz", " b", "a", "a", "a"]), rnd.choice([None, "en"]), rnd.choice([None, 3]), rnd.choice([None, "", "x\ny", "z\n" * 50])))
    rows += [rows[7]] * 900
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, rank int, `group` string")
    assert told(merkle.manifest(docs).collect()) == told(brute(rows))


def test_empty_and_single(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.manifest(spark.createDataFrame([], schema)).collect() == []
    row = (4, "s", None, None, "long\n" * 200_000)
    assert told(merkle.manifest(spark.createDataFrame([row], schema)).collect()) == told(brute([row]))
