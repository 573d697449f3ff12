import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from lectern.llm import conversation
from lectern.llm.queries import op11_conversation_repair


def listed(rows):
    """Every edit of a few rows, inserts of up to two rows at each place included: the least (cost, audit) with its lines."""
    best = None
    for edits in itertools.product("KRD", repeat=len(rows)):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for k in range(len(rows) + 1):
                cost, audit = cost + 3 * gaps[k], audit + "I" * gaps[k]
                out += [(None, "")] * gaps[k]
                if k < len(rows):
                    role, text, fault = rows[k]
                    if edits[k] != "D" and fault in "bd":
                        break
                    cost += {"K": 0, "R": 3, "D": 4}[edits[k]] + (3 if edits[k] != "D" and fault == "t" else 0)
                    audit += edits[k]
                    out += [(role if edits[k] == "K" else None, text)] * (edits[k] != "D")
            else:
                for first in (0, 1):
                    turns = [(r if r is not None else ("user", "assistant")[(i + first) % 2], x) for i, (r, x) in enumerate(out)]
                    if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)) and (best is None or (cost, audit) < best[:2]):
                        best = cost, audit, [f"{r}:{x}" for r, x in turns]
    return best


def swept(rows):
    """The same by one sweep over the rows with the best of each state."""
    follow = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def closed(best):
        for _ in range(4):
            for q in list(best):
                for letter, n in follow[q].items():
                    way = (best[q][0] + 3, best[q][1] + "I", best[q][2] + [f"{'user' if letter == 'u' else 'assistant'}:"])
                    if letter != "s" and (n not in best or way[:2] < best[n][:2]):
                        best[n] = way
        return best

    best = closed({0: (0, "", [])})
    for role, text, fault in rows:
        new = {}
        for q, (cost, audit, out) in best.items():
            ways = [(q, (cost + 4, audit + "D", out))]
            for letter, n in follow[q].items() if fault not in "bd" else ():
                extra = 3 * (fault == "t")
                ways += [(n, (cost + extra, audit + "K", out + [f"{role}:{text}"]))] * (role[:1] == letter)
                ways += [(n, (cost + extra + 3, audit + "R", out + [f"{'user' if letter == 'u' else 'assistant'}:{text}"]))] * (letter != "s")
            for n, way in ways:
                if n not in new or way[:2] < new[n][:2]:
                    new[n] = way
        best = closed(new)
    return min(best[q] for q in (0, 3) if q in best)


def brute(rows):
    said, groups = lambda v: " " if v is None else str(v), {}
    for conv, turn, role, text in rows:
        own = groups.setdefault(conv, [])
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", said(text))}.get(kind, said(text))
        own += [(turn, "user" if kind == 4 else said(role), text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()))
        turns = {r[0] for r in own} - {None}
        marked, seen = [], set()
        for _, role, text in own:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            marked.append((role, text, "b" if not shown else "d" if (role, text) in seen else "-" if shown[-1] in ".!?" else "t"))
            seen.add((role, text))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit, out = swept(marked)
        counts = (sum(r[2] == k for r in marked) for k in "bdt")
        yield conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def told(rows):
    return sorted(map(tuple, rows), key=repr)


def test_search_is_the_cheapest_and_least():
    rnd = random.Random(2)
    for _ in range(150):
        rows = [(rnd.choice(["system", "user", "assistant", "tool", ""]), f"x{i}", rnd.choice("bdt--")) for i in range(rnd.randint(0, 4))]
        initials = "".join(r[0][:1] or "-" for r in rows)
        (_, (cost, audit)), *_ = conversation.search(initials, "".join(r[2] for r in rows), 0).items()
        lines = conversation.repaired([r[0] for r in rows], [r[1] for r in rows], audit, 0)[0]
        assert (cost, audit, lines) == (*(best := listed(rows))[:2], "\n".join(best[2])) == (*(way := swept(rows))[:2], "\n".join(way[2]))


def test_whole_table_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(op11_conversation_repair(spark, folder).collect()) == told(brute(rows))


@pytest.mark.parametrize("block", [conversation.BLOCK, 5])
def test_nulls_ties_and_long_conversations(spark, block):
    """One conversation has most rows: in blocks it gives what the sweep over all of it gives."""
    rnd = random.Random(3)
    roles, texts = ["user", "assistant", "system", None, "", "tool", "user", "assistant"], [None, "", "a.", "b", "c!", "\v", "é?"]
    rows = []
    for i in range(1200):
        rows.append((rnd.choice([None, 1, 1, 1, 2, i % 200]), rnd.choice([None, i % 40, i, i, i]), rnd.choice(roles), rnd.choice([*texts, f"{i}.", f"{i}?", f"{i}"])))
    rows.append((777, 1, "user", "long " * 300_000 + "."))
    rows.append((888, next(t for t in range(999) if zlib.crc32(f"888:{t}".encode()) % 20 == 0), "user", "goes"))
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, rank string, part int")
    got = told(conversation.repair(table, block).collect())
    want = told([*brute(rows[:-1]), (888, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())])
    assert got == want


def test_empty_table(spark):
    assert conversation.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_oracle_equals_brute_force(tmp_path):
    """The SQL over nulls and ties, against the sweep."""
    rnd, con = random.Random(6), duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    rows = [(rnd.choice([None, 1, 2, i % 60]), rnd.choice([None, i % 9, i]), rnd.choice(["user", "assistant", "system", None, "tool"]), rnd.choice([None, "", "a.", f"b{i}", f"c{i}!"])) for i in range(300)]
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert {r[0]: r for r in told(con.sql(conversation.ORACLE).fetchall())}.items() >= {r[0]: r for r in told(brute(rows))}.items()
