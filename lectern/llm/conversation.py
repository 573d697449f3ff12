"""Repair of conversations: the cheapest edits that give a legal order of roles.

The edit lattice has a node for each (rows read, state of the role automaton).
A* walks it by (cost so far plus what the rows ahead cost at least, audit): the
heuristic is a suffix sum of 4 for each row that must be deleted and 3 for each
truncated one, which costs that if kept and more if deleted. It never falls along
an edge by more than the edge costs, so the first arrival at a node is the
cheapest one and, of equally cheap ones, the one with the least audit.

A conversation of over BLOCK rows is cut into blocks by exact ranks
(`radix.ranked`). Each block is searched from every state, and the
(start, end) tables of neighbouring blocks are joined in a tree, FAN at a time:
least cost, then least audit, is associative, so the result is that of the whole
lattice, and no task holds a conversation's rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed, crc32_sql, dropped
from lectern.llm.radix import ranked

BLOCK, FAN, SALTS = 256, 64, 16
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after the system row, after a user, after an assistant; and which role leads where.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}


def search(initials: str, faults: str, start: int, ends: tuple[int, ...] = ENDS, every: bool = False) -> dict[int, tuple[int, str]]:
    """Cost and audit of the cheapest way from a state over all rows to the nearest of the end states, or to every one.

    faults: for each row b (blank), d (duplicate), t (truncated) or - (none).
    """
    size = len(initials)
    ahead = [0] * (size + 1)
    for i in range(size - 1, -1, -1):
        ahead[i] = ahead[i + 1] + {"b": DELETE, "d": DELETE, "t": TRUNCATED, "-": 0}[faults[i]]
    heap, done, found = [(ahead[0], "", 0, start)], set(), {}
    while heap:
        bound, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        cost = bound - ahead[i]
        if i == size and state in ends:
            found[state] = (cost, audit)
            if not every or len(found) == len(ends):
                break

        def go(edge: int, letter: str, to: int, at: int) -> None:
            if (to, at) not in done:
                heapq.heappush(heap, (cost + edge + ahead[to], audit + letter, to, at))  # noqa: B023

        for role in ROLES:
            if role in NEXT[state]:
                go(INSERT, "I", i, NEXT[state][role])
        if i < size:
            go(DELETE, "D", i + 1, state)
            if faults[i] not in "bd":
                extra = TRUNCATED if faults[i] == "t" else 0
                if initials[i] in NEXT[state]:
                    go(extra, "K", i + 1, NEXT[state][initials[i]])
                for role in ROLES:
                    if role in NEXT[state]:
                        go(REROLE + extra, "R", i + 1, NEXT[state][role])
    return found


def repaired(roles: list[str], texts: list[str], audit: str, state: int) -> tuple[str, int]:
    """The rows that an audit leaves, a role:text line each, and the state they end in. Beside a kept row the state gives the role: a user after anything but a user."""
    out, at = [], 0
    for edit in audit:
        role = "a" if state == 2 else "u"
        if edit == "K":
            role = roles[at][:1]
            out.append(f"{roles[at]}:{texts[at]}")
        elif edit != "D":
            out.append(f"{ROLES[role]}:{texts[at] if edit == 'R' else ''}")
        state = state if edit == "D" else NEXT[state][role]
        at += edit != "I"
    return "\n".join(out), state


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, conv (the id as text), turn, role, text: what is left of the rows, each one damaged or not as the checksum of its id and turn says."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    rows = conversations.select("conv_id", filled("conv_id").alias("conv"), "turn", F.when(kind == 4, "user").otherwise(filled("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("kind <> 0").withColumn("copy", copies).drop("kind", "copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows (conv, rank, digest, fault: b, t or -) with d as the fault of a row whose digest stands earlier in its conversation and that isn't blank.

    A third of all rows may be copies of one, so they are dealt by a salt as well.
    """
    firsts = rows.groupBy("conv", "digest").agg(F.min("rank").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    told = rows.withColumn("salt", F.col("rank") % SALTS).join(salted, ["conv", "digest", "salt"], "left").drop("salt")
    return told.withColumn("fault", F.when((F.col("fault") != "b") & (F.col("rank") > F.col("first")), "d").otherwise(F.col("fault"))).drop("first")


WAYS = "array<struct<start:int,end:int,cost:long,audit:string>>"


def ways(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The cheapest way of a block from each state it may start in to each it may end in."""
    for initials, faults, first, last in batches:
        out = []
        for row in zip(initials, faults, first, last, strict=True):
            starts, ends = (0,) if row[2] else range(4), ENDS if row[3] else range(4)
            alone = row[2] and row[3]
            out.append([(a, b, *way) for a in starts for b, way in search(row[0], row[1], a, tuple(ends), every=not alone).items()])
        yield pd.Series(out)


TABLE = "conv string, part long, start int, end int, cost long, audits array<string>, states array<int>"


def joined(rows: pd.DataFrame) -> pd.DataFrame:
    """The table of neighbouring blocks from theirs: through every state between them the cheapest way, of equal ones the least audit."""
    rows = rows.sort_values("part")
    best: dict[tuple[int, int], tuple] = {}
    for k, (_, block) in enumerate(rows.groupby("part", sort=True)):
        own = [((r.start, r.end), (r.cost, "".join(r.audits), list(r.audits), list(r.states))) for r in block.itertuples()]
        if not k:
            best = dict(own)
            continue
        grown: dict[tuple[int, int], tuple] = {}
        for (a, middle), x in best.items():
            for (b, end), y in own:
                if middle == b:
                    way = (x[0] + y[0], x[1] + y[1], x[2] + y[2], x[3] + y[3])
                    if (a, end) not in grown or way[:2] < grown[a, end][:2]:
                        grown[a, end] = way
        best = grown
    out = [(rows["conv"].iloc[0], rows["part"].iloc[0] // FAN, a, b, cost, audits, states) for (a, b), (cost, _, audits, states) in best.items()]
    return pd.DataFrame(out, columns=["conv", "part", "start", "end", "cost", "audits", "states"])


def lines(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for roles, texts, audits, states in batches:
        yield pd.Series([repaired(list(r), list(t), a, int(s))[0] for r, t, a, s in zip(roles, texts, audits, states, strict=True)], dtype=object)


def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each conversation's lines, whose blocks come in order; only one block is held."""
    conv, state = None, None
    for batch in batches:
        out = []
        for name, said in zip(batch["conv"], batch["said"], strict=True):
            if name != conv:
                if state is not None:
                    out.append((conv, state.hexdigest()))
                conv, state, empty = name, hashlib.sha256(), True
            if said:
                state.update(b"" if empty else b"\n")
                state.update(said.encode())
                empty = False
        yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
    if state is not None:
        yield pd.DataFrame([(conv, state.hexdigest())], columns=["conv", "repaired_sha256"])


def repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of conversations (conv_id, turn, role, text) after damage.

    A null field counts as one blank; rows without a conv_id are one conversation. Rows
    go by turn, null first, rows of one turn by the digest of role and text; equal rows follow each
    other. A conversation that lost all its rows has zeros, an empty audit and the digest of the empty text. Other columns don't count.
    """
    everyone = conversations.groupBy("conv_id").agg(F.lit(None).alias("x")).select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"))
    own = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    texts = checkpointed(damaged(conversations).withColumn("digest", own))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", "b").when(~last.isin(".", "!", "?"), "t").otherwise("-")
    initial = F.when(F.col("role") == "", "-").otherwise(F.substring("role", 1, 1))
    narrow = texts.select("conv", "turn", "digest", fault.alias("fault"), initial.alias("initial"))
    turns = narrow.groupBy("conv", "turn").agg(F.count("*").alias("n"))
    spans = turns.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    placed = ranked(narrow, "conv", "turn", "digest")
    part = F.expr(f"rank div {block}")
    item = F.struct("rank", "initial", "fault")
    faulty = with_faults(placed).groupBy("conv", part.alias("part")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    order = Window.partitionBy("conv").orderBy("part")
    lead = faulty.select("conv", "part", F.array_join("items.initial", "").alias("initials"), F.array_join("items.fault", "").alias("faults"))
    count = lambda sign: F.length("faults") - F.length(F.replace("faults", F.lit(sign), F.lit("")))
    with_last = F.concat(F.coalesce(F.lag(F.substring("initials", -1, 1)).over(order), F.lit("")), "initials")
    blocks = lead.withColumns({"seen": with_last, "first": F.lag("part").over(order).isNull(), "last": F.lead("part").over(order).isNull()})
    pairs = F.transform(F.sequence(F.lit(1), F.length("seen")), lambda i: F.substring(F.col("seen"), i, F.lit(2)))
    illegal = F.size(F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin("su", "ua", "au")))
    names = {"b": "blank", "d": "duplicate", "t": "truncated"}
    told = checkpointed(blocks.select("conv", "part", *(count(k).alias(v) for k, v in names.items()), illegal.alias("illegal"), F.pandas_udf(ways, WAYS)("initials", "faults", "first", "last").alias("ways")))
    sums = told.groupBy("conv").agg(*(F.sum(c).alias(c) for c in (*names.values(), "illegal")), F.max("part").alias("parts"))

    way = told.select("conv", "part", F.inline("ways"))
    table = way.select("conv", "part", "start", "end", "cost", F.array("audit").alias("audits"), F.array("start").alias("states"))
    parts = (told.agg(F.max("part").alias("n")).first()["n"] or 0) + 1
    several, steps = sums.where("parts > 0").select("conv"), [table.join(sums.where("parts = 0").select("conv"), "conv", "left_semi")]
    grown = table.join(several, "conv", "left_semi")
    while parts > 1:
        grown, parts = grown.groupBy("conv", F.expr(f"part div {FAN}")).applyInPandas(joined, TABLE), -(-parts // FAN)
    steps.append(grown.select(*table.columns))
    whole = steps[0].unionByName(steps[1]).where("start = 0 and end in (0, 3)").withColumn("audit", F.array_join("audits", ""))
    best = checkpointed(whole.groupBy("conv").agg(F.min(F.struct("cost", "audit", "audits", "states")).alias("best")).select("conv", "best.*"))

    rows = texts.dropDuplicates(["conv", "turn", "digest"]).withColumns({"null_": F.col("turn").isNull(), "turn": F.coalesce("turn", F.lit(0))})
    ranks = placed.select("conv", F.col("turn").isNull().alias("null_"), F.coalesce("turn", F.lit(0)).alias("turn"), "digest", "rank")
    full = rows.join(ranks, ["conv", "null_", "turn", "digest"]).groupBy("conv", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("rank", "role", "text"))).alias("items"))
    edits = best.select("conv", F.posexplode(F.arrays_zip("audits", "states")).alias("part", "edit"))
    said = full.join(edits, ["conv", "part"]).select("conv", "part", F.pandas_udf(lines, "string")("items.role", "items.text", "edit.audits", "edit.states").alias("said"))
    shas = said.repartition("conv").sortWithinPartitions("conv", "part").select("conv", "said").mapInPandas(digests, "conv string, repaired_sha256 string")

    out = everyone.join(spans, "conv", "left").join(sums, "conv", "left").join(best, "conv", "left").join(shas, "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *names.values(), "illegal", "cost")]
    done = checkpointed(out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))
    dropped(texts, placed, told, best)
    return done


def _oracle() -> str:
    """One sweep over the rows of each conversation, with the best way to each of the four states."""
    none, after = "{'cost': 1000000000::BIGINT, 'audit': '', 'said': []::VARCHAR[]}", ("q0", "q1", "q3")
    stays, extra = "NOT fault IN ('b', 'd')", f"CASE fault WHEN 't' THEN {TRUNCATED} ELSE 0 END"

    def way(state: str, cost: str | int, edit: str, line: str | None = None) -> str:
        said = f"list_append({state}.said, {line})" if line else f"{state}.said"
        return f"{{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{edit}', 'said': {said}}}"

    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    if_ = lambda case, then: f"CASE WHEN {case} THEN {then} ELSE {none} END"
    delete = lambda q: way(q, DELETE, "D")
    insert = lambda q, role: way(q, INSERT, "I", f"'{ROLES[role]}:'")
    keep = lambda q, role: if_(f"{stays} AND initial = '{role}'", way(q, f"({extra})", "K", "role || ':' || text"))
    rerole = lambda q, role: if_(stays, way(q, f"({REROLE} + {extra})", "R", f"'{ROLES[role]}:' || text"))
    system = least(delete("q1"), keep("q0", "s"))
    user = least(delete("q2"), *(keep(q, "u") for q in after), *(rerole(q, "u") for q in after))
    assistant = least(delete("q3"), keep("q2", "a"), rerole("q2", "a"))
    return rf"""WITH RECURSIVE g AS (SELECT conv_id, turn, {crc32_sql("said")} % 20 AS kind, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS said FROM conversations)),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM g WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role)) || ':' || role || text)) AS rn FROM d),
r AS (SELECT *, role[1:1] AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '-' END AS fault FROM n),
told AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY rn) || initial AS pair FROM r),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY 1),
-- the cheapest way to each state of the roles after each row: nothing yet, after the system row, after a user, after an assistant
s AS (SELECT conv_id, 0::BIGINT AS rn, {{'cost': 0::BIGINT, 'audit': '', 'said': []::VARCHAR[]}} AS q0, {none} AS q1, {{'cost': 3::BIGINT, 'audit': 'I', 'said': ['user:']}} AS q2, {{'cost': 6::BIGINT, 'audit': 'II', 'said': ['user:', 'assistant:']}} AS q3 FROM (SELECT DISTINCT conv_id FROM r)
UNION ALL SELECT conv_id, rn, q0, q1, q2, {least('q3', insert('q2', 'a'))} FROM (SELECT conv_id, rn, q0, q1, {least('q2', *(insert(q, 'u') for q in after))} AS q2, q3 FROM (
  SELECT r.conv_id, r.rn, {delete('q0')} AS q0, {system} AS q1, {user} AS q2, {assistant} AS q3 FROM s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.rn = s.rn + 1))),
best AS (SELECT conv_id, max_by(list_min([q0, q3]), rn) AS best FROM s GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(array_to_string(best.said, E'\n'), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLE = _oracle()
