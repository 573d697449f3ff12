import random
import re

from lectern.llm import pii


def naive(text):
    """The base rules as stated, by plain searches."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((*m.span(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0:
            found.append((*m.span(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def test_base_spans_equal_plain_searches():
    rnd = random.Random(3)
    fixed = ["a@b.c@d.e.f", "x@y@z.com", "@a.b", "1.2.3.4.5.6.7.8", "01.002.0003.4", "256.1.1.1 99999.1.1.1", "4111 1111 1111 1111", "+1 (555) 010-9999)", "é@é.com a.b@c-d.ee.", "++12345678+90"]
    assert [k for *_, k in pii.base_spans("0" * 9000 + "7.1.1.1")] == ["ip"] and not [k for *_, k in pii.base_spans("1" * 9000 + ".1.1.1") if k == "ip"]
    texts = fixed + ["".join(rnd.choice("ab@.+-1290 ()%é") for _ in range(rnd.randint(0, 60))) for _ in range(6000)]
    for t in texts:
        assert pii.base_spans(t) == naive(t), t


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "@" * 100_000, "+" * 100_000, "1." * 100_000, "+1" + " " * 200_000, "1" * 50_000 + ".1.1.1", "0" * 50_000 + "7.1.1.1"):
        pii.base_spans(t)
        pii.candidates(t)


def test_added_spans_and_held_out_accuracy():
    trees = pii.trained()
    held = list(pii.examples(3000, 99))
    hit = [(trees.probability(pii.np.array([pii.features(t, s)]))[0] >= trees.cut[s[2]], y) for t, s, y in held]
    assert sum(h and not y for h, y in hit) <= 0.02 * sum(h for h, _ in hit)
    assert sum(h and y for h, y in hit) >= 0.7 * sum(y for _, y in hit)
    clean = "On 2024-05-01 the total was 1,234.50 for version 10.2.3 of order 8812736 at home."
    (base, spans), = pii.find([clean], trees)
    assert base == spans == []


def test_rows_nulls_and_redaction(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.de now", "x"), (1, "mail a.b@c.de now", "x"), (None, None, "y"), (2, "", None)], "doc_id long, text string, spans string")
    rows = pii.scan(docs).collect()
    assert len(rows) == 4 and sum(r.n_email for r in rows) == 2
    assert {r.text for r in pii.redacted(docs).collect()} == {"mail [email] now", None, ""}
    assert pii.redacted(docs).columns == docs.columns
    assert pii.scan(docs.limit(0)).count() == 0
