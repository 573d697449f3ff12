import random

import pytest

from lectern.functions import chunking, markdown, structure, table_functions

FIXED = [
    "", "\n", "plain", "# one\nx\n\n## two  \n", "before\n# a\n```\n# no\n```\n# b", "```\nopen\n# no", "~~~~\n```\n~~~\n~~~~ \nafter\n~~~", "```py\n```x\n```  \nend",
    "| a | b |\n|---|:-:|\n| 1 | 2 |\n\nsaid | here\n---|---\nx", "|---|---|\n|---|---|\n|", "  \t\n \n  # h title \r\n    # four", "####### seven\n#none\n#\tTab", "a b\n# x y\n\x1c\n|\x1c|",
]


def made():
    rnd = random.Random(8)
    pool = ["```", "~~~", "````", "``` js", "~~~~  ", "# h", "## h2 ", "", "  ", "a | b", "|---|---|", "--- | ---", "| |", "text", "   ```", "    ```", "#x", "said."]
    return [*FIXED, *("\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 25))) for _ in range(300)), "\n".join(["```", "x", "```"] * 3000)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([*enumerate(made()), (-1, None)], "id long, text string").repartition(4).cache()


def test_plans_equal_the_plain_functions(spark, texts):
    labels = {r.id: r.labels for r in markdown.labelled(texts.where("text is not null"), "text").select("id", "labels").collect()}
    assert labels == {i: structure.labels(t.split("\n")) for i, t in enumerate(made())}
    got = sorted(map(tuple, markdown.sections(texts, "id", "text").collect()))
    assert got == sorted((i, *s) for i, t in enumerate(made()) for s in structure.sections(t))
    got = sorted(map(tuple, markdown.blocks(texts, "id", "text").collect()))
    assert got == sorted((i, *b) for i, t in enumerate(made()) for b in structure.blocks(t))
    plan = markdown.blocks(texts, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sql_calls_them_laterally(spark, texts):
    table_functions.register(spark)
    texts.createOrReplaceTempView("some_texts")
    rows = spark.sql("SELECT t.id, s.* FROM some_texts t, LATERAL sections(t.text) s").collect()
    assert sorted(map(tuple, rows)) == sorted((i, *s) for i, t in enumerate(made()) for s in structure.sections(t))
    rows = spark.sql("SELECT kind, count(*) AS n FROM some_texts t, LATERAL blocks(t.text) b GROUP BY 1").collect()
    assert {r.kind: r.n for r in rows}["fence"] == sum(b[0] == "fence" for t in made() for b in structure.blocks(t))
    rows = spark.sql("SELECT t.id, c.idx, c.tokens, c.content, c.problem FROM some_texts t, LATERAL chunk(t.text, target => 12, most => 20, overlap => 3) c").collect()
    want = []
    for i, t in enumerate(made()):
        try:
            want += [(i, n, c.tokens, c.text, None) for n, c in enumerate(chunking.chunks(t, 12, 20, 3))]
        except chunking.Oversized as problem:
            want.append((i, None, None, None, str(problem)))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert spark.sql("SELECT * FROM chunk('one two')").columns == ["idx", "section", "line_start", "line_end", "tokens", "content", "problem"]


@pytest.mark.parametrize("call", ["sections(1)", "chunk('x', size => 5)", "chunk('x', target => 'a')", "chunk('x', target => 100, most => 50)"])
def test_wrong_arguments_are_refused(spark, call):
    table_functions.register(spark)
    with pytest.raises(Exception, match="must|isn't|hold"):
        spark.sql(f"SELECT * FROM {call}").collect()
