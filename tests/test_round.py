"""Two-step sums, blocked links and searches, the guards, the limiter, Markdown and sections against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import charts, filings, questions, relational, retrieval, sqlguard, texts
from quillspark.streaming import events


def test_prefix_sums_equal_plain_ones(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab") if i % 9 else None, i, rng.randint(0, 9) if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = relational.prefix_sums(df, ["k"], [F.floor(F.col("i") / 17)], [F.col("i")], {"s": F.col("v"), "n": F.lit(1)})
    assert got.columns == ["k", "i", "v", "s", "n"]
    for r in got.collect():
        before = [v for k, i, v in rows if k == r.k and i <= r.i]
        assert r.n == len(before) and (r.s or 0) == sum(v or 0 for v in before)


def test_insert_ignore_keeps_the_first(spark):
    new = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string")
    old = spark.createDataFrame([(2,)], "k int")
    assert [tuple(r) for r in relational.insert_ignore(old, new, ["k"]).collect()] == [(1, "a")]


def test_contained_links_equal_a_nested_loop(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))
    left, right = sorted({word() for _ in range(60)}), sorted({word() for _ in range(60)})
    got = relational.contained_links(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), "a", "b")
    want = sorted((a, b) for a in left for b in right if len(a) >= 4 and len(b) >= 4 and (a in b or b in a))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_knn_in_blocks_equals_one(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(120)], "id int, v array<double>")
    q = df.filter("id % 10 = 0").withColumnRenamed("id", "q")
    run = lambda block: sorted(tuple(r) for r in retrieval.knn_batch(df, q, "id", "q", "v", 3, block).collect())
    assert run(5) == run(1000) and len(run(5)) == 36


@pytest.mark.parametrize("sql", ["SELECT 'a--b' AS x", "SELECT 'update; drop' AS x FROM t", "select \"it''s\" /* delete */ from `a b`", "WITH a AS (SELECT 1) SELECT * FROM a;", "SELECT a.csv FROM t a", "```sql\nSELECT 1\n```"])
def test_guard_allows(sql):
    assert sqlguard.refusal(sql) is None


@pytest.mark.parametrize("sql", ["SELECT * FROM parquet.`relative_dir`", "SELECT * FROM csv . `x`", "SELECT 1; SELECT 2", "SELECT 1 /* */; DROP TABLE x", "SELECT 'open", "EXPLAIN SELECT 1", "SELECT java_method('a', 'b')", "", None, "SELECT * FROM json.dir", "-- only a comment"])
def test_guard_refuses(sql):
    assert sqlguard.refusal(sql)


def test_guard_keeps_strings(spark):
    assert sqlguard.run_read_only(spark, "SELECT 'a--b /* c */' AS x -- gone").first().x == "a--b /* c */"


@pytest.mark.parametrize(("text", "fine"), [("1 + 2 * -3 ** 2", True), ("(1.5 // 2) % 3", True), ("eval(1)", False), ("x", False), ("'a' * 2", False), ("1 if 2 else 3", False), ("[1]", False), ("1 +", False), ("True", False), ("", False), (None, False), ("1" * 2000, False), ("a.b", False)])
def test_arithmetic(text, fine):
    assert (sqlguard.math_refusal(text) is None) == fine


def test_limiter_equals_a_replay():
    class State:
        def __init__(self):
            self.kept = None

        hasTimedOut = False
        exists = property(lambda self: self.kept is not None)
        get = property(lambda self: self.kept)

        def update(self, value):
            self.kept = value

    import pandas as pd

    rng, state, judge = random.Random(4), State(), events.limiter(10, 3, False)
    passed, want, got, now = [], {}, {}, 0.0
    for batch in range(4):
        rows = []
        for i in range(200):
            now += rng.choice([0, 0.5, 4])
            rows.append((now, batch * 1000 + i))
        for at, i in rows:
            passed = [t for t in passed if at - t < 10]
            want[i] = len(passed) < 3
            passed += [at] * want[i]
        rng.shuffle(rows)
        parts = [pd.DataFrame(rows[k::3], columns=["at", "id"]) for k in range(3)]
        for out in judge(("u",), iter(parts), state):
            got |= dict(zip(out["id"], out["allowed"], strict=True))
        assert len(state.get[0]) <= 3
    assert got == want


def test_markdown_round_trip(spark):
    rows = [(1, 1, "a | b", 1.5), (1, 2, None, None), (2, 1, "x", 0.0)]
    df = spark.createDataFrame(rows, "g int, o int, n string, v double")
    out = charts.markdown_table(df, ["g"], ["N", "V"], [F.col("n"), F.col("v")], F.col("o"))
    text = {r.g: r.table for r in out.collect()}
    assert text[1] == "| N | V |\n|---|---|\n| a \\| b | 1.5 |\n| — | — |"
    back = sorted((r.g, r.line, r.cells) for r in charts.markdown_rows(out, ["g"], "table").collect())
    assert back == [(1, 2, ["a | b", "1.5"]), (1, 3, ["—", "—"]), (2, 2, ["x", "0.0"])]


def test_markdown_text_around_tables(spark):
    text = "no | table\nA | B\n:-- | --:\nonly\n\n| H | I |\n|---|---|\n| 1 |\n| 2 | 3 | 4 |\nend\n| 5 | 6 |"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string")
    assert [(r.line, r.cells) for r in charts.markdown_rows(df, ["id"], "t").orderBy("line").collect()] == [(7, ["1", ""]), (8, ["2", "3"])]


@pytest.mark.parametrize(("v", "precise", "cell", "usd"), [(1.23456, "1.2346", "1.23", "$1"), (123.456, "123.46", "123.46", "$123"), (1234.5678, "1,235", "1,235", "$1,235"), (5.6e6, "5,600,000", "5.60M", "$5.6M"), (-1.2345e9, "-1,234,500,000", "-1.23B", "$-1.23B"), (None, None, None, "n/a")])
def test_number_formats(spark, v, precise, cell, usd):
    c = F.lit(v).cast("double")
    got = spark.range(1).select(charts.precise_number(c), charts.compact_cell(c), charts.metric_value(c, F.lit("USD"))).first()
    assert tuple(got) == (precise, cell, usd)


def test_uncovered_company(spark):
    names = spark.createDataFrame([(n, n) for n in questions.UNCOVERED], "alias string, value string")
    ask = lambda t: questions.uncovered(spark.range(1).withColumn("t", F.lit(t)), "id", "t", names).first().company
    assert ask("What about Goldman Sachs and Ford?") == "goldman sachs" and ask("affordable metadata") is None and ask("META?") == "meta" and ask(None) is None


def test_sections_of_both_kinds(spark):
    body = lambda w, n: " ".join([w] * n)
    annual = f"Item 1. Business\n{body('short', 3)}\nItem 1A. Risk\n{body('risk', 90)}\nItem 7. MD&A\n{body('mda', 120)}\nItem 1. Business\n{body('long', 100)}"
    found = dict(filings.sections(annual, filings.ANNUAL_HEADERS, r"item\s+\d"))
    assert set(found) == {"item_1", "item_1a", "item_7"} and found["item_1"].endswith("long") and "risk" in found["item_1a"]
    prospectus = f"PROSPECTUS SUMMARY\n{body('sum', 100)}\nRISK FACTORS\n{body('danger', 100)}\nUSE OF PROCEEDS\nshort"
    assert [k for k, _ in filings.sections(prospectus, filings.PROSPECTUS_HEADERS)] == ["prospectus_summary", "risk_factors"]
    assert filings.sections("nothing here", filings.ANNUAL_HEADERS) == [("full_text", "nothing here")]
    longest = spark.range(1).select(texts.longest_section(F.lit(annual), r"item 1\.", r"item [0-9]", 50)).first()[0]
    assert longest.endswith("long")


def test_tables_apart_from_prose():
    table = "\n".join(f"| row {i} with a longer label | {i} | {i * 2} |" for i in range(6))
    kinds = filings.segments(f"Some prose.\nMore prose.\n{table}\nThe end.")
    assert [k for k, _ in kinds] == ["narrative", "table", "narrative"] and kinds[1][1] == table


def test_row_ids(spark):
    from quillspark.sources import tables

    got = tables.with_ids(spark.range(50)).collect()
    assert len({r[0] for r in got}) == 50 and all(len(r[0]) == 36 and r[0][14] == "4" for r in got)


def test_companies_in_the_order_of_mention(spark):
    aliases = questions.aliases_of(spark, {"INTC": ["intel"], "AMD": ["advanced micro", "amd"], "NVDA": ["nvidia"], "ON": ["on"], "MU": ["micron"]})
    asked = ["Compare Intel and AMD revenue over the years", "AMD vs intel, then NVDA", "is ON better than micron on margins", "What are its competitors?", None, "on and on", "Advanced Micro beats INTC"]
    rows = spark.createDataFrame(list(enumerate(asked)), "id int, t string")
    got = {r.id: (r.named, r.mode) for r in questions.named_companies(rows, "id", "t", aliases).select("id", "named", questions.comparison_mode(F.col("t"), F.col("named"), F.lit("NVDA")).alias("mode")).collect()}
    assert got == {0: (["INTC", "AMD"], "explicit"), 1: (["AMD", "INTC", "NVDA"], "explicit"), 2: (["ON", "MU"], "explicit"), 3: ([], "peer"), 4: ([], None), 5: ([], None), 6: (["AMD", "INTC"], "explicit")}


def test_choice_tasks_differ(spark):
    from quillspark.operators import governance
    from quillspark.plans.governance import LEVELS

    rows = governance.choice_tasks(40, LEVELS, 5, spark).collect()
    assert len(rows) == 40 and all(r.profile_a != r.profile_b for r in rows)


def test_statements_that_may_run(spark):
    from quillspark.operators import sqlguard

    said = ["SELECT 1", "```sql\nWITH a AS (SELECT 1) SELECT * FROM a -- fine\n```", "```\nSELECT 2", "DROP TABLE x", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/tmp/x`", "SELECT reflect('a', 'b')", "", "```"]
    assert [sqlguard.refusal(t) is None for t in said] == [True, True, True, False, False, False, False, False, False]


def test_ranges_hold_bounded_rows(spark):
    """As many rows a range whatever the values: distinct ones, and one that a third of all rows share."""
    df = spark.range(9000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.rand(3)).alias("v"))
    coarse = relational.ordered_ranges(df, -F.col("v"), F.col("id"), 32, 1000)
    sizes = [r[0] for r in df.groupBy(*coarse).count().select("count").collect()]
    assert max(sizes) < 900 and len(sizes) < 80
    got = relational.prefix_sums(df, [], coarse, [-F.col("v"), F.col("id")], {"n": F.lit(1)}).orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 9001)) and [(r.v, r.id) for r in got] == sorted(((r.v, r.id) for r in got), key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize(
    ("sql", "why"),
    [
        ("SELECT a, count(*) FROM t WHERE a > 1 GROUP BY a HAVING count(*) > 1 ORDER BY a LIMIT 3", None),
        ("WITH w AS (SELECT * FROM t) SELECT x.a, upper(x.b) FROM w x JOIN t y ON x.a = y.a WHERE x.a IN (SELECT a FROM t) AND EXISTS (SELECT 1 FROM w)", None),
        ("SELECT a, row_number() OVER (PARTITION BY b ORDER BY a) FROM t UNION ALL SELECT 1, 2", None),
        ("SELECT * FROM (VALUES (1, 2)) v(a, b)", None),
        ("SELECT * FROM secrets", "tables: secrets"),
        ("SELECT a FROM t WHERE a = (SELECT max(a) FROM other.t)", "tables: other.t"),
        ("SELECT * FROM parquet.`/tmp/x`", "tables: parquet./tmp/x"),
        ("SELECT * FROM information_schema.tables", "tables: information_schema.tables"),
        ("WITH w AS (SELECT * FROM hidden) SELECT * FROM w", "tables: hidden"),
        ("SELECT reflect('java.lang.System', 'exit', 0) FROM t", "functions: reflect"),
        ("SELECT a FROM t WHERE a IN (SELECT java_method('a', 'b') FROM t)", "functions: java_method"),
        ("DROP TABLE t", "not a question"), ("INSERT INTO t SELECT 1, 2", "not a question"), ("CREATE VIEW v AS SELECT 1", "not a question"), ("SET a = 1", "not a question"),
        ("SELECT a FROM t WHERE (", "does not parse"),
    ],
)
def test_parsed_plans_are_checked(spark, sql, why):
    from quillspark.operators import sqlguard

    got = sqlguard.plan_refusal(spark, sql, ["t"])
    assert got == why or (why and got and got.startswith(why)), got


def test_guarded_query_runs_on_known_tables_only(spark):
    from quillspark.operators import sqlguard

    spark.range(5).createOrReplaceTempView("known_ids")
    assert sqlguard.run_read_only(spark, "SELECT id FROM known_ids WHERE id > :n", n=2).count() == 2
    with pytest.raises(ValueError, match="tables"):
        sqlguard.run_read_only(spark, "SELECT id FROM unknown_ids")
    with pytest.raises(ValueError, match="tables"):
        sqlguard.run_read_only(spark, "SELECT id FROM known_ids", tables=["other"])
