"""Small cases of the findings of round 3, each of which failed before."""

import datetime
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions.numbers import exact_sum
from quillspark.functions import vectors as V
from quillspark.operators import dictionary, quality, retrieval, sqlguard, textindex
from quillspark.plans import catalogue


def test_ranks_do_not_follow_the_order_of_rows(spark, tmp_path):
    """Two suppliers with the same line items in opposite order, whose ratio 4.53125 lies between two of four digits."""
    items = [(3.0, 0.07, 6), (5.0, 0.02, 5), (5.0, 0.03, 2), (3.0, 0.07, 1), (7.0, 0.05, 5), (2.0, 0.07, 3), (9.0, 0.01, 3), (3.0, 0.01, 7)]
    day = datetime.datetime(2000, 1, 1)
    rows = [(company, n, q, 1.0, 0.0, t, "N", day) for company, some in ((1, items[::-1]), (2, items)) for q, t, n in some]
    kind = "l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted((r["rank"], r.company, r.value) for r in catalogue.QUERIES["peer_rank"](spark, str(tmp_path)).collect())
    assert got == [(1, 1, 4.5313), (2, 2, 4.5313)]


def test_exact_sum_loses_no_value(spark):
    total = lambda *v: spark.createDataFrame([(x,) for x in v], "x double").agg(exact_sum(F.col("x"))).first()[0]
    assert total(0.1, 0.2, 0.3) == total(0.3, 0.2, 0.1) == 0.6
    assert total(1e30, 0.5, None) == 1e30 + 0.5 and total(None) is None and total(float("inf"), 1.0) == float("inf")


@pytest.mark.parametrize("name", ["schema_checks", "cross_validate", "route_decision", "trigger_counts", "shadow_histogram"])
def test_no_field_is_a_row_of_a_shuffle(spark, name):
    """A record's fields stay in its row; only the triggers of trigger_counts are made rows, after the last shuffle of records."""
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == (name == "trigger_counts")


def test_records_that_come_twice_are_one(spark, tmp_path):
    """One row a record_id, as in the SQL, also where the orders hold a row twice; a record's facts decide once."""
    one = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    one.union(one.limit(40)).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("schema_checks", "semantic_checks", "cross_validate", "route_decision"):
        got = sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).collect()))
        assert got == sorted(map(tuple, catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").collect()))


def test_facts_by_period(spark):
    rows = [("1", "A", "p", 1.0), ("1", "B", "p", 2.0), ("2", "A", "p", None)]
    got = quality.facts_by_period(spark.createDataFrame(rows, "cik string, concept string, period string, filed_value double"))
    assert {(r.cik, r.period): r.facts for r in got.collect()} == {("1", "p"): {"A": 1.0, "B": 2.0}, ("2", "p"): {"A": None}}


def test_a_text_is_judged_once_a_task(spark):
    """Each call of this check gives another reason, so equal reasons come from one call; long texts are not remembered."""
    texts = spark.range(600).coalesce(1).select(F.when(F.col("id") % 4 == 3, F.lit("9" * (sqlguard.LONG + 1))).when(F.col("id") % 4 < 2, F.concat((F.col("id") % 4).cast("string"), F.lit(" + 1"))).alias("t"))
    got = texts.select("t", sqlguard.refusals(F.col("t"), lambda t: uuid.uuid4().hex).alias("why")).groupBy("t").agg(F.countDistinct("why").alias("n")).collect()
    assert {(r.t or "")[:3]: r.n for r in got} == {"0 +": 1, "1 +": 1, "": 1, "999": 150}


def test_tiles_equal_every_pair(spark):
    """Copies, near ties, other sizes and unusable vectors: tiles give what measuring every pair gives, to the last bit."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8)).astype(np.float32)
    vectors = [base[i % 40] * (1 if i % 3 else np.float32(1 + 1e-7)) for i in range(400)]
    rows = [(i, [float(x) for x in v][: 5 if i % 41 == 7 else 8]) for i, v in enumerate(vectors)] + [(900, None), (901, [float("nan")] * 8), (902, [None] * 8), (903, [])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    q = df.filter("id % 9 = 0").withColumnRenamed("id", "q")
    pairs = df.filter("id < 900").crossJoin(q.filter("q < 900").withColumnRenamed("v", "w")).filter(F.size("v") == F.size("w")).select("q", "id", V.l2(F.col("v"), F.col("w")).alias("distance"))
    want = {}
    for r in sorted(pairs.collect(), key=lambda r: (r.q, r.distance, r.id)):
        want.setdefault(r.q, []).append((r.q, r.id, r.distance))
    for size in (16, 10_000):
        got = sorted((r.q, r.id, r.distance) for r in retrieval.knn_batch(df, q, "id", "q", "v", 6, size).collect())
        assert got == sorted(r for some in want.values() for r in some[:6])


def test_tiles_in_several_steps(monkeypatch):
    rng = np.random.default_rng(6)
    x, q = rng.integers(0, 4, (300, 3)).astype(float), rng.integers(0, 4, (70, 3)).astype(float)
    plain = lambda i: sorted((float(np.sqrt(((x[j] - q[i]) ** 2).sum())), j) for j in range(300))[:5]
    monkeypatch.setattr(retrieval, "SOME_QUERIES", 16)
    monkeypatch.setattr(retrieval, "SOME_PAIRS", 160)
    i, j, d = retrieval.tile_best(x, q, 5)
    assert [(a, b, int(c)) for a, b, c in zip(i, d, j)] == [(n, a, b) for n in range(70) for a, b in plain(n)]


def test_searches_make_no_row_a_pair(spark):
    for name in ("knn_batch", "vector_index_exact"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "CoGroup" in plan and "zip_with" not in plan


@pytest.mark.parametrize("most", [10_000, 0])
def test_grams_begin_where_an_alias_does(spark, monkeypatch, most):
    """The same mentions with and without the list of first words, and with it a row only for what may be one."""
    monkeypatch.setattr(dictionary, "FIRST_WORDS", most)
    texts = [(1, "Alpha beta, alpha  beta and ALPHA BETA gamma; o'neil"), (2, "ΟΔΟΣ.Α οδοσ.α beta alpha"), (3, None), (4, "nothing " * 50)]
    aliases = [("alpha beta", "A"), ("Beta Gamma", "B"), ("ΟΔΟΣ.Α", "C"), ("o'neil", "D"), ("beta", "E")]
    found = dictionary.mentions(spark.createDataFrame(texts, "id int, t string"), "id", "t", spark.createDataFrame(aliases, "alias string, value string"))
    got = sorted((r.id, r.place, r.value) for r in found.collect())
    assert got == [(1, 0, "A"), (1, 2, "E"), (1, 6, "E"), (1, 10, "A"), (1, 12, "B"), (1, 12, "E"), (1, 16, "D"), (2, 0, "C"), (2, 4, "C"), (2, 8, "E")]
    assert ("INSET" in found._jdf.queryExecution().optimizedPlan().toString() or " IN (" in found._jdf.queryExecution().optimizedPlan().toString()) == (most > 0)


def test_terms_are_counted_where_the_text_is(spark):
    """Word for word what a count of words gives, without a shuffle."""
    rows = [(1, ["a", "b", "a"]), (2, []), (3, ["ß", "a", "ß", "ß"]), (4, None)]
    got = textindex.terms_of(spark.createDataFrame(rows, "key long, _t array<string>").coalesce(1))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3, "a", 2), (1, 3, "b", 1), (3, 4, "a", 1), (3, 4, "ß", 3)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
