"""Stored indexes: recall and pruning of vectors, postings and their upkeep, against plain versions."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import textindex as I
from quillspark.operators import vectorindex as X
from quillspark.plans import catalogue
from quillspark.plans.registry import table

SF = "/root/testdata/sf0.1"


def scanned(df):
    """Text of the scans in a plan."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('ivf')}"
    e = table(spark, SF, "embeddings")
    X.build(e.filter("vec_id % 3 > 0"), "vec_id", "embedding", folder)
    X.add(e.filter("vec_id % 3 = 0"), "vec_id", "embedding", folder)
    return folder


def queries(spark):
    return table(spark, SF, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def brute(spark, k):
    rows = table(spark, SF, "embeddings").orderBy("vec_id").select("vec_id", "embedding").collect()
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    return {(int(i), int(j)) for i, v in zip(ids, m, strict=True) if i % 50 == 0 for j in ids[np.lexsort((ids, ((m - v) ** 2).sum(1)))[:k]]}


def test_recall_of_probed_lists(spark, index):
    assert spark.read.parquet(f"{index}/vectors").count() == table(spark, SF, "embeddings").count()
    lists = len(X.centers_of(spark, index))
    want = brute(spark, 10)
    probes = X.probes_for(table(spark, SF, "embeddings"), "vec_id", "embedding", index, 10, sample=100)
    got = {(r.query_id, r.key) for r in X.search(queries(spark), "query_id", "embedding", index, 10, probes).collect()}
    assert len(got & want) / len(want) >= 0.9 and probes < lists
    assert {(r.query_id, r.key) for r in X.search(queries(spark), "query_id", "embedding", index, 10, lists).collect()} == want


def test_only_probed_lists_are_read(spark, index):
    one = X.search(queries(spark).limit(1), "query_id", "embedding", index, 10, 3)
    plan = scanned(one)
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan, plan
    read = spark.read.parquet(f"{index}/vectors").filter(F.col("list").isin(*range(3))).count()
    assert read < table(spark, SF, "embeddings").count() / 2 and one.count() == 10


def test_registered_search_finds_nine_of_ten(spark):
    got = {(r.query_id, r.vec_id) for r in catalogue.QUERIES["vector_index_search"](spark, SF).collect()}
    want = brute(spark, 10)
    assert len(got & want) / len(want) >= 0.9


def test_clustered_vectors_need_few_lists(spark, tmp_path):
    rng = np.random.default_rng(2)
    middles = rng.normal(0, 1, (30, 16))
    rows = [(i, (middles[i % 30] + rng.normal(0, 0.1, 16)).tolist()) for i in range(1500)]
    d = spark.createDataFrame(rows, "id long, v array<double>")
    X.build(d, "id", "v", f"file://{tmp_path}/x", lists=30)
    probes = X.probes_for(d, "id", "v", f"file://{tmp_path}/x", 10, sample=60)
    asked = d.filter("id % 25 = 0")
    got = {(r.id, r.key) for r in X.search(asked, "id", "v", f"file://{tmp_path}/x", 10, probes).collect()}
    want = {(r.id, r.key) for r in X.search(asked, "id", "v", f"file://{tmp_path}/x", 10, 30).collect()}
    assert probes <= 6 and len(got & want) / len(want) >= 0.9


def test_index_of_odd_rows(spark, tmp_path):
    rows = [(i, [float(i), 0.0]) for i in range(6)] + [(10, None), (11, [1.0]), (12, [float("nan"), 0.0]), (13, [1.0, None]), (14, [])] + [(100 + i, [9.0, 9.0]) for i in range(50)]
    d = spark.createDataFrame(rows, "id long, v array<double>")
    X.build(d, "id", "v", f"file://{tmp_path}/x", lists=4)
    X.add(d.filter("id = 3"), "id", "v", f"file://{tmp_path}/x", part_rows=1)
    got = [(r.id, r.key, r.distance) for r in X.search(d.filter("id in (3, 10, 11, 12)"), "id", "v", f"file://{tmp_path}/x", 4, 4).orderBy("rank").collect()]
    assert got == [(3, 3, 0.0), (3, 3, 0.0), (3, 2, 1.0), (3, 4, 1.0)]
    with pytest.raises(ValueError):
        X.build(d.filter("id = 10"), "id", "v", f"file://{tmp_path}/y")


# ---- text index


def filled(spark, folder, docs):
    index = I.TextIndex(spark, folder)
    index.add(docs, "doc_id", "text", "source", F.col("source"))
    return index


def plain_bm25(rows, questions, k, boost=2.0):
    """rows: key, label, text; questions: key, text, label."""
    tokens = {key: (text or "").lower().split() for key, _, text in rows}
    labels = {key: label for key, label, _ in rows}
    n, mean = len(rows), sum(map(len, tokens.values())) / len(rows)
    tf = {key: Counter(t) for key, t in tokens.items()}
    df = Counter(t for c in tf.values() for t in c)
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else low for t, v in raw.items()}
    out = []
    for q, text, label in questions:
        scores = []
        for key, c in tf.items():
            s = sum(idf[t] * m * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * len(tokens[key]) / mean)) for t, m in Counter(text.lower().split()).items() if t in c)
            scores.append((-round(s * (boost if label is not None and labels[key] == label else 1.0), 9), key))
        out += [(q, key, round(-s, 6), r + 1) for r, (s, key) in enumerate(sorted(scores)[:k])]
    return sorted(out)


WORDS = [f"w{i}" for i in range(60)] + ["the", "of"]


def some_docs(n, seed=1):
    rng = np.random.default_rng(seed)
    pick = lambda m: " ".join(WORDS[int(i)] for i in np.minimum(rng.geometric(0.06, m) - 1, 59))
    return [(i, f"s{i % 7}", pick(int(rng.integers(0, 40))) + (" The of" if i % 9 else "")) for i in range(n)] + [(n, "s1", None), (n + 1, None, ""), (n + 2, "s2", "w1 w1 w1 w59")]


ASKED = [(1, "the W1 w2", None), (2, "w58 w57 w57 of", "s3"), (3, "unknown words", "s1"), (4, "", None), (5, "w59", "s2"), (6, " ".join(WORDS), "s1")]


@pytest.mark.parametrize("pruned", [False, True])
def test_index_equals_plain_bm25(spark, tmp_path, monkeypatch, pruned):
    monkeypatch.setattr(I, "PRUNED_ROWS", 0 if pruned else 10**9)
    rows = some_docs(400)
    index = filled(spark, f"file://{tmp_path}/i", spark.createDataFrame(rows, "doc_id long, source string, text string"))
    questions = spark.createDataFrame(ASKED, "q long, t string, label string")
    for k in (3, 25):
        got = index.search(questions, "q", "t", k, "label").collect()
        assert sorted((r.q, r.key, round(r.score, 6), r.rank) for r in got) == plain_bm25(rows, ASKED, k)


def test_blocks_below_the_bound_stay_closed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "PRUNED_ROWS", 0)
    index = filled(spark, f"file://{tmp_path}/i", spark.createDataFrame(some_docs(2000), "doc_id long, source string, text string"))
    wanted = spark.createDataFrame([(1, None, "w5", 1)], "_q long, _label string, term string, times long").withColumn("bucket", I.bucket(F.col("term")))
    opened = []
    monkeypatch.setattr(I.TextIndex, "opened", lambda self, blocks, *a, keep=I.TextIndex.opened: (opened.append(blocks), keep(self, blocks, *a))[1])
    index.hits(wanted, 5, 1.0).collect()
    every = index.read("blocks").filter("term = 'w5'").agg(F.sum("df")).first()[0]
    assert opened[-1].agg(F.sum("df")).first()[0] < every


def test_upkeep_by_filing(spark, tmp_path, monkeypatch):
    rows = some_docs(200)
    frame = lambda r: spark.createDataFrame(r, "doc_id long, source string, text string")
    index = filled(spark, f"file://{tmp_path}/i", frame(rows[:120]))
    index.add(frame(rows[120:]), "doc_id", "text", "source", F.col("source"))
    index.remove(spark.createDataFrame([("s1",), ("s4",), ("none",)], "f string"))
    again = [(i if i % 2 else 10_000 + i, "s4", f"{t} w3") for i, s, t in rows if s == "s4"]  # some with the keys that they had
    index.add(frame(again), "doc_id", "text", "source", F.col("source"))
    left = [r for r in rows if r[1] not in ("s1", "s4")] + again
    ask = lambda i: sorted((r.q, r.key, round(r.score, 6), r.rank) for r in i.search(spark.createDataFrame(ASKED, "q long, t string, label string"), "q", "t", 6, "label").collect())
    assert ask(index) == plain_bm25(left, ASKED, 6)

    index.remove(spark.createDataFrame([("s4",)], "f string"))
    index.add(frame(again), "doc_id", "text", "source", F.col("source"))
    assert ask(index) == plain_bm25(left, ASKED, 6)

    def fails(*_):
        raise RuntimeError

    with monkeypatch.context() as m:  # a writer that stops halfway leaves what readers see as it was
        m.setattr(I.TextIndex, "finish", fails)
        with pytest.raises(RuntimeError):
            index.add(frame([(50_000, "s9", "w1 w2")]), "doc_id", "text", "source")
    index = I.TextIndex(spark, index.folder)
    assert ask(index) == plain_bm25(left, ASKED, 6)
    index.add(frame([(50_000, "s9", "w1 w2")]), "doc_id", "text", "source")
    assert ask(index) == plain_bm25([*left, (50_000, "s9", "w1 w2")], [(q, t, lb) for q, t, lb in ASKED], 6)


def test_only_the_buckets_of_the_terms_are_read(spark, tmp_path):
    index = filled(spark, f"file://{tmp_path}/i", spark.createDataFrame(some_docs(50), "doc_id long, source string, text string"))
    plan = scanned(index.search(spark.createDataFrame([(1, "w3")], "q long, t string"), "q", "t", 3))
    assert plan.count("PartitionFilters: [isnotnull(bucket") + plan.count("PartitionFilters: [bucket") + plan.count("PartitionFilters: [(bucket") >= 2, plan


def test_kept_index_is_made_once(spark, tmp_path):
    made = []
    path = f"{tmp_path}/d.parquet"
    spark.createDataFrame([(1, "s", "a b")], "doc_id long, source string, text string").write.parquet(path)

    def make(index):
        made.append(1)
        index.add(spark.read.parquet(path), "doc_id", "text")

    for i in range(2):
        I.kept_index(spark, path, f"file://{tmp_path}/k{i}", make)
    assert len(made) == 1
    spark.createDataFrame([(2, "s", "a c")], "doc_id long, source string, text string").write.mode("append").parquet(path)
    I.kept_index(spark, path, f"file://{tmp_path}/k9", make)
    assert len(made) == 2
