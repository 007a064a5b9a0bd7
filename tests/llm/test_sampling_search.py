"""Importance resampling, fill-in-middle and exact top-k against plain versions, and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import fim, importance, queries, topk
from quillspark.llm.common import table

SF = "/root/testdata/sf0.001"


def counted(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, Counter(" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1))


def plain_resample(docs, target, n=1, buckets=10_000, percent=10, least=20, seed=2024):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    total = lambda texts: sum(map(hashed, texts), Counter())

    def hashed(text):
        out = Counter()
        for g, c in counted(text, n)[1].items():
            out[bucket(g)] += c
        return out

    s, t = total([x for _, x in docs]), total(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for key, text in docs:
        words, grams = counted(text, n)
        size = sum(grams.values())
        weight = sum(gain[bucket(g)] * c for g, c in grams.items()) // size if size else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, size, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = [(*r[:4], i + 1) for i, r in enumerate(fit[: percent * len(fit) // 100])]
    return sorted([*drawn, *[(*r[:4], None) for r in fit[len(drawn) :]], *[(*r[:4], None) for r in rows if r[4] < least]], key=str)


def test_op11(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    target = [r.text for r in table(spark, SF, "benchmark").collect()]
    got = queries.QUERIES["op11_importance_resampling"](spark, SF)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, got.collect()), key=str) == plain_resample(docs, target)


@pytest.mark.parametrize("n", [1, 2, 4])
@pytest.mark.parametrize("chunk", [7, 300])
def test_chunks_count_each_feature_once(spark, n, chunk):
    rng = random.Random(n * chunk)
    text = lambda k: "".join(rng.choice(["Ab", "b", "ç漢", " ", "  ", "-", "\n", "9"]) for _ in range(k))
    docs = [(i, text(rng.choice([0, 3, 40, 900]))) for i in range(40)] + [(41, None), (None, text(50)), (42, "... !"), (43, "x" * 5000)]
    docs += [docs[3], docs[3], docs[-2], (3, text(300))]
    target = [text(400), None, ""]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("x"), "rank": F.lit("x"), "digest": F.lit(1)}).repartition(3)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.resample(d.select("doc_id", "text"), t, n, 101, 30, 5, chunk=chunk).collect()
    assert sorted(map(tuple, got), key=str) == plain_resample(docs, target, n, 101, 30, 5)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none.select("text")).count() == 0
    one = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert [tuple(r) for r in importance.resample(one, none.select("text"), percent=100).collect()] == plain_resample([(1, "a " * 30)], [], percent=100)


def test_common_word_and_copies_spread(spark):
    """A third of all rows are one long text: chunks are dealt out, and every copy gets the result of one."""
    rng = random.Random(1)
    docs = [(5, " ".join(str(rng.random()) for _ in range(1000)))] * 30 + [(i, "the cat sat " * 50) for i in range(60)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = importance.resample(d, spark.createDataFrame([("the dog",)], "text string"), chunk=1000).collect()
    assert sorted(map(tuple, got), key=str) == plain_resample(docs, ["the dog"])
    parts = [r[0] for r in importance.pieces(d, 1, 1000)[1].groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(parts) > 500 and max(parts) <= 0.4 * sum(parts)


def plain_fim(text, key, unit, seed=7, percent=100, spm=50):
    text = text or ""
    units = re.findall(unit, text)
    h = [int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return n, *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


ODD = ["", None, "\n", "\n\n\n", "a", "a\n", "a\nb", "x <P> y\nz", "<M>", "<", "<P", "P>\nS>\n<S\n", "é漢😀\n\r\n \nß", "\0\n\0", "word " * 40_000, "line\n" * 30_000]


@pytest.mark.parametrize("unit", [fim.LINES, r"\S+\s*|\s+", r"(?s)."])
def test_fill_in_middle(spark, unit):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(9, ODD[9]), (None, "a\nb\nc"), (None, None)] + [(100 + i, f"{i}\n" * (i % 7)) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"output": F.lit(1), "form": F.lit("x"), "n": F.lit(2)})
    turned = fim.fill_in_middle(d, unit, percent=80, spm_percent=40)
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in turned.collect()]
    assert sorted(got, key=str) == sorted([(k, *plain_fim(t, k, unit, percent=80, spm=40)) for k, t in rows], key=str)
    back = turned.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(map(tuple, back), key=str) == sorted([(k, t or "") for k, t in rows], key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(d.limit(0)).count() == 0


def test_units_are_never_held():
    """The matcher keeps no units: a pass over two million lines takes little besides the text."""
    import tracemalloc

    text = "\n" * 2_000_000
    tracemalloc.start()
    n, form, a, m, out = fim.transformed(text, 1, re.compile(fim.LINES), fim.Marks(), 7, 100, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(text) and len(out) == len(text) + 9 and peak < 4 * len(text)


@pytest.mark.parametrize("marks", [("a", "a", "b"), ("", "b", "c"), ("<a<", "<b>", "<c>"), ("xy", "yz", "q"), ("ab", "b", "c")])
def test_marks_that_could_be_mistaken(marks):
    with pytest.raises(ValueError):
        fim.Marks(*marks)


def test_op12(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = con.sql(fim.ORACLE_SQL).fetchall()
    assert sorted(map(tuple, queries.QUERIES["op12_fill_in_middle"](spark, SF).collect())) == sorted(want)


def plain_topk(rows, k, asked, scale=1024):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, q in good:
        if asked(qi):
            scored = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(q, c, strict=True)))), i) for i, c in good if i != qi and len(c) == len(q))
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("size", [(512, 2000, 4), (1 << 16, 1 << 27, 64)])
def test_topk_with_odd_vectors(spark, size, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 16)
    rng = random.Random(3)
    vector = lambda n, far=1.0: [rng.uniform(-far, far) for _ in range(n)]
    rows = [(i, vector(8)) for i in range(150)] + [(1000 + i, [0.5] * 8) for i in range(120)] + [(2000 + i, vector(8, 10.0 ** (i % 12))) for i in range(60)]
    rows += [(10, None), (None, vector(8)), (20, [1.0, None] * 4), (30, [math.nan] * 8), (40, [math.inf] * 8), (50, []), (60, []), (70, vector(3)), (71, vector(3)), (80, vector(8)), (80, [0.5] * 8), (-100, [0.5] * 8), (3000, [1e300] * 8), (3001, [-1e300] * 8), (3010, [-1e-9] * 8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "is_query": F.lit("x"), "size": F.lit("x")}).repartition(3)
    got = topk.exact_topk(d, F.col("vec_id") % 10 == 0, 5, blob=size[0], shard=size[1], fan=size[2])
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == plain_topk(rows, 5, lambda i: i % 10 == 0)
    assert topk.exact_topk(d.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert topk.exact_topk(d, F.lit(False)).count() == 0


@pytest.mark.parametrize("bound", [100, 30_000, 2**40])
def test_products_are_exact(bound):
    rng = np.random.default_rng(1)
    q, c = rng.integers(-bound, bound, (7, 300)), rng.integers(-bound, bound, (40, 300))
    kind = topk.level(topk.norm(q) * topk.norm(c))
    want = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in c] for x in q]
    got = topk.products(q.astype(np.float64), c.astype(np.float64), kind)
    assert [[int(v) for v in row] for row in got] == [[max(-topk.MOST, min(topk.MOST, v)) for v in row] for row in want]


def test_op13(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    assert sorted(map(tuple, queries.QUERIES["op13_exact_topk"](spark, SF).collect())) == sorted(con.sql(topk.ORACLE_SQL).fetchall())
