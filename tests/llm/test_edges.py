"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns: every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import exact_dedup, fim, importance, language_id, license_scan, near_dedup, packing, quality, secret_scan, sp_codec, toxicity, url_filters
from quillspark.llm.queries import vocabulary

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
LONG = " ".join(WORDS[i * i % 12] + str(i % 977) for i in range(60_000))
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, kept string, score string, n_words string, sequence_id string, _h string, rep string, label string"


def rows():
    texts = [None, "", " \n\t", "12345 !!", "a", "two words", LONG, "the same text here", "the same text here", "É ß 中文 😀 ﬁ", "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", "x" * 50_000]
    out = [(i, t, "en" if i % 2 else None, "s", len(t or ""), "k", "k", "s", "n", "q", "h", "r", "l") for i, t in enumerate(texts)]
    return [*out, out[7], (None, "no id here", None, None, None, *[None] * 8), (None, None, None, None, None, *[None] * 8)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SHAPE)


OPERATORS = {
    "exact_dedup": exact_dedup.exact_dedup,
    "fill_in_middle": fim.fill_in_middle,
    "importance": lambda d: importance.resample(d, d.select("text"), chunk=4096),
    "language_id": language_id.train_and_identify,
    "license_scan": license_scan.scan_licenses,
    "near_dedup": lambda d: near_dedup.near_dedup(d, 3, 85),
    "quality": quality.quality_rules,
    "secret_scan": secret_scan.scan_secrets,
    "sp_codec": lambda d: sp_codec.encode_documents(d, vocabulary("piece_bpe_32k.model")),
    "toxicity": lambda d: toxicity.train_and_score(d, d.select("doc_id", F.lit(None).cast("int").alias("toxic"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_a_document(docs, name):
    assert OPERATORS[name](docs).count() == len(rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, name):
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_packing(docs):
    out = packing.pack_documents(docs, vocabulary("word_bpe_49k.json")).collect()
    assert {r.doc_id for r in out} == {r[0] for r in rows()}
    assert [(r.start, r.length) for r in out if r.doc_id == 0] == [(0, 1)]
    assert packing.pack_documents(docs.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_exact_decisions(docs):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()}
    assert {(0, 1, 3, False), (1, 1, 3, True), (None, 1, 3, False), (7, 8, 3, False), (8, 8, 3, True), (2, 2, 1, True), (None, None, 1, True)} <= got


def test_near_decisions(docs):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(docs, 3, 85).collect()}
    assert {(0, 0, 0, True), (2, 0, 2, True), (4, 1, 4, True), (7, 2, 7, True), (8, 2, 7, False), (None, 1, None, True)} <= got


def test_languages(docs):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.train_and_identify(docs.filter("doc_id is not null")).collect()}
    assert all(got[i] == ("und", 0.0) for i in (0, 1, 2, 3)) and got[5][0] == "en"


def test_quality_of_short_texts(docs):
    got = {r.doc_id: r for r in quality.quality_rules(docs.filter("doc_id is not null")).collect()}
    assert got[0].base_failed and not got[0].kept and got[0].n_words == 0 and got[0].char_divergence is None


def test_no_labels_no_verdict(docs):
    assert {(r.score, r.predicted) for r in OPERATORS["toxicity"](docs).collect()} == {(0.25, 0)}


def test_urls(spark):
    captures = spark.createDataFrame([(1, None, "2024-01-01"), (2, "http://", "2024-01-01"), (3, "https://a.b.com/x", None), (4, "https://a.b.com", "2024-01-05"), (4, "https://a.b.com", "2024-01-05"), (5, "http://u:p@A.B.com:80/", "2024-01-09")], "page_id long, url string, fetched string").withColumns({"fetched": F.col("fetched").cast("date"), "list_key": F.lit("x"), "kept": F.lit("x")})
    entries = spark.createDataFrame([("b.com", "block", "2024-01-04"), ("b.com", "allow", "2024-01-08"), ("b.com", "block", "2024-01-08"), ("a.b.com", "allow", "2024-01-09"), (None, "block", "2024-01-01"), ("b.com", "block", None)], "list_key string, action string, since string").withColumn("since", F.col("since").cast("date"))
    got = sorted((r.page_id, r.list_key, r.kept) for r in url_filters.filter_urls(captures, entries).select("page_id", F.coalesce("list_key", F.lit("")).alias("list_key"), "kept").collect())
    assert got == [(1, "", True), (2, "", True), (3, "", True), (4, "b.com", False), (4, "b.com", False), (5, "a.b.com", True)]
    assert url_filters.filter_urls(captures.limit(0), entries).count() == 0
    assert url_filters.filter_urls(captures, entries.limit(0)).filter("kept").count() == 6


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, docs, empty):
    d, columns = docs.limit(0) if empty else docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, "")
        if name != "packing":
            assert d.columns == columns
    assert d.count() == 0 if empty else d.count() > 0
