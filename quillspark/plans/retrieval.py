"""Retrieval queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import vectors as V
from quillspark.operators import dictionary as D
from quillspark.operators import retrieval as R
from quillspark.operators import textindex as I
from quillspark.operators import vectorindex as X
from quillspark.plans.registry import query, table, texts_table
from quillspark.plans.storage import scratch

QUESTION = "the and that with from the unge"
TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\v]+'), lambda x: x <> '')"
BM25_SQL = f"""
tok AS (SELECT doc_id, source, {TOKENS} AS t FROM documents),
len AS (SELECT doc_id, source, len(t) AS dl FROM tok),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, corpus GROUP BY term, n),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
q AS (SELECT term, count(*) AS times FROM (SELECT unnest(string_split('{QUESTION}', ' ')) AS term) GROUP BY term),
s AS (SELECT tf.doc_id, sum(idf * times * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN q USING (term) JOIN idf USING (term) JOIN len USING (doc_id), corpus GROUP BY tf.doc_id),
b AS (SELECT len.doc_id, round(coalesce(score, 0) * CASE WHEN source = 'src3' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END, 9) AS score FROM len LEFT JOIN s ON s.doc_id = len.doc_id)"""


@query(f"WITH {BM25_SQL} SELECT doc_id, round(score, 5) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 25")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 with a source boost."""
    return words_found(spark, sf_dir, 25).select("doc_id", F.round("score", 5).alias("score"))


def text_index(spark: SparkSession, sf_dir: str) -> I.TextIndex:
    """The index of all documents, made once (S50): filings are documents, labels are sources."""
    make = lambda index: index.add(texts_table(spark, sf_dir, "documents", "doc_id", "source", "text"), "doc_id", "text", "doc_id", F.col("source"))
    return I.kept_index(spark, f"{sf_dir}/documents.parquet", scratch(spark), make)


def words_found(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """doc_id, score, rank (from 1) of the fixed question's best documents."""
    one = spark.range(1).select(F.lit(QUESTION).alias("text"), F.lit("src3").alias("label"), F.lit(0).alias("q"))
    return text_index(spark, sf_dir).search(one, "q", "text", k, "label").select(F.col("key").alias("doc_id"), "score", "rank")


MANY_SQL = f"""
WITH tok AS (SELECT doc_id, source, {TOKENS} AS t FROM documents WHERE source NOT IN ('src1', 'src2')),
len AS (SELECT doc_id, len(t) AS dl FROM tok),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, corpus GROUP BY term, n),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, tf.doc_id, round(sum(idf * times * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM tf JOIN q USING (term) JOIN idf USING (term) JOIN len USING (doc_id), corpus GROUP BY ALL),
f AS (SELECT doc_id FROM len ORDER BY doc_id LIMIT 5),
u AS (SELECT * FROM s UNION ALL SELECT item_id, doc_id, 0.0 FROM benchmark, f WHERE (item_id, doc_id) NOT IN (SELECT (item_id, doc_id) FROM s))
SELECT item_id, doc_id, round(score, 5) AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY u.score DESC, doc_id) AS INTEGER) AS rank FROM u QUALIFY rank <= 5"""


@query(MANY_SQL)
def bm25_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a question, all in one plan, over an index that was kept up: filings were added in two
    generations, two of them taken out, and one of those added anew and taken out again."""
    d = texts_table(spark, sf_dir, "documents", "doc_id", "source", "text")
    index = I.TextIndex(spark, scratch(spark))
    index.add(d.filter("doc_id % 4 > 0"), "doc_id", "text", "source")
    index.add(d.filter("doc_id % 4 = 0"), "doc_id", "text", "source")
    gone = lambda *names: spark.createDataFrame([(n,) for n in names], "source string")
    index.remove(gone("src1", "src2"))
    index.add(d.filter("source = 'src1'"), "doc_id", "text", "source")
    index.remove(gone("src1"))
    found = index.search(table(spark, sf_dir, "benchmark"), "item_id", "text", 5)
    return found.select("item_id", F.col("key").alias("doc_id"), F.round("score", 5).alias("score"), "rank")


def probe() -> list[float]:
    """A fixed query vector."""
    return [((i * 37) % 19 - 9) / 50 for i in range(64)]


PROBE = "[" + ", ".join(f"{v}::FLOAT" for v in probe()) + "]"


@query(f"SELECT vec_id, round(CAST(list_distance(embedding, {PROBE}) AS DOUBLE), 3) AS distance FROM embeddings ORDER BY list_distance(embedding, {PROBE}), vec_id LIMIT 20")
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest vectors."""
    return R.knn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", probe(), 20).select("vec_id", F.round("distance", 3).alias("distance"))


@query(f"SELECT vec_id, round(1 - CAST(list_cosine_similarity(embedding, {PROBE}) AS DOUBLE), 3) AS distance FROM embeddings WHERE label < 5 ORDER BY list_cosine_similarity(embedding, {PROBE}) DESC, vec_id LIMIT 20")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By cosine, filtered before the search."""
    e = table(spark, sf_dir, "embeddings").filter("label < 5")
    return R.knn(e, "vec_id", "embedding", probe(), 20, "cosine").select("vec_id", F.round("distance", 3).alias("distance"))


@query(
    "WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0) SELECT query_id, vec_id, round(CAST(list_distance(embedding, q) AS DOUBLE), 3) AS distance FROM embeddings, q QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY list_distance(embedding, q), vec_id) <= 5"
)
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated set of queries against all vectors."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.knn_batch(e, queries, "vec_id", "query_id", "embedding", 5).select("query_id", "vec_id", F.round("distance", 3).alias("distance"))


def vector_index(spark: SparkSession, sf_dir: str) -> str:
    """The folder of an index over all embeddings: most rows stored first, those of label 7 added later."""
    e, folder = table(spark, sf_dir, "embeddings"), scratch(spark)
    X.build(e.filter("label <> 7"), "vec_id", "embedding", folder)
    X.add(e.filter("label = 7"), "vec_id", "embedding", folder)
    return folder


@query(
    "WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0) SELECT query_id, vec_id, round(CAST(list_distance(embedding, q) AS DOUBLE), 3) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY list_distance(embedding, q), vec_id) AS INTEGER) AS rank FROM embeddings, q QUALIFY rank <= 5"
)
def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index with all lists probed, which is exact; a part of the rows was added later."""
    queries = table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = X.search(queries, "query_id", "embedding", vector_index(spark, sf_dir), 5, X.MOST_LISTS)
    return found.select("query_id", F.col("key").alias("vec_id"), F.round("distance", 3).alias("distance"), "rank")


@query()
def vector_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many lists probed as sampled rows need for a recall of 0.9; a test measures what the queries get."""
    e, folder = table(spark, sf_dir, "embeddings"), vector_index(spark, sf_dir)
    queries = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    probes = X.probes_for(e, "vec_id", "embedding", folder, 10)
    return X.search(queries, "query_id", "embedding", folder, 10, probes).select("query_id", F.col("key").alias("vec_id"), "distance", "rank")


FUSE_SQL = f"""
WITH {BM25_SQL},
l1 AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM b QUALIFY rank < 30),
l2 AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents QUALIFY rank < 30),
u AS (SELECT 0 AS l, * FROM l1 UNION ALL SELECT 1, * FROM l2)
SELECT doc_id, round(sum(1.0 / (60 + rank + 1)), 6) AS score FROM u GROUP BY doc_id"""


@query(FUSE_SQL)
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused ranks of two lists."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    one = words_found(spark, sf_dir, 30).select("doc_id", (F.col("rank") - 1).alias("rank"))
    two = R.ranked(d.orderBy(F.desc("n_chars"), "doc_id").limit(30), [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "rank")
    return R.fuse([one, two], "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(
    f"""
WITH {BM25_SQL},
l1 AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM b QUALIFY rank < 20),
l2 AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY list_distance(embedding, {PROBE}), vec_id) - 1 AS rank FROM embeddings QUALIFY rank < 20),
u AS (SELECT 0 AS l, * FROM l1 UNION ALL SELECT 1, * FROM l2),
f AS (SELECT doc_id, sum(1.0 / (60 + rank + 1)) AS score, min(struct_pack(l := l, r := rank)) AS seen FROM u GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score FROM f ORDER BY f.score DESC, seen LIMIT 10"""
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and vector candidates (twice as many as asked for), fused, the best ten."""
    e = table(spark, sf_dir, "embeddings")
    words = words_found(spark, sf_dir, 20).select("doc_id", (F.col("rank") - 1).alias("rank"))
    near = R.ranked(R.knn(e, "vec_id", "embedding", probe(), 20), [F.col("distance"), F.col("vec_id")]).select(F.col("vec_id").alias("doc_id"), "rank")
    return R.fuse([words, near], "doc_id").limit(10).select("doc_id", F.round("score", 6).alias("score"))


ASKED = "Which erst this that with from whst"
KEY_SQL = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\\pL\\pN_]+'), lambda x: regexp_full_match(x, '[a-z]{{4,}}')))"


@query(
    f"""
WITH q AS (SELECT ['erst', 'whst'] AS k), d AS (SELECT doc_id, text, list_filter({KEY_SQL.format("text")}, lambda x: x NOT IN ('that', 'this', 'with', 'from', 'were', 'been', 'have', 'will', 'would', 'could', 'should', 'might', 'shall', 'what', 'which', 'when', 'where', 'than', 'then', 'also', 'about', 'after', 'before', 'between', 'during', 'into', 'through', 'each', 'every', 'both', 'more', 'most', 'other', 'some', 'such', 'only', 'same', 'very', 'just', 'because', 'does')) AS k FROM documents),
s AS (SELECT doc_id, text, CASE WHEN len(d.k) > 0 THEN len(list_intersect(d.k, q.k)) / least(len(d.k), len(q.k)) ELSE 0.0 END AS o FROM d, q)
SELECT doc_id, round(o, 6) AS overlap FROM s WHERE length(trim(text)) >= 50 AND o >= 0.15"""
)
def relevance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that share key words with a question."""
    from quillspark.functions import text as T

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = R.relevance_filter(d, "text", ASKED)
    return kept.select("doc_id", F.round(T.overlap(T.keywords(F.lit(ASKED)), T.keywords(F.col("text"))), 6).alias("overlap"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '\\b(berg|that)\\b', 'i') AND NOT regexp_matches(text, '\\bpour\\b', 'i') THEN CASE WHEN regexp_matches(text, '\\bberg\\b', 'i') THEN 'BRG' ELSE 'THT' END WHEN regexp_matches(text, '\\bberg\\b', 'i') THEN 'BRG' WHEN regexp_matches(text, '\\bpour\\b', 'i') THEN 'POU' WHEN regexp_matches(text, '\\bthat\\b', 'i') THEN 'THT' END AS ticker FROM conversations")
def ticker_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-word aliases in a text, the longest first, then by name; aliases need three letters."""
    known = [("that", "THT"), ("pour", "POU"), ("berg", "BRG"), ("on", "ON")]
    aliases = spark.createDataFrame([x for x in known if len(x[0]) >= 3], "alias string, value string")
    return D.longest_value(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", aliases, "ticker", D.ASCII_WORD).select("conv_id", "turn", "ticker")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'erst') OR contains(lower(text), 'chkeit') ORDER BY doc_id LIMIT 30")
def keyword_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9, L10."""
    return R.keyword_fallback(table(spark, sf_dir, "documents"), "doc_id", "text", "the erst of chkeit", 30).select("doc_id", "source")


@query("WITH t AS (SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3) SELECT user_id, count(*) AS n, min(event_type) AS first_type FROM t GROUP BY user_id")
def facts_as_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key's latest facts as one text, here taken apart again to its number of lines and smallest label."""
    e = table(spark, sf_dir, "events")
    order = F.struct("ts", "event_id").desc()
    texts = R.facts_as_text(e, ["user_id"], F.concat_ws(": ", "event_type", F.col("value").cast("string")), order, 3)
    lines = F.split("text", "\n")
    return texts.select("user_id", F.size(lines).cast("long").alias("n"), F.array_min(F.transform(lines, lambda x: F.split(x, ":")[0])).alias("first_type"))


@query("WITH u AS (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings) GROUP BY ALL), a AS (SELECT label, list(m ORDER BY i) AS m FROM u GROUP BY label) SELECT x.label, round(list_cosine_similarity(x.m, y.m), 4) AS similarity, CASE WHEN list_cosine_similarity(x.m, y.m) >= 0.95 THEN 'stable' WHEN list_cosine_similarity(x.m, y.m) >= 0.85 THEN 'minor' WHEN list_cosine_similarity(x.m, y.m) >= 0.7 THEN 'moderate' ELSE 'major' END AS band FROM a x JOIN a y ON x.label = y.label + 1")
def tone_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors of consecutive filings, their cosine and its band."""
    e = table(spark, sf_dir, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    pooled = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("m"))
    prior = pooled.select((F.col("label") + 1).alias("label"), F.col("m").alias("p"))
    s = V.cosine(F.col("m"), F.col("p"))
    return pooled.join(prior, "label").select("label", F.round(s, 4).alias("similarity"), F.when(s >= 0.95, "stable").when(s >= 0.85, "minor").when(s >= 0.7, "moderate").otherwise("major").alias("band"))
