"""Ingest and review-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import filings, texts
from quillspark.operators import missing as M
from quillspark.plans.registry import query, table, texts_table
from quillspark.plans.storage import scratch


@query()
def ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to text, sections, chunks and vectors in one plan."""
    pages = texts_table(spark, sf_dir, "pages", "page_id", "html").select("page_id", texts.html_to_text(F.col("html")).alias("text"))
    chunks = filings.with_vectors(filings.chunk_filings(pages, ["page_id"]), filings.hashed_vectors(64), "search_document: ")
    return chunks.select("page_id", "section_id", "section_type", "content_type", "chunk_index", "total_chunks", F.md5("text").alias("text_md5"), F.size("embedding").alias("dims"))


@query(
    """
WITH c AS (SELECT source, doc_id, coalesce(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM documents)
SELECT source, doc_id, CASE WHEN place >= 20000 THEN 'item_7' WHEN place >= 5000 THEN 'item_1a' ELSE 'full_text' END AS section_id FROM c"""
)
def retag_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks tagged by the anchors before them."""
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("chunk_index"), "text", F.lit("full_text").alias("section_id"))
    marks = F.array(F.struct(F.lit("item_1a").alias("section"), F.lit(5000).alias("start")), F.struct(F.lit("item_7").alias("section"), F.lit(20000).alias("start")))
    anchors = d.select("source").distinct().select("source", F.inline(marks))
    return filings.retag(d, ["source"], anchors).select("source", F.col("chunk_index").alias("doc_id"), "section_id")


@query("SELECT o_orderkey AS decision_id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'reviewed' ELSE 'pending' END AS status FROM orders")
def review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts are appended; a decision's status follows from whether it has one."""
    decisions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("decision_id"))
    verdicts = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("decision_id")).distinct().withColumn("_v", F.lit(True))
    return decisions.join(verdicts, "decision_id", "left").select("decision_id", F.when(F.col("_v"), "reviewed").otherwise("pending").alias("status"))


@query("SELECT o_custkey AS ticker, o_orderkey AS accession, count(*) AS n_fields, round(min(l_quantity), 2) AS least FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3) JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def extraction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts gathered into records of the latest three filings of a company, fields as structs."""
    from quillspark.operators.relational import top_per_key

    latest = top_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3)
    joined = latest.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    field = F.struct(F.col("l_linenumber").cast("string").alias("name"), F.col("l_quantity").alias("value"), F.lit("XBRL").alias("provenance"))
    records = joined.groupBy(F.col("o_custkey").alias("ticker"), F.col("o_orderkey").alias("accession")).agg(F.collect_list(field).alias("fields"))
    return records.select("ticker", "accession", F.size("fields").cast("long").alias("n_fields"), F.round(F.array_min(F.transform("fields", lambda f: f["value"])), 2).alias("least"))


@query(
    "WITH f AS (SELECT o_custkey, o_orderstatus = 'F' AS had, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL), t AS (SELECT o_custkey, o_orderpriority = '1-URGENT' AS had, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY ALL) "
    "SELECT c_custkey AS o_custkey, "
    + ", ".join(f"CASE WHEN {a}.n > 0 THEN 'kept' WHEN {b}.n > 0 THEN 'added' ELSE 'none' END AS {name}_state, coalesce({a}.n, {b}.n, 0) AS {name}_rows" for a, b, name in (("a", "b", "facts"), ("c", "d", "chunks")))
    + " FROM customer k LEFT JOIN f a ON a.o_custkey = c_custkey AND a.had LEFT JOIN f b ON b.o_custkey = c_custkey AND NOT b.had LEFT JOIN t c ON c.o_custkey = c_custkey AND c.had LEFT JOIN t d ON d.o_custkey = c_custkey AND NOT d.had"
)
def missing_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and chunks of customers that the stores lack are filled in, customers that are there are left as they are; run twice, as after a break."""
    o, folder = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority"), scratch(spark)
    companies = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    before = {"facts": o.filter("o_orderstatus = 'F'"), "chunks": o.filter("o_orderpriority = '1-URGENT'")}
    for name, rows in before.items():
        rows.write.parquet(f"{folder}/{name}")
    offered = {"facts": o.filter("o_orderstatus = 'O'"), "chunks": o.filter("o_orderpriority = '2-HIGH'")}
    for _ in range(2):
        if failed := M.fill_missing(spark, companies, "o_custkey", offered, folder):
            raise RuntimeError(str(failed))
    return M.coverage(companies, "o_custkey", before, {name: spark.read.parquet(f"{folder}/{name}") for name in before})
