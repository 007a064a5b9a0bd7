"""The corpus queries that the driver runs, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, fim, importance, language_id, license_scan, near_dedup, packing, quality, secret_scan, sp_codec, topk, toxicity, url_filters
from quillspark.llm.common import spread, table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """These columns of all documents, over all cores."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *columns))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(documents(spark, sf_dir)))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.train_and_identify(documents(spark, sf_dir, "lang"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.encode_documents(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), digest=True)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.train_and_score(documents(spark, sf_dir, "lang"), table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan_licenses(documents(spark, sf_dir)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir, "lang"))


#: The pages carry neither a fetch day nor a list, so both are derived by these rules: page i was fetched i * 37 mod 366
#: days after the epoch below; of the hosts seen, those whose hash (first 6 hex digits of md5) is divisible by 3 were
#: blocked on day hash mod 200, allowed 45 days later and, if the hash is even, blocked again 60 days after that; the parent
#: domain of every host whose hash mod 7 is 1 was blocked on day hash mod 300.
EPOCH = "2024-01-01"


def list_history(pages: DataFrame) -> DataFrame:
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    h = F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("long")
    rows = hosts.withColumn("h", h)
    day = lambda n: F.date_add(F.lit(EPOCH).cast("date"), n.cast("int"))
    entry = lambda key, action, n: F.struct(key.alias("list_key"), F.lit(action).alias("action"), day(n).alias("since"))
    own, parent = F.col("host"), F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    none = F.lit(None)
    options = F.array(
        F.when(F.col("h") % 3 == 0, entry(own, "block", F.col("h") % 200)),
        F.when(F.col("h") % 3 == 0, entry(own, "allow", F.col("h") % 200 + 45)),
        F.when((F.col("h") % 3 == 0) & (F.col("h") % 2 == 0), entry(own, "block", F.col("h") % 200 + 105)),
        F.when((F.col("h") % 7 == 1) & (parent != ""), entry(parent, "block", F.col("h") % 300)).otherwise(none),
    )
    return rows.select(F.explode(F.array_compact(options)).alias("e")).select("e.*")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    fetched = F.date_add(F.lit(EPOCH).cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    return url_filters.filter_urls(pages.select("page_id", "url", fetched.alias("fetched")), list_history(pages))


URL_SQL = """
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
         DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetched
  FROM pages),
h AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS h FROM p WHERE host <> ''),
e AS (
  SELECT host AS list_key, 'block' AS action, h % 200 AS n FROM h WHERE h % 3 = 0
  UNION ALL SELECT host, 'allow', h % 200 + 45 FROM h WHERE h % 3 = 0
  UNION ALL SELECT host, 'block', h % 200 + 105 FROM h WHERE h % 6 = 0
  UNION ALL SELECT regexp_extract(host, '([^.]+\\.[^.]+)$', 1), 'block', h % 300 FROM h WHERE h % 7 = 1 AND regexp_extract(host, '([^.]+\\.[^.]+)$', 1) <> ''),
d AS (SELECT list_key, DATE '2024-01-01' + CAST(n AS INTEGER) AS since, max(action) AS action FROM e GROUP BY ALL),
i AS (SELECT *, lead(since) OVER (PARTITION BY list_key ORDER BY since) AS until FROM d),
m AS (
  SELECT p.page_id, p.host, p.fetched, i.list_key, i.action, i.since,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(i.list_key) - length(replace(i.list_key, '.', '')) DESC) AS r
  FROM p JOIN i ON (p.host = i.list_key OR (ends_with(p.host, '.' || i.list_key))) AND p.fetched >= i.since AND (i.until IS NULL OR p.fetched < i.until))
SELECT p.page_id, p.host, p.fetched, m.list_key, m.action, m.since AS active_since, coalesce(m.action, '') <> 'block' AS kept
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.r = 1
"""


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir), words=3, percent=85)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark").select("text"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.fill_in_middle(documents(spark, sf_dir)))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_language_id": op3_language_id,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_toxicity": op6_toxicity,
    "op7_license_scan": op7_license_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_url_filters": op9_url_filters,
    "op10_near_dedup": op10_near_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_exact_topk": op13_exact_topk,
}

ORACLES = {
    "op4_exact_dedup": exact_dedup.ORACLE_SQL,
    "op9_url_filters": URL_SQL,
    "op12_fill_in_middle": fim.ORACLE_SQL,
    "op13_exact_topk": topk.ORACLE_SQL,
}
