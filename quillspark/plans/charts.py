"""Chart, table and number format queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import charts as C
from quillspark.plans.registry import query, table

#: Series a customer and year: revenue is filed for orders with key not divisible by 5, its parts for other subsets.
SERIES_SQL = """o AS (SELECT 'C' || o_custkey AS ticker, CAST(year(o_orderdate) AS VARCHAR) AS period, o_orderkey AS k, o_totalprice AS p FROM orders),
rev0 AS (SELECT ticker, period, sum(p) AS value FROM o WHERE k % 5 <> 0 GROUP BY ALL),
gp AS (SELECT ticker, period, sum(p) AS value FROM o WHERE k % 3 = 0 GROUP BY ALL),
cogs AS (SELECT ticker, period, sum(p) AS value FROM o WHERE k % 2 = 0 GROUP BY ALL),
rev AS (SELECT coalesce(r.ticker, c.ticker) AS ticker, coalesce(r.period, c.period) AS period, coalesce(r.value, c.value) AS value FROM rev0 r FULL JOIN (SELECT gp.ticker, gp.period, gp.value + cogs.value AS value FROM gp JOIN cogs USING (ticker, period)) c ON r.ticker = c.ticker AND r.period = c.period)"""


def series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("ticker"), F.year("o_orderdate").cast("string").alias("period"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    total = lambda which: o.filter(which).groupBy("ticker", "period").agg(F.sum("p").alias("value"))
    gross, cogs = total("k % 3 = 0"), total("k % 2 = 0")
    return C.recovered(total("k % 5 <> 0"), gross, cogs, ["ticker", "period"]), gross, cogs


@query(f"WITH {SERIES_SQL} SELECT ticker, period, round(value, 2) AS value FROM rev")
def revenue_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue, filled from its parts where these have a period that it lacks."""
    return series(spark, sf_dir)[0].select("ticker", "period", F.round("value", 2).alias("value"))


@query(
    f"WITH {SERIES_SQL}, p AS (SELECT gp.ticker, gp.period, round(gp.value / rev.value * 100, 2) AS value FROM gp JOIN rev USING (ticker, period) WHERE rev.value <> 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period DESC) AS n, count(*) OVER (PARTITION BY ticker) AS c FROM p), s AS (SELECT * FROM r WHERE c >= 2 AND n <= 8) "
    "SELECT ticker, period, round(value, 1) AS value, ticker || ' — Gross Margin (' || min(period) OVER (PARTITION BY ticker) || '–' || max(period) OVER (PARTITION BY ticker) || ')' AS title FROM s"
)
def chart_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross margin in percent where both series have the year, the latest eight of two and more."""
    revenue, gross, _ = series(spark, sf_dir)
    points = C.chart_points(C.ratio_points(gross, revenue, ["ticker", "period"]), ["ticker"], "period")
    return points.select("ticker", "period", F.round("value", 1).alias("value"), C.chart_title(F.col("ticker"), "Gross Margin", F.col("first"), F.col("last")).alias("title"))


QUARTERS_SQL = "q AS (SELECT 'C' || o_custkey AS ticker, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS period, sum(o_totalprice) AS value FROM orders GROUP BY ALL)"


@query(
    f"WITH {SERIES_SQL}, {QUARTERS_SQL}, a AS (SELECT ticker, count(*) AS n, min(period) AS first, max(period) AS last FROM (SELECT * FROM gp QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY period DESC) <= 8) GROUP BY 1 HAVING count(*) >= 2) "
    "SELECT ticker, 'line' AS type, ticker || ' — Gross Profit (' || first || '–' || last || ')' AS title, n AS n_annual, (SELECT least(count(*), 20) FROM q WHERE q.ticker = a.ticker) AS n_quarterly FROM a"
)
def chart_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs with annual and quarterly points."""
    o = table(spark, sf_dir, "orders")
    label = F.concat(F.year("o_orderdate").cast("string"), F.lit("-Q"), F.quarter("o_orderdate").cast("string"))
    quarterly = o.groupBy(F.concat(F.lit("C"), "o_custkey").alias("ticker"), label.alias("period")).agg(F.sum("o_totalprice").alias("value"))
    specs = C.chart_specs(series(spark, sf_dir)[1], quarterly, "Gross Profit", "USD")
    return specs.select("ticker", "type", "title", F.size("annual").cast("long").alias("n_annual"), F.size("quarterly").cast("long").alias("n_quarterly"))


TABLE_SQL = "SELECT n_regionkey AS region, n_name || CASE WHEN n_nationkey % 4 = 0 THEN ' | x' ELSE '' END AS name, CASE WHEN n_nationkey % 3 = 0 THEN '—' ELSE CAST(n_nationkey AS VARCHAR) END AS figure FROM nation"


def nation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    name = F.concat("n_name", F.when(F.col("n_nationkey") % 4 == 0, " | x").otherwise(""))
    figure = F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey"))
    return C.markdown_table(n, ["n_regionkey"], ["Name", "Figure"], [name, figure], F.col("n_nationkey"))


@query("SELECT n_regionkey AS region, '| Name | Figure |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_name || CASE WHEN n_nationkey % 4 = 0 THEN ' \\| x' ELSE '' END || ' | ' || CASE WHEN n_nationkey % 3 = 0 THEN '—' ELSE CAST(n_nationkey AS VARCHAR) END || ' |', chr(10) ORDER BY n_nationkey) AS t FROM nation GROUP BY 1")
def markdown_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows to Markdown tables."""
    return nation_tables(spark, sf_dir).select(F.col("n_regionkey").alias("region"), F.col("table").alias("t"))


@query(TABLE_SQL)
def markdown_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown tables inside text, with a line before and after, to rows."""
    text = nation_tables(spark, sf_dir).withColumn("table", F.concat(F.lit("Text | with - bars\nmore\n"), "table", F.lit("\n\nafter | it")))
    rows = C.markdown_rows(text, ["n_regionkey"], "table")
    return rows.select(F.col("n_regionkey").alias("region"), F.col("cells")[0].alias("name"), F.col("cells")[1].alias("figure"))


FORMAT_SQL = """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice) AS BIGINT) * CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, format('{:,}', v) AS plain, CASE WHEN v >= 1000000000 THEN 'B' WHEN v >= 1000000 THEN 'M' ELSE '' END AS scale, CASE WHEN v >= 1000000000 THEN 2 WHEN v >= 1000000 THEN 1 ELSE 0 END AS usd_decimals FROM x"""


@query(FORMAT_SQL)
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """three ways to show a number: thousands apart, scaled cells, dollars by size."""
    scale = F.when(F.col("l_linenumber") % 3 == 0, 1).when(F.col("l_linenumber") % 3 == 1, 1000).otherwise(1000000)
    v = F.round("l_extendedprice").cast("long") * scale
    usd = C.metric_value(v.cast("double"), F.lit("USD"))
    decimals = F.length(F.regexp_extract(usd, r"\.([0-9]+)[BM]$", 1))
    plain = F.when(v >= 1000, C.precise_number(v.cast("double"))).otherwise(F.format_number(v, 0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", plain.alias("plain"), F.regexp_extract(C.compact_cell(v.cast("double")), "[BM]?$", 0).alias("scale"), decimals.alias("usd_decimals"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace('NetIncome' || replace(p_brand, '#', '') || 'Loss', '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')) AS words FROM part")
def concept_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """concept names to words."""
    return table(spark, sf_dir, "part").select("p_partkey", T.spaced_words(F.concat(F.lit("NetIncome"), F.regexp_replace("p_brand", "#", ""), F.lit("Loss"))).alias("words"))
