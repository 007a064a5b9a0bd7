"""Queries on what questions ask for and the facts that answer them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import questions as Q
from quillspark.plans.rails import first_sql, holds_sql
from quillspark.plans.registry import query, table

ASKED = [
    "What was the latest gross margin?", "Compare Intel and AMD revenue over the years", "Risk of net sales?", "net income over five years", "Chart R&D for 3-year", "Revenue recognition policy?",
    "Current ratio this quarter", "free cash flow and debt", "", "AMD vs intel, then NVDA", "is ON better than micron on margins", "What are its competitors?",
]
NAMES = {"INTC": ["intel"], "AMD": ["advanced micro", "amd"], "NVDA": ["nvidia"], "ON": ["on"], "MU": ["micron"]}
BASE = "m AS (SELECT event_id, CASE event_id % 12 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(ASKED)) + " END AS t FROM events)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(t) for t in ASKED]), (F.col("event_id") % len(ASKED) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", pick.alias("t"))


@query(
    f"WITH {BASE} SELECT event_id, CASE WHEN {holds_sql(Q.COMPARISON)} THEN 'comparison' WHEN {holds_sql(Q.LATEST)} THEN 'latest' ELSE 'general' END AS intent, CASE WHEN {holds_sql(Q.NUMERIC)} AND NOT {holds_sql(Q.QUALITATIVE)} THEN 'numeric' ELSE 'qualitative' END AS kind, CASE WHEN NOT regexp_matches(t, '(?i)\\b(?:{'|'.join(Q.CHART_VETO)})\\b') THEN "
    + first_sql([(f"\\b(?:{p})\\b", v) for p, v in Q.CHART_METRICS])
    + " END AS chart, CAST(CASE event_id % 12 WHEN 3 THEN 5 WHEN 4 THEN 3 ELSE 0 END AS INTEGER) AS horizon FROM m"
)
def question_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent, kind, chart metric and horizon."""
    t = F.col("t")
    return asked(spark, sf_dir).select("event_id", Q.intent(t).alias("intent"), Q.kind(t).alias("kind"), Q.chart_metric(t).alias("chart"), F.coalesce(Q.year_horizon(t), F.lit(0)).alias("horizon"))


W = r"[\pL\pN_]"
#: Names that the tables' texts hold: the first two and the first three words of every benchmark passage.
NAMES_SQL = f"a AS (SELECT DISTINCT 'B' || item_id AS v, lower(regexp_extract(text, '^({W}+ ){{' || n || '}}{W}+')) AS alias FROM benchmark, (VALUES (1), (2)) t(n)), k AS (SELECT * FROM a WHERE alias <> '')"
MET_SQL = rf"low AS MATERIALIZED (SELECT doc_id, lower(text) AS low FROM documents), met AS MATERIALIZED (SELECT doc_id, v, alias, low FROM low, k WHERE contains(low, alias)), hit AS MATERIALIZED (SELECT * FROM met WHERE regexp_matches(low, '(^|[^\pL\pN_])' || alias || '($|[^\pL\pN_])'))"


def passage_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = lambda n: F.regexp_extract("text", rf"^([\p{{L}}\p{{N}}_]+ ){{{n}}}[\p{{L}}\p{{N}}_]+", 0)
    each = F.explode(F.array(lead(1), lead(2))).alias("alias")
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("B"), "item_id").alias("value"), each).filter("alias <> ''")


@query(
    rf"""WITH {NAMES_SQL}, {MET_SQL},
h AS (SELECT doc_id, v, min(length(regexp_extract(low, '(?s)^(.*?)(?:^|[^\pL\pN_])' || alias || '(?:$|[^\pL\pN_])', 1))) AS place FROM hit GROUP BY ALL),
n AS (SELECT doc_id, list(v ORDER BY place, v) AS vs FROM h GROUP BY doc_id)
SELECT doc_id, coalesce(array_to_string(vs, ','), '') AS named, CASE WHEN len(vs) >= 2 THEN 'explicit' WHEN len(vs) = 1 AND (contains(lower(text), 'competitor') OR contains(lower(text), 'peers') OR contains(lower(text), 'industry') OR contains(lower(text), 'rivals')) THEN 'peer' END AS mode
FROM documents LEFT JOIN n USING (doc_id)"""
)
def companies_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in every document in the order of mention, and the kind of comparison."""
    rows = Q.named_companies(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", passage_names(spark, sf_dir))
    return rows.select("doc_id", F.array_join("named", ",").alias("named"), Q.comparison_mode(F.col("text"), F.col("named"), F.lit(None).cast("string")).alias("mode"))


@query(f"WITH {BASE} SELECT event_id, CASE event_id % 12 WHEN 0 THEN 'GrossProfit,Revenues,RevenueFromContractWithCustomer,CostOfGoodsAndServicesSold,CostOfRevenue' WHEN 1 THEN 'Revenues,RevenueFromContractWithCustomer' WHEN 2 THEN 'Revenues,RevenueFromContractWithCustomer' WHEN 3 THEN 'NetIncomeLoss' WHEN 4 THEN 'ResearchAndDevelopmentExpense' WHEN 5 THEN 'Revenues,RevenueFromContractWithCustomer' WHEN 7 THEN 'NetCashProvidedByUsedInOperatingActivities,PaymentsToAcquirePropertyPlantAndEquipment,LongTermDebt' ELSE 'Revenues,NetIncomeLoss,OperatingIncomeLoss' END AS concepts FROM m")
def concepts_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concepts that a question calls for."""
    return asked(spark, sf_dir).select("event_id", F.array_join(Q.asked_concepts(F.col("t")), ",").alias("concepts"))


FACT_SQL = "f AS (SELECT event_id AS id, ['Revenues', 'GrossProfit', 'Assets', 'NetIncomeLoss', 'Deposits'][event_id % 5 + 1] AS concept, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, CAST(2020 + user_id % 5 AS INTEGER) AS year FROM events)"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    concept = F.element_at(F.array(*[F.lit(x) for x in ("Revenues", "GrossProfit", "Assets", "NetIncomeLoss", "Deposits")]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), concept.alias("concept"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), (F.lit(2020) + F.col("user_id") % 5).cast("int").alias("year"))


@query(f"WITH {FACT_SQL} SELECT id, concept, year FROM f WHERE year = (SELECT max(year) FROM f) ORDER BY CASE concept WHEN 'Assets' THEN 0 WHEN 'NetIncomeLoss' THEN 2 WHEN 'GrossProfit' THEN 2 WHEN 'Revenues' THEN 3 ELSE 99 END + CASE WHEN value IS NULL THEN 50 ELSE 0 END, abs(coalesce(value, 0)) DESC, id LIMIT 3")
def relevant_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the newest year by group."""
    return Q.relevant_facts(facts(spark, sf_dir), "the latest balance sheet debt").select("id", "concept", "year")


@query(f"WITH {FACT_SQL}, b AS (SELECT concept, arg_max(id, struct_pack(y := year, v := abs(coalesce(value, 0)), i := -id)) AS id FROM f WHERE concept IN ('Revenues', 'GrossProfit') GROUP BY concept) SELECT f.id, f.concept, f.year FROM f JOIN b ON f.id = b.id")
def relevant_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of a named margin, each in its latest year."""
    return Q.relevant_facts(facts(spark, sf_dir), "gross margin").select("id", "concept", "year")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '2024-01-31' WHEN 1 THEN 'FY2023 Q2' WHEN 2 THEN 'FY2023' ELSE '2024-02-01' END AS period, CASE event_id % 4 WHEN 0 THEN 2024 WHEN 3 THEN 2024 ELSE 2023 END AS year, 'https://data.sec.gov/api/xbrl/companyconcept/CIK' || lpad(CAST(user_id AS VARCHAR), 10, '0') || '/us-gaap/Net%20Sales.json' AS url FROM events")
def fact_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shown period, year and address of facts."""
    k = F.col("event_id") % 4
    end = F.when(k == 0, "2024-01-31T00:00:00").when(k == 1, " ")
    year = F.when((k == 1) | (k == 2), 2023)
    part = F.when(k == 1, "Q2").when(k == 2, "FY")
    shown = Q.fact_period(end, year, part, F.lit("2024-02-01"))
    url, _ = Q.fact_links(F.col("user_id"), F.lit("us-gaap"), F.lit("Net Sales"), F.lit("USD"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", shown.alias("period"), Q.fact_year(year, shown).alias("year"), url.alias("url"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0 END, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN '2023-Q' || lpad(CAST(event_id % 12 + 1 AS VARCHAR), 2, '0') ELSE 'other' END, event_id) AS place FROM events")
def period_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and quarter labels in one order, others last."""
    from pyspark.sql import Window

    k = F.col("event_id") % 3
    label = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd")).when(k == 1, F.concat(F.lit("2023-Q"), (F.col("event_id") % 12 + 1).cast("string"))).otherwise("other")
    w = Window.partitionBy("user_id").orderBy(Q.period_key(label), "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(w).cast("long").alias("place"))
