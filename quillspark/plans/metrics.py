"""Metric queries over a wide frame of figures per supplier and year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.numbers import exact_sum
from quillspark.operators import metrics as M
from quillspark.plans.registry import ORACLES, QUERIES, query, table

#: Figures of a supplier and year, made of line items: name, aggregate (read alike by Spark and DuckDB).
FIGURES = {
    "revenue": "sum(l_extendedprice)",
    "cogs": "sum(l_extendedprice * (0.5 + l_discount))",
    "gross_profit": "CASE WHEN l_suppkey % 2 = 0 THEN sum(l_extendedprice * (0.5 - l_discount)) END",
    "operating_income": "sum(l_extendedprice * (l_tax - 0.01))",
    "net_income": "sum(l_extendedprice * (l_tax - 0.03))",
    "da": "sum(l_quantity) * 10",
    "rd": "sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END)",
    "sga": "sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END)",
    "current_assets": "sum(l_quantity) * 100",
    "current_liabilities": "sum(l_linenumber) * 300.0 - 900.0",
    "cash": "sum(l_linenumber) * 70.0",
    "short_term_investments": "sum(l_tax) * 1000",
    "receivables": "sum(l_discount) * 1000",
    "debt": "sum(l_quantity * l_linenumber) * 20",
    "equity": "sum(l_quantity * l_tax) * 500",
    "shares": "count(*) * 1.0",
    "ocf": "sum(l_extendedprice * l_tax)",
    "capex": "sum(l_extendedprice * l_discount) * CASE WHEN l_suppkey % 3 = 0 THEN -0.5 ELSE 0.5 END",
}
BASE = f"""
WITH f AS (SELECT l_suppkey AS company, year(l_shipdate) AS yr, {", ".join(f"{e} AS {n}" for n, e in FIGURES.items())}
FROM lineitem GROUP BY l_suppkey, year(l_shipdate)),
b AS (SELECT f.*, lag(revenue) OVER w AS prior_revenue, lag(cogs) OVER w AS prior_cogs, first_value(revenue) OVER w AS start_value, revenue AS end_value,
CAST(yr - first_value(yr) OVER w AS DOUBLE) AS years FROM f WINDOW w AS (PARTITION BY company ORDER BY yr))
"""


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("yr")).agg(*[F.expr(e).alias(n) for n, e in FIGURES.items()])
    w = Window.partitionBy("company").orderBy("yr")
    return li.withColumnRenamed("l_suppkey", "company").withColumns({"prior_revenue": F.lag("revenue").over(w), "prior_cogs": F.lag("cogs").over(w), "start_value": F.first("revenue").over(w), "end_value": F.col("revenue"), "years": (F.col("yr") - F.first("yr").over(w)).cast("double")})


def guarded(n: str, d: str, factor: str = "") -> str:
    return f"CASE WHEN abs({d}) > 1.0 THEN ({n}) / ({d}){factor} END"


P = " * 100"
METRIC_SQL = {
    "gross_margin": guarded("coalesce(gross_profit, revenue - cogs)", "revenue", P),
    "gross_margin_growth": f"{guarded('revenue - cogs', 'revenue', P)} - {guarded('prior_revenue - prior_cogs', 'prior_revenue', P)}",
    "operating_margin": guarded("operating_income", "revenue", P),
    "net_margin": guarded("net_income", "revenue", P),
    "ebitda": "operating_income + da",
    "ebitda_margin": guarded("operating_income + da", "revenue", P),
    "rd_intensity": guarded("rd", "revenue", P),
    "sga_intensity": guarded("sga", "revenue", P),
    "yoy_growth": guarded("revenue - prior_revenue", "abs(prior_revenue)", P),
    "current_ratio": guarded("current_assets", "current_liabilities"),
    "quick_ratio": guarded("cash + short_term_investments + receivables", "current_liabilities"),
    "debt_to_equity": guarded("debt", "equity"),
    "net_debt": "debt - cash",
    "net_debt_to_ebitda": guarded("debt - cash", "(operating_income + da)"),
    "working_capital": "current_assets - current_liabilities",
    "book_value_per_share": guarded("equity", "shares"),
    "free_cash_flow": "ocf - abs(capex)",
    "fcf_margin": guarded("ocf - abs(capex)", "revenue", P),
    "fcf_conversion": guarded("ocf - abs(capex)", "net_income"),
    "capex_intensity": guarded("abs(capex)", "revenue", P),
    "cagr": "CASE WHEN start_value > 0 AND years > 0 AND end_value >= 0 THEN (pow(end_value / start_value, 1 / years) - 1) * 100 END",
}


def _register(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return figures(spark, sf_dir).select("company", "yr", M.METRICS[name].column().alias("value"))

    run.__doc__ = f"{name}: {M.METRICS[name].formula}."
    QUERIES[f"metric_{name}"] = run
    ORACLES[f"metric_{name}"] = f"{BASE} SELECT company, CAST(yr AS INTEGER) AS yr, round({METRIC_SQL[name]}, {2 if M.METRICS[name].unit == 'USD' else 4}) AS value FROM b"


for _name in METRIC_SQL:
    _register(_name)


@query(
    BASE
    + """SELECT company, CAST(yr AS INTEGER) AS yr,
round(abs(revenue - (cogs + equity)) / greatest(abs(revenue), 1.0) * 100, 4) AS balance_pct, abs(revenue - (cogs + equity)) / greatest(abs(revenue), 1.0) <= 0.01 AS balance_ok,
round(abs(gross_profit - (revenue - cogs)) / greatest(abs(gross_profit), 1.0) * 100, 4) AS gross_pct, abs(gross_profit - (revenue - cogs)) / greatest(abs(gross_profit), 1.0) <= 0.01 AS gross_ok,
round(abs(net_income - (ocf - abs(capex))) / greatest(abs(net_income), 1.0) * 100, 4) AS cash_pct FROM b WHERE gross_profit IS NOT NULL"""
)
def identity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounting identities; revenue, cost and equity stand in for assets, liabilities and equity."""
    f = figures(spark, sf_dir).filter("gross_profit is not null").withColumns({"assets": F.col("revenue"), "liabilities": F.col("cogs"), "fcf": F.col("net_income")})
    f = f.withColumns({"b": M.balance_identity(), "g": M.gross_profit_identity(), "c": M.cash_flow_identity()})
    return f.select("company", "yr", F.col("b.delta_pct").alias("balance_pct"), F.col("b.passed").alias("balance_ok"), F.col("g.delta_pct").alias("gross_pct"), F.col("g.passed").alias("gross_ok"), F.col("c.delta_pct").alias("cash_pct"))


@query(BASE + "SELECT company, CAST(yr AS INTEGER) AS yr, round((revenue - cogs) / nullif(revenue, 0) * 100, 4) AS gross_margin_pct, round(operating_income / nullif(revenue, 0) * 100, 4) AS operating_margin_pct, round(net_income / nullif(revenue, 0) * 100, 4) AS net_margin_pct FROM b")
def compute_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins by discovered column names."""
    return M.compute_margins(figures(spark, sf_dir)).select("company", "yr", "gross_margin_pct", "operating_margin_pct", "net_margin_pct")


FACTS_SQL = """facts AS (SELECT user_id AS ticker, CASE event_type WHEN 'view' THEN 'Revenues' WHEN 'click' THEN 'NetSales' WHEN 'purchase' THEN 'Assets' WHEN 'signup' THEN 'AssetsCurrent' ELSE 'Gross-Profit' END AS concept,
strftime(ts, '%Y-%m-%d') || '#' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS period, value FROM events)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    concept = F.when(kind == "view", "Revenues").when(kind == "click", "NetSales").when(kind == "purchase", "Assets").when(kind == "signup", "AssetsCurrent").otherwise("Gross-Profit")
    period = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("#"), F.lpad(F.col("event_id").cast("string"), 9, "0"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), concept.alias("concept"), period.alias("period"), "value")


@query(f"WITH {FACTS_SQL} SELECT ticker, arg_max(value, struct_pack(h := CAST(contains(period, '2024-01-1') AS INTEGER), p := period)) AS value FROM facts WHERE concept IN ('Revenues', 'NetSales') GROUP BY ticker")
def fact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fact of a concept or its aliases, in a period if it has any."""
    return M.lookup(facts(spark, sf_dir), "revenues", ["ticker"], "2024-01-1")


@query(f"WITH {FACTS_SQL} SELECT ticker, arg_max(value, struct_pack(m := CASE WHEN concept = 'AssetsCurrent' THEN 2 ELSE 1 END, p := period)) AS value FROM facts WHERE concept IN ('Assets', 'AssetsCurrent') GROUP BY ticker")
def fact_lookup_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag that is part of an alias answers only where no exact tag does."""
    return M.lookup(facts(spark, sf_dir), "current assets", ["ticker"])


@query(f"WITH {FACTS_SQL} SELECT ticker, round(arg_max(value, period) FILTER (WHERE concept = 'Assets'), 2) AS assets, round(arg_max(value, period) FILTER (WHERE concept = 'Gross-Profit'), 2) AS gross_profit, count(DISTINCT substr(period, 1, 10)) AS periods FROM facts GROUP BY ticker")
def fact_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several concepts at once, and the number of periods."""
    last = lambda tag: F.round(F.max_by(F.when(F.col("concept") == tag, F.col("value")), F.when(F.col("concept") == tag, F.col("period"))), 2)
    return facts(spark, sf_dir).groupBy("ticker").agg(last("Assets").alias("assets"), last("Gross-Profit").alias("gross_profit"), F.count_distinct(F.substring("period", 1, 10)).alias("periods"))


PERIOD_SQL = """x AS (SELECT o_custkey % 50 AS ticker, o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey * 31 % 400 AS INTEGER) AS e, o_totalprice AS value FROM orders)"""


def period_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    start = F.to_date("o_orderdate")
    end = F.date_add(start, (F.col("o_orderkey") * 31 % 400).cast("int"))
    return o.select((F.col("o_custkey") % 50).alias("ticker"), start.cast("string").alias("period_start"), end.cast("string").alias("period_end"), F.col("o_orderkey").alias("filed"), F.col("o_totalprice").alias("value"))


@query(f"WITH {PERIOD_SQL}, y AS (SELECT ticker, year(e) AS year, arg_max(value, struct_pack(a := e, b := o_orderkey)) AS value FROM x WHERE e - s >= 300 GROUP BY ALL) SELECT ticker, CAST(year AS INTEGER) AS year, value FROM y QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY year DESC) <= 5")
def annual_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value a year from periods of 300 days and more."""
    return M.annual_series(period_facts(spark, sf_dir), ["ticker"], 5)


@query(f"WITH {PERIOD_SQL}, y AS (SELECT ticker, year(e) || '-Q' || quarter(e) AS quarter, arg_max(value, struct_pack(a := e, b := o_orderkey)) AS value FROM x WHERE e - s BETWEEN 60 AND 120 GROUP BY ALL) SELECT ticker, quarter, value FROM y QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY quarter DESC) <= 20")
def quarterly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value a calendar quarter from periods of 60 to 120 days."""
    return M.quarterly_series(period_facts(spark, sf_dir), ["ticker"])


@query(
    f"WITH {PERIOD_SQL}, y AS (SELECT ticker, year(e) || '-Q' || quarter(e) AS quarter, arg_max(value, struct_pack(a := e, b := o_orderkey)) AS value FROM x WHERE e - s BETWEEN 60 AND 120 GROUP BY ALL), z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY quarter DESC) <= 20) SELECT ticker, quarter, round(CASE WHEN count(value) OVER w = 4 THEN sum(value) OVER w END, 2) AS ttm FROM z WINDOW w AS (PARTITION BY ticker ORDER BY quarter ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
)
def trailing_twelve_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the last four quarters."""
    q = M.quarterly_series(period_facts(spark, sf_dir), ["ticker"])
    return M.trailing_twelve_months(q, ["ticker"], "quarter", "value").select("ticker", "quarter", F.round("ttm", 2).alias("ttm"))


@query(BASE + "SELECT CAST(yr AS INTEGER) AS yr, CAST(company AS BIGINT) AS company, round(" + METRIC_SQL["debt_to_equity"] + ", 4) AS value, row_number() OVER (PARTITION BY yr ORDER BY round(" + METRIC_SQL["debt_to_equity"] + ", 4) ASC NULLS LAST, company) AS rank FROM b")
def peer_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies ranked by leverage, the lowest first, missing last. Debt and equity are summed up exactly: many ratios
    lie between two of four digits, and the order of the line items must not decide for one of them."""
    q, k = F.col("l_quantity"), F.col("l_suppkey").alias("company")
    sums = [(exact_sum(q * F.col("l_linenumber")) * 20).alias("debt"), (exact_sum(q * F.col("l_tax")) * 500).alias("equity")]
    f = table(spark, sf_dir, "lineitem").groupBy(k, F.year("l_shipdate").alias("yr")).agg(*sums).select("company", "yr", M.METRICS["debt_to_equity"].column().alias("value"))
    return M.peer_ranking(f, "value", True, ["yr"]).select("yr", "company", "value", F.col("rank").cast("long").alias("rank"))


@query(BASE + ", e AS (SELECT company, arg_min(revenue, yr) AS s, arg_max(revenue, yr) AS e, CAST(max(yr) - min(yr) AS DOUBLE) AS n FROM b GROUP BY company) SELECT company, round(CASE WHEN abs(s) > 1.0 THEN (e - s) / abs(s) * 100 END, 4) AS growth_pct, round(CASE WHEN s > 0 AND n > 0 AND e >= 0 THEN (pow(e / s, 1 / n) - 1) * 100 END, 4) AS cagr FROM e")
def peer_multiyear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth and CAGR over each company's years."""
    return M.growth_over_window(figures(spark, sf_dir), ["company"], "yr", "revenue").select("company", "growth_pct", "cagr")


@query(BASE + "SELECT CAST(yr AS INTEGER) AS yr, round(max(revenue) FILTER (WHERE company = 1), 2) AS c1, round(max(revenue) FILTER (WHERE company = 2), 2) AS c2, round(max(revenue) FILTER (WHERE company = 3), 2) AS c3 FROM b GROUP BY yr")
def company_year_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years by companies, for a question that names the companies 1, 2 and 3."""
    f = figures(spark, sf_dir).withColumn("company", F.concat(F.lit("c"), F.col("company").cast("string")))
    return f.groupBy("yr").pivot("company", ["c1", "c2", "c3"]).agg(F.round(F.max("revenue"), 2))


@query(
    "SELECT conv_id, turn, CASE WHEN contains(t, 'gross margin') THEN 'gross_margin' WHEN contains(t, 'ebitda') THEN 'ebitda' WHEN contains(t, 'growth') THEN 'yoy_growth' END AS metric FROM (SELECT conv_id, turn, lower(CASE turn % 4 WHEN 0 THEN 'Gross margin and growth ' WHEN 1 THEN 'EBITDA? ' WHEN 2 THEN 'Revenue GROWTH ' ELSE '' END || text) AS t FROM conversations)"
)
def asked_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric a question asks for, by ordered phrases."""
    c = table(spark, sf_dir, "conversations")
    lead = F.when(F.col("turn") % 4 == 0, "Gross margin and growth ").when(F.col("turn") % 4 == 1, "EBITDA? ").when(F.col("turn") % 4 == 2, "Revenue GROWTH ").otherwise("")
    return c.select("conv_id", "turn", M.asked_metric(F.concat(lead, F.col("text"))).alias("metric"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, round(l_extendedprice * CASE l_linenumber % 4 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 WHEN 2 THEN 1000000 ELSE 1 END, 2) AS usd FROM lineitem")
def normalize_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units to dollars."""
    from quillspark.functions.numbers import to_usd

    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_linenumber") % 4
    unit = F.when(k == 0, "USD/1000").when(k == 1, "USD/1000000").when(k == 2, "millions").otherwise("USD")
    return li.select("l_suppkey", "l_orderkey", "l_linenumber", F.round(to_usd(F.col("l_extendedprice"), unit), 2).alias("usd"))
