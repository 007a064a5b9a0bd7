"""Governance, conjoint and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import governance as G
from quillspark.plans.registry import query, table

LEVELS = {"tone": ["plain", "formal", "warm"], "length": ["short", "long"], "charts": ["none", "some", "many"]}
ATTRS = list(LEVELS)

#: Choices made of line items: both profiles by order and part, the choice by the flag (N counts as no choice).
RESPONSE_SQL = """r AS (SELECT ['plain', 'formal', 'warm'][l_orderkey % 3 + 1] AS a1, ['short', 'long'][l_orderkey % 2 + 1] AS a2, ['none', 'some', 'many'][l_partkey % 3 + 1] AS a3,
 ['plain', 'formal', 'warm'][l_suppkey % 3 + 1] AS b1, ['short', 'long'][l_suppkey % 2 + 1] AS b2, ['none', 'some', 'many'][l_linenumber % 3 + 1] AS b3, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'B' ELSE '-' END AS chosen FROM lineitem),
s AS (SELECT 'tone' AS attribute, a1 AS level, chosen = 'A' AS won FROM r WHERE chosen <> '-' UNION ALL SELECT 'length', a2, chosen = 'A' FROM r WHERE chosen <> '-' UNION ALL SELECT 'charts', a3, chosen = 'A' FROM r WHERE chosen <> '-'
 UNION ALL SELECT 'tone', b1, chosen = 'B' FROM r WHERE chosen <> '-' UNION ALL SELECT 'length', b2, chosen = 'B' FROM r WHERE chosen <> '-' UNION ALL SELECT 'charts', b3, chosen = 'B' FROM r WHERE chosen <> '-'),
u AS (SELECT attribute, level, count(*) AS appearances, count(*) FILTER (WHERE won) AS wins, count(*) FILTER (WHERE won) / count(*) AS utility FROM s GROUP BY ALL)"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda name, col: F.element_at(F.array(*[F.lit(x) for x in LEVELS[name]]), (F.col(col) % len(LEVELS[name]) + 1).cast("int")).alias(name)
    chosen = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "R", "B").otherwise("-")
    a = F.to_json(F.struct(pick("tone", "l_orderkey"), pick("length", "l_orderkey"), pick("charts", "l_partkey")))
    b = F.to_json(F.struct(pick("tone", "l_suppkey"), pick("length", "l_suppkey"), pick("charts", "l_linenumber")))
    return table(spark, sf_dir, "lineitem").select(a.alias("profile_a"), b.alias("profile_b"), chosen.alias("chosen"))


@query(f"WITH {RESPONSE_SQL} SELECT attribute, level, appearances, wins, round(utility, 6) AS utility FROM u")
def conjoint_utilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Win rates of levels."""
    return G.conjoint_counts(responses(spark, sf_dir), ATTRS).withColumn("utility", F.round("utility", 6))


@query(f"WITH {RESPONSE_SQL}, i AS (SELECT attribute, max(utility) - min(utility) AS r FROM u GROUP BY attribute) SELECT attribute, round(r / sum(r) OVER () * 100, 2) AS importance FROM i")
def conjoint_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the utilities' ranges."""
    return G.importance(G.conjoint_counts(responses(spark, sf_dir), ATTRS))


@query(f"WITH {RESPONSE_SQL} SELECT attribute, arg_max(level, utility) AS level FROM u GROUP BY attribute")
def preferred_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best level of each attribute."""
    return G.preferred(G.conjoint_counts(responses(spark, sf_dir), ATTRS), LEVELS)


@query("SELECT event_id, coalesce(CAST(props ->> 'k' AS INTEGER) BETWEEN 0 AND 49, false) AS valid, false AS lacking FROM events")
def profile_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with exactly the known attributes and levels; every event's properties are one, whose level is known below 50; an attribute more is lacking in all."""
    known = {"k": [str(i) for i in range(50)]}
    p = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", G.valid_profile(p, known).alias("valid"), G.valid_profile(p, known | {"tone": ["warm"]}).alias("lacking"))


@query("SELECT coalesce(CASE WHEN user_id % 4 = 0 THEN NULL ELSE event_type END, 'unknown') AS arm, count(*) AS n, count(CASE WHEN value > 5 THEN value END) AS rated, round(avg(CASE WHEN value > 5 THEN value END), 4) AS mean FROM events GROUP BY 1")
def usefulness_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings by arm."""
    rated = F.when(F.col("value") > 5, F.col("value"))
    arm = F.coalesce(F.when(F.col("user_id") % 4 != 0, F.col("event_type")), F.lit("unknown"))
    return table(spark, sf_dir, "events").groupBy(arm.alias("arm")).agg(F.count(F.lit(1)).alias("n"), F.count(rated).alias("rated"), F.round(F.avg(rated), 4).alias("mean"))


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'AUTO' WHEN 'O' THEN 'ESCALATE' ELSE 'SAMPLED_REVIEW' END AS route, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def route_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes whatever their case, with shares."""
    s = F.col("o_orderstatus")
    r = table(spark, sf_dir, "orders").select(F.when(s == "F", "auto").when(s == "O", "Escalate").otherwise("SAMPLED_REVIEW").alias("route"))
    return G.route_shares(r).withColumn("share", F.round("share", 6))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-25' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-25' GROUP BY 1 ORDER BY n DESC, event_type LIMIT 10")
def weekly_top_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent events of seven days."""
    at = F.lit("2024-01-25").cast("timestamp")
    e = table(spark, sf_dir, "events").filter((F.col("ts") > at - F.make_interval(days=F.lit(7))) & (F.col("ts") <= at))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(10)


@query("WITH r AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50) SELECT count(*) AS n, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS success_rate, count(*) FILTER (WHERE event_type = 'error') AS errors FROM r")
def call_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success among the last calls."""
    e = table(spark, sf_dir, "events").select("ts", F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"))
    return G.call_health(e).withColumn("success_rate", F.round("success_rate", 6))


#: Expected answers and answers by row number modulo 6.
EXPECTED = ["ABSTAIN - not disclosed", "45.2%", "$3.5 billion", "net income rose strongly", "abstain", "12%"]
ANSWERS = ["This is not available.", "It was 45.6% overall", "About 3,480 million dollars", "Income rose a bit", "It was 5 million", "The share was 13%"]
EVAL_SQL = """r AS (SELECT event_id AS id, event_type AS mode, event_id % 6 AS k, CASE event_id % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' ELSE 'ERROR' END AS status, CASE WHEN event_id % 5 = 0 THEN 'N/A' ELSE 'Revenues' END AS concept, event_id % 7 AS n_sources FROM events),
a AS (SELECT *, CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.67 WHEN 4 THEN 0.0 ELSE 0.0 END AS correctness, CASE WHEN concept = 'N/A' OR status = 'PASS' THEN 1.0 WHEN status = 'FAIL' THEN 0.0 ELSE 0.5 END AS xbrl, CASE WHEN n_sources > 0 THEN 1.0 ELSE 0.0 END AS sources, CASE k WHEN 4 THEN 0.0 ELSE 1.0 END AS abstention FROM r),
e AS (SELECT *, round(CASE WHEN k IN (0, 4) THEN (correctness + xbrl + sources)::DOUBLE / 3 ELSE (correctness + xbrl + sources + abstention)::DOUBLE / 4 END, 3) AS overall FROM a)"""


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("event_id") % len(v) + 1).cast("int"))
    status = F.when(F.col("event_id") % 4 == 0, "PASS").when(F.col("event_id") % 4 == 1, "FAIL").otherwise("ERROR")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("mode"), pick(EXPECTED).alias("expected"), pick(ANSWERS).alias("answer"), status.alias("status"), F.when(F.col("event_id") % 5 == 0, "N/A").otherwise("Revenues").alias("concept"), (F.col("event_id") % 7).alias("n_sources"))
    return G.evaluate(rows)


@query(f"WITH {EVAL_SQL} SELECT id, CAST(correctness AS DOUBLE) AS correctness, CAST(xbrl AS DOUBLE) AS xbrl, CAST(sources AS DOUBLE) AS sources, CAST(abstention AS DOUBLE) AS abstention, overall FROM e")
def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of answers against expected ones."""
    return golden(spark, sf_dir).select("id", "correctness", "xbrl", "sources", "abstention", "overall")


@query(f"WITH {EVAL_SQL} SELECT mode, count(*) AS n, round(avg(correctness::DOUBLE), 4) AS mean_correctness, round(avg(overall), 4) AS mean_overall, round(avg(CASE WHEN overall >= 0.75 THEN 1.0 ELSE 0.0 END), 4) AS pass_rate FROM e GROUP BY mode")
def eval_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by failure mode."""
    return G.summary(golden(spark, sf_dir), ["mode"]).select("mode", "n", "mean_correctness", "mean_overall", "pass_rate")


@query(f"WITH {EVAL_SQL} SELECT id, overall FROM e ORDER BY overall, id LIMIT 5")
def eval_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five worst answers."""
    return golden(spark, sf_dir).orderBy("overall", "id").limit(5).select("id", "overall")
