"""The flagship flow in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import answers
from quillspark.plans import metrics as M
from quillspark.plans.registry import query, table

ASKED = ["What is the gross margin?", "latest working capital, no, net debt", "yoy growth", "tell me about strategy"]


@query(
    M.BASE
    + ", q AS (SELECT event_id AS question_id, event_id % 4 AS k, CAST(event_id % 120 AS BIGINT) AS company, CAST(1995 + event_id % 8 AS BIGINT) AS yr FROM events), "
    + f"a AS (SELECT q.question_id, q.k, q.company, q.yr, CASE k WHEN 0 THEN 'gross_margin' WHEN 1 THEN 'net_debt' WHEN 2 THEN 'yoy_growth' END AS metric, CASE k WHEN 0 THEN round({M.METRIC_SQL['gross_margin']}, 4) WHEN 1 THEN round({M.METRIC_SQL['net_debt']}, 2) WHEN 2 THEN round({M.METRIC_SQL['yoy_growth']}, 4) END AS value, "
    + "CASE WHEN abs(gross_profit - (revenue - cogs)) / greatest(abs(gross_profit), 1.0) <= 0.01 THEN 'PASS' WHEN gross_profit IS NOT NULL THEN 'FAIL' ELSE 'SKIPPED' END AS status FROM q LEFT JOIN b ON q.company = b.company AND q.yr = b.yr) "
    + "SELECT question_id, CASE WHEN k = 1 THEN 'latest' WHEN k = 2 THEN 'comparison' ELSE 'general' END AS intent, metric, value, status, CASE WHEN value IS NULL OR status = 'FAIL' THEN 'ESCALATE' WHEN status = 'PASS' THEN 'AUTO' ELSE 'SAMPLED_REVIEW' END AS route FROM a"
)
def auditable_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M30, M32, M38, V18 and the answer flow: metric, value, check and route of many questions at once."""
    text = F.element_at(F.array(*[F.lit(t) for t in ASKED]), (F.col("event_id") % 4 + 1).cast("int"))
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("question_id"), (F.col("event_id") % 120).alias("company"), (F.lit(1995) + F.col("event_id") % 8).cast("int").alias("yr"), text.alias("question"))
    return answers.answer(asked, M.figures(spark, sf_dir), ["company", "yr"]).select("question_id", "intent", "metric", "value", "status", "route")
