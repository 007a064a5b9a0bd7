"""Auditable answers in batch: a question's metric, its value with inputs and formula, the check of the figures, the route."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import metrics, quality, questions

c = F.col


def answer(asked: DataFrame, figures: DataFrame, keys: list[str], chunks: DataFrame | None = None) -> DataFrame:
    """One row a question. asked: question_id, question, keys; figures: keys and the inputs of the metrics.

    Questions of a company and period meet its one row of figures in an equi-join. The metric is picked by phrase; all
    metrics are expressions of that row, so only the picked one's value is kept. status is PASS where the gross profit
    identity holds, FAIL where it doesn't, SKIPPED where it can't be checked; a failed check or a missing value escalates.
    chunks (keys, text) adds the number of text sources."""
    rows = asked.withColumns({"metric": metrics.asked_metric(c("question")), "intent": questions.intent(c("question")), "kind": questions.kind(c("question"))}).join(figures, keys, "left")
    value = F.coalesce(*[F.when(c("metric") == n, m.column()) for n, m in metrics.METRICS.items() if set(m.inputs) <= set(figures.columns)])
    unit = F.create_map(*[F.lit(x) for n, m in metrics.METRICS.items() for x in (n, m.unit)])[c("metric")]
    formula = F.create_map(*[F.lit(x) for n, m in metrics.METRICS.items() for x in (n, m.formula)])[c("metric")]
    identity = metrics.gross_profit_identity()["passed"]
    rows = rows.withColumns({"value": value, "unit": unit, "formula": formula, "status": quality.verification(F.lit(None).cast("boolean"), identity, F.lit(None).cast("double"))})
    fired = quality.codes(no_value=c("value").isNull(), figures_disagree=c("status") == "FAIL")
    rows = rows.withColumns({"triggers": fired, "route": quality.route(F.when(c("status") == "PASS", 0.98).otherwise(0.7), fired)})
    if chunks is not None:
        rows = rows.join(chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sources")), keys, "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))
    return rows.select("question_id", *keys, "question", "intent", "kind", "metric", "value", "unit", "formula", "status", "triggers", "route", *(["n_sources"] if chunks is not None else []))
