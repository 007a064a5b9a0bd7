"""Sources: company facts, graph files, golden questions, pages; and the column layouts of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Column layouts, in order, of the tables that the analytics read and write.
SCHEMAS = {
    "facts": "id int, ticker string, cik string, concept string, value double, unit string, period_end string, period_start string, form_type string, accession string, filed string, fiscal_year int, fiscal_period string, frame string",
    "chunks": "ticker string, accession string, text string, embedding array<float>, updated_at timestamp, cik string, section_id string, form_type string, period_of_report string, chunk_index int, section_type string, content_type string",
    "companies": "ticker string, description string, sector string, industry string, text string, embedding array<float>, updated_at timestamp",
    "triples": "id string, ticker string, subject string, predicate string, object string, confidence double, source_file string, source_loc string, subject_type string, object_type string, chunk_id string",
    "prices": "ticker string, ts timestamp, close double, volume double, timespan string",
    "decisions": "id string, cik string, accession string, form_type string, route string, confidence double, triggers_fired string, status string, created_at timestamp",
    "verdicts": "id string, decision_id string, reviewer_agrees boolean, notes string, created_at timestamp",
    "calibrations": "id string, run_at timestamp, verdicts_used int, high_threshold double, medium_threshold double, agreement_rate double, notes string",
    "events": "id string, event string, distinct_id string, view string, properties string, ts string",
    "conjoint_responses": "id string, session_id string, task_index int, profile_a string, profile_b string, chosen string, ts string",
    "golden": "id int, company string, ticker string, cik string, filing_type string, period string, question string, expected_answer string, xbrl_concept string, failure_mode string, difficulty string, notes string",
}

UNIT = "array<struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string,frame:string>>"
FACTS_JSON = f"cik bigint, entityName string, facts map<string,map<string,struct<label:string,units:map<string,{UNIT}>>>>"
#: Annual forms, and the units to try in order.
ANNUAL_FORMS = ["10-K", "10-K/A", "20-F", "20-F/A"]
UNITS = ["USD", "USD/shares", "shares"]


def company_facts(spark: SparkSession, path: str, forms: list[str] | None = None, lines: bool = False) -> DataFrame:
    """One row a fact: cik, taxonomy, concept, label, unit, value, period_start, period_end, accession, fiscal_year,
    fiscal_period, form_type, filed. Files (a company a file, or with lines a company a line) are read with a fixed layout and
    taken apart by explodes."""
    files = spark.read.schema(FACTS_JSON).option("multiLine", not lines).json(path)
    concepts = files.select("cik", F.explode("facts").alias("taxonomy", "_c")).select("cik", "taxonomy", F.explode("_c").alias("concept", "_d"))
    units = concepts.select("cik", "taxonomy", "concept", F.col("_d.label").alias("label"), F.explode("_d.units").alias("unit", "_u"))
    rows = units.select("cik", "taxonomy", "concept", "label", "unit", F.explode("_u").alias("f"))
    out = rows.select(
        "cik",
        "taxonomy",
        "concept",
        "label",
        "unit",
        F.col("f.val").alias("value"),
        F.col("f.start").alias("period_start"),
        F.col("f.end").alias("period_end"),
        F.col("f.accn").alias("accession"),
        F.col("f.fy").alias("fiscal_year"),
        F.col("f.fp").alias("fiscal_period"),
        F.col("f.form").alias("form_type"),
        F.col("f.filed").alias("filed"),
    )
    return out.filter(F.col("form_type").isin(forms)) if forms else out


def first_unit(facts: DataFrame) -> DataFrame:
    """Of a concept's units only the first of USD, USD/shares, shares that it has."""
    order = F.coalesce(*[F.when(F.col("unit") == u, F.lit(i)) for i, u in enumerate(UNITS)])
    known = facts.withColumn("_o", order).filter("_o is not null")
    best = known.groupBy("cik", "concept").agg(F.min("_o").alias("_o"))
    return known.join(best, ["cik", "concept", "_o"], "left_semi").drop("_o")


def latest_periods(facts: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """Facts of the n latest distinct period ends of each key; domestic annual reports, else foreign ones."""
    home = F.col("form_type").startswith("10-K") & (F.coalesce("fiscal_period", F.lit("FY")) == "FY")
    foreign = F.col("form_type").startswith("20-F")
    tagged = facts.withColumns({"_h": home, "_f": foreign}).filter("_h or _f")
    has = tagged.groupBy(*keys).agg(F.max("_h").alias("_any"))
    picked = tagged.join(has, keys).filter("_h or not _any")
    w = Window.partitionBy(*keys).orderBy(F.desc("period_end"))
    return picked.withColumn("_r", F.dense_rank().over(w)).filter(F.col("_r") <= n).drop("_h", "_f", "_any", "_r")


def point_lookup(facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The filed value of each wanted (cik, concept, period_end, form_type); us-gaap before dei before invest."""
    order = F.when(F.col("taxonomy") == "us-gaap", 0).when(F.col("taxonomy") == "dei", 1).when(F.col("taxonomy") == "invest", 2)
    keys = ["cik", "concept", "period_end", "form_type"]
    best = facts.withColumn("_o", order).filter("_o is not null").groupBy(*keys).agg(F.min_by("value", F.struct("_o", "filed")).alias("filed_value"))
    return wanted.join(best, keys, "left")


def graph_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of graph files ({"edges": [...]}); blank ends are left out."""
    shape = "edges array<struct<source:string,target:string,relation:string,confidence:double,source_file:string,source_location:string>>"
    rows = spark.read.schema(shape).option("multiLine", True).json(path).select(F.inline("edges"))
    edges = rows.select(F.col("source").alias("subject"), F.col("relation").alias("predicate"), F.col("target").alias("object"), "confidence", "source_file", F.col("source_location").alias("source_loc"))
    return edges.filter((F.coalesce(F.trim("subject"), F.lit("")) != "") & (F.coalesce(F.trim("object"), F.lit("")) != ""))


def typed_fields(tagged: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, value, provenance, concept: tagged facts (keys, concept, value) and rows of statement tables (keys, label, value)."""
    facts = tagged.select(*keys, F.col("concept").alias("name"), "value", F.lit("XBRL").alias("provenance"), F.nullif("concept", F.lit("")).alias("concept"))
    lines = rows.select(*keys, F.col("label").alias("name"), "value", F.lit("STRUCTURED_TABLE").alias("provenance"), F.lit(None).cast("string").alias("concept"))
    return facts.unionByName(lines)


def golden_set(spark: SparkSession, path: str, id: int | None = None, mode: str | None = None) -> DataFrame:
    from quillspark.operators.relational import optional_filter

    return optional_filter(spark.read.schema(SCHEMAS["golden"]).option("header", True).option("multiLine", True).option("escape", '"').csv(path), id=id, failure_mode=mode)


def views(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Register Parquet tables of a folder as views."""
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)
