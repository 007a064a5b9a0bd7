"""Lookups, gates, scores, logs and typed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import filings as embedding
from quillspark.operators import governance as G
from quillspark.operators import graph
from quillspark.operators import questions as Q
from quillspark.operators import relational as R
from quillspark.operators import retrieval, texts
from quillspark.plans.questions import MET_SQL, NAMES_SQL, passage_names
from quillspark.plans.registry import query, table
from quillspark.plans.storage import scratch
from quillspark.sources import filings, tables, xbrl


@query("SELECT o_orderkey, o_orderdate, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey DESC) AS INTEGER) AS place FROM orders WHERE o_custkey = 7 AND (o_orderpriority LIKE '%URGENT%' OR o_orderpriority LIKE '%LOW%')")
def fact_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One company's facts whose concept holds any of some words, in a three-key order."""
    facts = R.facts_of(table(spark, sf_dir, "orders"), "o_custkey", 7, "o_orderpriority", ["URGENT", "LOW"])
    return R.numbered(facts, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_totalprice"), F.desc("o_orderkey")], "place").select("o_orderkey", "o_orderdate", "place")


@query("SELECT o_orderkey AS decision_id, o_orderstatus AS status FROM orders WHERE o_orderkey = 77")
def decision_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision by its id; the filter reaches the scan."""
    return R.optional_filter(table(spark, sf_dir, "orders"), o_orderkey=77).select(F.col("o_orderkey").alias("decision_id"), F.col("o_orderstatus").alias("status"))


@query("SELECT doc_id, length(text) AS size FROM documents WHERE source = 'src3' AND doc_id % 5 <> 0 AND text IS NOT NULL ORDER BY length(text) DESC, doc_id LIMIT 40")
def longest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest narrative chunks of a company first, 40 at most; tables are passed over."""
    chunks = table(spark, sf_dir, "documents").withColumn("content_type", F.when(F.col("doc_id") % 5 == 0, "table"))
    return texts.longest_narrative(chunks.filter("source = 'src3'"), "text", "doc_id", 40).select("doc_id", F.length("text").cast("long").alias("size"))


@query(rf"WITH {NAMES_SQL}, {MET_SQL}, b AS (SELECT doc_id, arg_min(v, struct_pack(n := -length(alias), a := alias, v := v)) AS company FROM hit GROUP BY doc_id) SELECT doc_id, company FROM documents LEFT JOIN b USING (doc_id)")
def uncovered_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest name of a list in every document, as whole words."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return Q.uncovered(rows, "doc_id", "text", passage_names(spark, sf_dir)).select("doc_id", "company")


@query(r"SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '(?:^|[^0-9A-Za-z_])(0\.[0-9]+|1\.0|0|1)(?:[^0-9A-Za-z_]|$)', 1), '') AS DOUBLE) AS score FROM documents")
def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: the first bare score in every text."""
    return table(spark, sf_dir, "documents").select("doc_id", G.judge_score(F.col("text")).alias("score"))


@query("SELECT event_id, CAST(props ->> 'k' AS DOUBLE) AS score, CAST(props ->> 'k' AS DOUBLE) AS in_prose, CAST(CASE props ->> 'k' WHEN '0' THEN 0 WHEN '1' THEN 1 END AS DOUBLE) AS bare FROM events")
def judge_scores_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: scores in the JSON of every event: as it is, in prose around it, and as a bare number."""
    e, k = table(spark, sf_dir, "events"), F.get_json_object("props", "$.k")
    return e.select("event_id", G.judge_score(F.col("props"), "k").alias("score"), G.judge_score(F.concat_ws(" ", "event_type", "props", "event_type"), "k").alias("in_prose"), G.judge_score(F.concat(F.lit("It is "), k, F.lit("."))).alias("bare"))


GATE_SQL = " OR ".join("contains(lower(text), '" + p.lower().replace("'", "''") + "')" for p in G.GATE_ABSTAINS)


@query(f"SELECT doc_id, CASE WHEN length(coalesce(text, '')) < {G.GATE_LENGTH} THEN 'too short' WHEN {GATE_SQL} THEN 'abstention' WHEN coalesce(quality, 0) = 0 THEN 'no sources' ELSE 'pass' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)")
def answer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are long enough, no abstentions, and carry a source, which is what their label counts."""
    said = table(spark, sf_dir, "documents").select("doc_id", G.gate(F.col("text"), F.lit(1)).alias("verdict"))  # judged before the join, so no text is shuffled
    unsourced = (F.col("verdict") == "pass") & (F.coalesce("quality", F.lit(0)) == 0)
    return said.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.when(unsourced, "no sources").otherwise(F.col("verdict")).alias("verdict"))


REFUSAL_SQL = " OR ".join("contains(lower(text), '" + p.replace("'", "''") + "')" for p in Q.REFUSALS)


@query(f"SELECT conv_id, turn, CASE WHEN role = 'assistant' AND regexp_matches(text, '[$0-9]') AND NOT ({REFUSAL_SQL}) THEN 'From filing text' ELSE '' END AS badge FROM conversations")
def text_grounded_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A badge only for answers, of all messages, that state a figure and decline nothing."""
    fits = (F.col("role") == "assistant") & Q.shows_figure(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(fits, "From filing text").otherwise("").alias("badge"))


@query(
    "WITH f AS (SELECT o_orderkey AS record_id, 'Revenues' AS name, o_totalprice AS value, 'XBRL' AS provenance, 'Revenues' AS concept FROM orders UNION ALL SELECT l_orderkey, 'Line ' || l_linenumber, l_quantity, 'STRUCTURED_TABLE', NULL FROM lineitem) SELECT record_id, provenance, count(*) AS n, count(concept) AS n_concepts, round(sum(value), 2) AS total FROM f GROUP BY ALL"
)
def typed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged facts and table rows of a filing as fields with provenance."""
    tagged = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.lit("Revenues").alias("concept"), F.col("o_totalprice").alias("value"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.concat(F.lit("Line "), "l_linenumber").alias("label"), F.col("l_quantity").alias("value"))
    fields = filings.typed_fields(tagged, rows, ["record_id"])
    return fields.groupBy("record_id", "provenance").agg(F.count(F.lit(1)).alias("n"), F.count("concept").alias("n_concepts"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "SELECT o_orderkey AS order_key, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, x.taxonomy, x.concept, CASE x.concept WHEN 'Revenues' THEN o_totalprice END AS number, CASE x.concept WHEN 'Revenues' THEN 'USD' END AS unit, strftime(o_orderdate, '%Y-%m-%d') AS period_end, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS member FROM orders, (VALUES ('us-gaap', 'Revenues'), ('dei', 'DocumentType')) x(taxonomy, concept)"
)
def xbrl_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's orders as an XBRL instance, written, read back and joined with contexts and units; orders in part are dimensional."""
    o = table(spark, sf_dir, "orders")
    ref, day = F.concat(F.lit("c"), "o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    segment = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit('<xbrli:segment><xbrldi:explicitMember dimension="own:Priority">'), "o_orderpriority", F.lit("</xbrldi:explicitMember></xbrli:segment>"))).otherwise("")
    who = F.concat(F.lit('<xbrli:entity><xbrli:identifier scheme="http://www.sec.gov/CIK">'), F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("</xbrli:identifier>"), segment, F.lit("</xbrli:entity>"))
    context = F.concat(F.lit('<xbrli:context id="'), ref, F.lit('">'), who, F.lit("<xbrli:period><xbrli:instant>"), day, F.lit("</xbrli:instant></xbrli:period></xbrli:context>"))
    facts = F.concat(F.lit('<us-gaap:Revenues contextRef="'), ref, F.lit('" unitRef="usd" decimals="2">'), F.col("o_totalprice").cast("string"), F.lit('</us-gaap:Revenues><dei:DocumentType contextRef="'), ref, F.lit('">10-K &amp; more</dei:DocumentType>'))
    body = F.array_join(F.collect_list(F.concat(context, facts)), "")
    names = " ".join(f'xmlns:{n}="urn:{n}"' for n in ("xbrli", "xbrldi", "us-gaap", "dei"))
    whole = o.groupBy("o_custkey").agg(F.concat(F.lit(f'<xbrli:xbrl {names}><xbrli:unit id="usd"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit>'), body, F.lit("</xbrli:xbrl>")).alias("value"))
    path = scratch(spark)
    whole.select("value").write.text(path)
    found = xbrl.column_facts(spark.read.text(path), "value", ["us-gaap:Revenues", "dei:DocumentType"])
    return found.select(F.substring("context", 2, 30).cast("long").alias("order_key"), "cik", "taxonomy", "concept", "number", "unit", "period_end", F.get("dimensions", 0)["member"].alias("member"))


@query("SELECT doc_id, substr(text, 1, 200) AS event, substr(source || '/' || lang || '/' || text, 1, 100) AS view FROM documents")
def event_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the log keeps them, names and views cut to their lengths."""
    d = table(spark, sf_dir, "documents")
    path = scratch(spark)
    tables.append_events(d.select("doc_id", F.col("text").alias("event"), F.concat_ws("/", "source", "lang", "text").alias("view")), path)
    return spark.read.parquet(path)


@query("SELECT o_custkey AS record, '[' || string_agg('\"' || o_orderkey || '\"', ',' ORDER BY o_orderkey) || ']' AS steps FROM orders GROUP BY 1")
def audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows with their lists as JSON text."""
    steps = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("record")).agg(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>").alias("steps"))
    path = scratch(spark)
    tables.append(tables.lists_as_json(steps), path)
    return spark.read.parquet(path)


@query("SELECT 'a' AS run_id, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0")
def eval_run_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run counts once its own row is there, which is written after its rows; rows of broken runs aren't seen."""
    o, folder = table(spark, sf_dir, "orders"), scratch(spark)
    tables.append_run(o.filter("o_orderkey % 2 = 0").select("o_orderkey"), spark.createDataFrame([("a",)], "run_id string"), folder, "a")
    tables.append(o.filter("o_orderkey % 2 = 1").select("o_orderkey", F.lit("b").alias("run_id")), f"{folder}/rows")  # a run that broke off
    return tables.finished_rows(spark, folder).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


FILES_SQL = """f AS (SELECT o_custkey AS cik, CASE o_orderkey % 4 WHEN 0 THEN 'dei' ELSE 'us-gaap' END AS taxonomy, CASE o_orderkey % 3 WHEN 0 THEN 'Revenues' WHEN 1 THEN 'Assets' ELSE 'EarningsPerShareBasic' END AS concept,
 CASE o_orderkey % 7 WHEN 0 THEN 'EUR' WHEN 1 THEN 'shares' WHEN 2 THEN 'USD/shares' ELSE 'USD' END AS unit, o_totalprice AS value, strftime(o_orderdate, '%Y-%m-%d') AS period_end, o_orderkey AS accession, CASE o_orderkey % 5 WHEN 0 THEN '10-Q' WHEN 1 THEN '20-F' ELSE '10-K' END AS form FROM orders WHERE o_custkey IS NOT NULL),
k AS (SELECT *, CASE unit WHEN 'USD' THEN 0 WHEN 'USD/shares' THEN 1 WHEN 'shares' THEN 2 END AS o FROM f WHERE form IN ('10-K', '20-F')),
b AS (SELECT * FROM k WHERE o IS NOT NULL QUALIFY o = min(o) OVER (PARTITION BY cik, concept)),
h AS (SELECT *, bool_or(form = '10-K') OVER (PARTITION BY cik, concept) AS home FROM b),
p AS (SELECT *, dense_rank() OVER (PARTITION BY cik, concept ORDER BY period_end DESC) AS r FROM h WHERE form = '10-K' OR NOT home)"""


@query(f"WITH {FILES_SQL} SELECT cik, taxonomy, concept, unit, round(value, 2) AS value, period_end, CAST(accession AS VARCHAR) AS accession, form AS form_type FROM p WHERE r <= 2")
def company_fact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact files of every company, made of its orders, to long rows: annual forms, the first unit that a concept has, its two latest periods, domestic before foreign."""
    o, folder, k = table(spark, sf_dir, "orders"), scratch(spark), F.col("o_orderkey")
    unit = F.when(k % 7 == 0, "EUR").when(k % 7 == 1, "shares").when(k % 7 == 2, "USD/shares").otherwise("USD")
    fact = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("end"), F.col("o_totalprice").alias("val"), k.cast("string").alias("accn"), F.lit("FY").alias("fp"), F.when(k % 5 == 0, "10-Q").when(k % 5 == 1, "20-F").otherwise("10-K").alias("form"))
    rows = o.select(F.col("o_custkey").alias("cik"), F.when(k % 4 == 0, "dei").otherwise("us-gaap").alias("t"), F.when(k % 3 == 0, "Revenues").when(k % 3 == 1, "Assets").otherwise("EarningsPerShareBasic").alias("c"), unit.alias("u"), fact.alias("f"))
    by_unit = rows.groupBy("cik", "t", "c", "u").agg(F.collect_list("f").alias("f"))
    by_concept = by_unit.groupBy("cik", "t", "c").agg(F.map_from_entries(F.collect_list(F.struct("u", "f"))).alias("units"))
    by_taxonomy = by_concept.groupBy("cik", "t").agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct("units").alias("d")))).alias("m"))
    files = by_taxonomy.groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("t", "m"))).alias("facts"))
    files.write.json(folder)
    facts = filings.latest_periods(filings.first_unit(filings.company_facts(spark, folder, filings.ANNUAL_FORMS, lines=True)), ["cik", "concept"], 2)
    return facts.select("cik", "taxonomy", "concept", "unit", F.round("value", 2).alias("value"), "period_end", "accession", "form_type")


POINT_SQL = """f AS (SELECT user_id AS cik, event_type AS concept, CAST(ts AS DATE) AS period_end, CASE event_id % 4 WHEN 0 THEN 'us-gaap' WHEN 1 THEN 'dei' WHEN 2 THEN 'invest' ELSE 'other' END AS taxonomy, value, event_id AS filed FROM events),
w AS (SELECT DISTINCT cik, concept, period_end FROM f WHERE cik % 3 = 0),
b AS (SELECT cik, concept, period_end, arg_min(value, struct_pack(o := CASE taxonomy WHEN 'us-gaap' THEN 0 WHEN 'dei' THEN 1 ELSE 2 END, f := filed)) AS v FROM f WHERE taxonomy <> 'other' GROUP BY ALL)"""


@query(f"WITH {POINT_SQL} SELECT w.cik, w.concept, w.period_end, round(v, 2) AS filed_value FROM w LEFT JOIN b ON w.cik = b.cik AND w.concept = b.concept AND w.period_end = b.period_end")
def fact_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filed values by company, concept and period, by the order of taxonomies."""
    k = F.col("event_id") % 4
    taxonomy = F.when(k == 0, "us-gaap").when(k == 1, "dei").when(k == 2, "invest").otherwise("other")
    f = table(spark, sf_dir, "events").select(F.col("user_id").alias("cik"), F.col("event_type").alias("concept"), F.to_date("ts").alias("period_end"), F.lit("10-K").alias("form_type"), taxonomy.alias("taxonomy"), "value", F.col("event_id").alias("filed"))
    wanted = f.filter("cik % 3 = 0").select("cik", "concept", "period_end", "form_type").distinct()
    return filings.point_lookup(f, wanted).select("cik", "concept", "period_end", F.round("filed_value", 2).alias("filed_value"))


@query("SELECT n_name AS subject, 'in' AS predicate, r_name AS object, round(n_nationkey / 10.0, 1) AS confidence FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 0")
def graph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of graph files, a file a region; blank ends are left out."""
    n, r, folder = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), scratch(spark)
    edge = F.struct(F.when(F.col("n_nationkey") % 5 == 0, " ").otherwise(F.col("n_name")).alias("source"), F.col("r_name").alias("target"), F.lit("in").alias("relation"), (F.col("n_nationkey") / 10.0).alias("confidence"))
    n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.collect_list(edge).alias("edges")).select("edges").repartition(5).write.option("maxRecordsPerFile", 1).json(folder)
    return filings.graph_edges(spark, folder).select("subject", "predicate", "object", "confidence")


@query("SELECT CAST(item_id AS INTEGER) AS id, text AS question FROM benchmark WHERE item_id % 3 = 1")
def golden_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of one failure mode from a CSV file with line breaks and quotes."""
    b, folder = table(spark, sf_dir, "benchmark"), scratch(spark)
    values = {"id": F.col("item_id").cast("int"), "question": F.col("text"), "failure_mode": F.when(F.col("item_id") % 3 == 1, "segment").otherwise("baseline")}
    columns = [c.split()[0] for c in filings.SCHEMAS["golden"].split(", ")]
    b.select(*[values.get(c, F.lit(None).cast("string")).alias(c) for c in columns]).write.option("header", True).option("escape", '"').csv(folder)
    return filings.golden_set(spark, folder, mode="segment").select("id", "question")


@query("SELECT doc_id, n_chars AS rerank_score FROM documents WHERE source = 'src1' ORDER BY n_chars DESC, doc_id LIMIT 10")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of a candidate list by a scorer given as a column."""
    return retrieval.rerank(table(spark, sf_dir, "documents").filter("source = 'src1'"), F.col("n_chars"), "doc_id", 10).select("doc_id", "rerank_score")


@query(
    "WITH o AS (SELECT o_orderkey, string_split(o_orderpriority, '-') AS p, CAST(pow(10.0, o_totalprice / 1000) AS VARCHAR) AS big FROM orders) "
    "SELECT o_orderkey, TRY_CAST(p[1] AS DOUBLE) AS number, TRY_CAST(p[2] AS DOUBLE) AS label, CASE WHEN isfinite(TRY_CAST(big AS DOUBLE)) THEN 1 ELSE 0 END AS held FROM o"
)
def finite_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: of texts only finite numbers count: both halves of every order's priority, and powers that leave the range of doubles."""
    from quillspark.functions.numbers import finite

    part = lambda i: finite(F.get(F.split("o_orderpriority", "-"), i))
    big = F.pow(F.lit(10.0), F.col("o_totalprice") / 1000).cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", part(0).alias("number"), part(1).alias("label"), finite(big).isNotNull().cast("int").alias("held"))


@query("SELECT doc_id FROM documents WHERE source LIKE 'src1%' AND source NOT LIKE 'src19%'")
def prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prefix without a longer one."""
    return table(spark, sf_dir, "documents").filter(R.prefixed(F.col("source"), "src1", "src19")).select("doc_id")


@query("SELECT conv_id, turn, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, ' ')) END AS n, 0 AS n_cut, 0 AS n_plain FROM conversations")
def tolerant_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the words of every message as a JSON list, read back; the same list without its last bracket and the plain text are no lists."""
    from quillspark.functions.text import string_list

    listed = F.to_json(F.split("text", " "))
    size = lambda c: F.size(string_list(c))
    cut = F.regexp_replace(listed, r"\]$", "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", size(listed).alias("n"), size(cut).alias("n_cut"), size(F.col("text")).alias("n_plain"))


@query("SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ': ' || p_type END AS text, 64 AS dims FROM part")
def company_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and descriptions of companies to one text and a vector each; a company without a description has its name alone."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("description"))
    return embedding.described(p, "p_name", "description", embedding.hashed_vectors(64)).select("p_partkey", "text", F.size("embedding").alias("dims"))


@query(
    "WITH covered AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND user_id % 4 <> 0), fresh AS (SELECT user_id, event_type AS concept, value FROM events JOIN covered USING (user_id) WHERE event_id % 2 = 1) "
    "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT user_id, event_type AS concept, value FROM events WHERE event_id % 2 = 0 AND user_id NOT IN (SELECT user_id FROM fresh) UNION ALL SELECT * FROM fresh) GROUP BY 1"
)
def coverage_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the covered companies replaced by what their new files hold; a company without new facts keeps its old ones."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("concept"), "value", "event_id")
    covered = e.filter("concept = 'purchase' and user_id % 4 <> 0").select("user_id").distinct()
    fresh = e.filter("event_id % 2 = 1").join(covered, "user_id", "left_semi").drop("event_id")
    stored = R.replace_partitions(e.filter("event_id % 2 = 0").drop("event_id"), fresh, ["user_id"])
    return stored.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    """WITH c AS (SELECT source, doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) <= 40),
t AS (SELECT DISTINCT source AS ticker, 'd' || doc_id AS chunk_id, upper(source) AS subject, 'REPORTS' AS predicate, 'Metric ' || lang AS object FROM c WHERE doc_id % 3 <> 0),
i AS (SELECT sha1(concat_ws(chr(31), ticker, chunk_id, lower(subject), lower(predicate), lower(object))) AS id, object FROM t)
SELECT id, CASE WHEN object = 'Metric en' THEN 'metricen' END AS concept FROM i"""
)
def graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each company its longest chunks, the triples read from them, checked and stored once, and their metrics linked to filed concepts."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "lang", F.length("text").alias("size"))
    some = R.top_per_key(d, ["source"], [F.desc("size"), F.col("doc_id")], 40)
    read = some.select(F.col("source").alias("ticker"), F.concat(F.lit("d"), "doc_id").alias("chunk_id"), F.upper("source").alias("subject"), F.lit(" reports ").alias("predicate"), F.concat(F.lit("Metric "), "lang").alias("object"), F.when(F.col("doc_id") % 3 == 0, 0.2).otherwise(0.9).alias("confidence"), F.lit("Company").alias("subject_type"), F.lit("Metric").alias("object_type"))
    triples = graph.valid_triples(read)
    stored = graph.new_triples(triples.limit(0), triples.unionByName(triples))
    links = graph.metric_links(stored, spark.createDataFrame([("metricen",)], "concept string"))
    return stored.join(links, F.col("object") == F.col("metric"), "left").select("id", "concept")
