"""Scans, predicates, joins, aggregates, windows, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import relational as R
from quillspark.plans.registry import query, table


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 AND l_shipdate >= TIMESTAMP '1998-01-01' AND l_suppkey IN (1, 2, 3, 5, 8)")
def scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality, range and IN predicates that reach the Parquet scan."""
    li = table(spark, sf_dir, "lineitem")
    kept = li.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40) & (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp")) & F.col("l_suppkey").isin(1, 2, 3, 5, 8))
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%' OR p_name LIKE '%red%'")
def contains_or_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment in an OR list."""
    part = table(spark, sf_dir, "part")
    return part.filter(R.contains_any(F.col("p_name"), ["ring", "red"])).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def pagination_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: one page of a full order."""
    orders = R.optional_filter(table(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority=None)
    return R.paginate(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 20, 40).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE concat('%', 'RED', '%') OR p_type ILIKE concat('%', 'econ', '%')")
def ilike_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive search in several columns."""
    part = table(spark, sf_dir, "part")
    return part.filter(R.ilike_any([F.col("p_name")], ["RED"]) | R.ilike_any([F.col("p_type")], ["econ"])).select("p_partkey", "p_name", "p_type")


@query("SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE source END), ''), lang) AS label FROM documents")
def coalesce_nullif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank-safe fallback."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", R.first_text(F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("source")), F.col("lang")).alias("label"))


@query("SELECT DISTINCT lang, source FROM documents ORDER BY lang, source")
def distinct_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L11."""
    return table(spark, sf_dir, "documents").select("lang", "source").distinct().orderBy("lang", "source")


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE props LIKE '%\"k\": 7%' AND event_type <> ''")
def json_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text search in a JSON column, extraction, substring of a time."""
    e = table(spark, sf_dir, "events")
    return e.filter(F.col("props").contains('"k": 7') & (F.col("event_type") != "")).select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 72 HOUR AND ts < TIMESTAMP '2024-01-20' GROUP BY event_type")
def lookback_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A look-back window before an explicit time."""
    e, as_of = table(spark, sf_dir, "events"), F.lit("2024-01-20").cast("timestamp")
    return e.filter((F.col("ts") >= as_of - F.make_interval(hours=F.lit(72))) & (F.col("ts") < as_of)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE instr('compare Supplier#000000003 with Supplier#000000007', s_name) > 0")
def reverse_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose name occurs in a question."""
    q = "compare Supplier#000000003 with Supplier#000000007"
    return table(spark, sf_dir, "supplier").filter(F.expr(f"instr('{q}', s_name) > 0")).select("s_suppkey", "s_name")


@query("SELECT o_orderkey, datediff('day', CAST(o_orderdate AS DATE), CAST(l AS DATE)) AS days FROM (SELECT o_orderkey, o_orderdate, max(l_shipdate) AS l FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) WHERE datediff('day', CAST(o_orderdate AS DATE), CAST(l AS DATE)) >= 300")
def period_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of at least 300 days."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    last = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", "o_orderdate").agg(F.max("l_shipdate").alias("l"))
    days = F.datediff(F.to_date("l"), F.to_date("o_orderdate"))
    return last.filter(days >= 300).select("o_orderkey", days.cast("long").alias("days"))


@query("SELECT l.doc_id, l.quality, d.source, d.lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def join_inner_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts with their decisions."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "quality", "source", "lang")


@query("SELECT c_custkey, coalesce(n_name, 'unknown') AS nation, coalesce(total, 0.0) AS total FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3 LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) ON o_custkey = c_custkey")
def join_left_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and figures stitched by key with defaults."""
    c, n, o = (table(spark, sf_dir, x) for x in ("customer", "nation", "orders"))
    totals = o.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    joined = c.join(n.filter("n_regionkey < 3"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(totals, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").filter("o_totalprice > 450000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_new_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys not loaded yet."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query(
    """
WITH a AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS period, round(sum(o_totalprice), 2) AS revenue FROM orders WHERE o_orderstatus = 'F' AND month(o_orderdate) <> 2 GROUP BY 1),
b AS (SELECT year(l_shipdate) * 12 + month(l_shipdate) AS period, round(sum(l_extendedprice), 2) AS gp, round(sum(l_quantity), 2) AS cogs FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT CAST(coalesce(a.period, b.period) AS INTEGER) AS period, round(coalesce(revenue, gp + cogs), 2) AS revenue FROM a FULL OUTER JOIN b ON a.period = b.period"""
)
def full_outer_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue, or gross profit plus cost where it is missing."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    period = lambda c: (F.year(c) * 12 + F.month(c)).alias("period")
    a = o.filter((F.col("o_orderstatus") == "F") & (F.month("o_orderdate") != 2)).groupBy(period("o_orderdate")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    b = li.filter("l_returnflag = 'A'").groupBy(period("l_shipdate")).agg(F.round(F.sum("l_extendedprice"), 2).alias("gp"), F.round(F.sum("l_quantity"), 2).alias("cogs"))
    return R.recover(a, b, ["period"], "revenue", F.col("gp") + F.col("cogs")).select("period", F.round("revenue", 2).alias("revenue"))


@query(
    """
WITH m AS (SELECT DISTINCT p_type AS metric, regexp_replace(lower(p_type), '[^a-z0-9]+', '', 'g') AS ms FROM part),
c AS (SELECT DISTINCT p_name AS concept, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS cs FROM part UNION SELECT DISTINCT p_type || ' ' || p_brand, regexp_replace(lower(p_type || p_brand), '[^a-z0-9]+', '', 'g') FROM part)
SELECT metric, min(concept) AS concept FROM m JOIN c ON length(ms) >= 4 AND length(cs) >= 4 AND (contains(ms, cs) OR contains(cs, ms)) GROUP BY metric"""
)
def theta_substring_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels linked by mutual containment of stems; both sides are distinct vocabularies that meet on shared letters."""
    part = table(spark, sf_dir, "part")
    metric = part.select(F.col("p_type").alias("metric")).distinct().withColumn("ms", R.stem(F.col("metric")))
    concepts = part.select(F.col("p_name").alias("concept")).union(part.select(F.concat_ws(" ", "p_type", "p_brand"))).distinct().withColumn("cs", R.stem(F.col("concept")))
    return R.contained_links(concepts, metric, "cs", "ms").groupBy("metric").agg(F.min("concept").alias("concept"))


@query("SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS latest_order FROM orders GROUP BY o_custkey")
def latest_scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest key by period."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest_order"))


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities, count(DISTINCT o_orderstatus) AS statuses, count(*) FILTER (WHERE o_totalprice > 400000) AS large FROM orders")
def count_distinct_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2: counts and distinct counts in one pass."""
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderpriority").alias("priorities"), F.count_distinct("o_orderstatus").alias("statuses"), F.count_if(F.col("o_totalprice") > 400000).alias("large"))


@query("SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(avg(o_totalprice), 2) AS avg_price, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at FROM orders GROUP BY o_orderpriority")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aggregate over the audit rows."""
    is_ = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"), F.round(F.avg("o_totalprice"), 2).alias("avg_price"), is_("F").alias("n_f"), is_("O").alias("n_o"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS visitors, round(sum(value), 2) AS total FROM events GROUP BY 1")
def event_summary_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day."""
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("visitors"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 15")
def event_summary_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent events."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("visitors")).orderBy(F.desc("n"), "event_type").limit(15)


@query("SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def event_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest events."""
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "event_type", "user_id")


@query("SELECT CAST(ts AS DATE) AS day, round(max(value) FILTER (WHERE event_type = 'click'), 2) AS click, round(max(value) FILTER (WHERE event_type = 'error'), 2) AS error, round(max(value) FILTER (WHERE event_type = 'view'), 2) AS view, round(max(value) FILTER (WHERE event_type = 'purchase'), 2) AS purchase, round(max(value) FILTER (WHERE event_type = 'signup'), 2) AS signup FROM events GROUP BY 1")
def pivot_period_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period by label; a column for every event type there is."""
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).pivot("event_type").agg(F.round(F.max("value"), 2))


@query("SELECT count(*) AS n, count(embedding) AS n_vectors, min(len(embedding)) AS least, max(len(embedding)) AS most, count(DISTINCT len(embedding)) AS n_sizes FROM embeddings")
def vector_dim_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, S40, P18."""
    size = F.size("embedding").cast("long")
    return table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("n_vectors"), F.min(size).alias("least"), F.max(size).alias("most"), F.count_distinct(size).alias("n_sizes"))


@query(
    """
WITH snap AS (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 2 = 0), now AS (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 3 = 0)
SELECT 'vanished' AS what, source, lang FROM (SELECT * FROM snap EXCEPT SELECT * FROM now) UNION ALL SELECT 'new', source, lang FROM (SELECT * FROM now EXCEPT SELECT * FROM snap)"""
)
def corpus_guardrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that vanished or came since a snapshot."""
    d = table(spark, sf_dir, "documents")
    snap, now = (d.filter(f"doc_id % {k} = 0").select("source", "lang").distinct() for k in (2, 3))
    mark = lambda df, what: df.select(F.lit(what).alias("what"), "source", "lang")
    return mark(snap.join(now, ["source", "lang"], "left_anti"), "vanished").unionByName(mark(now.join(snap, ["source", "lang"], "left_anti"), "new"))


@query("SELECT user_id, event_type, value, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each key."""
    return R.top_per_key(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "value", "ts")


@query(
    """
WITH y AS (
  SELECT n_name, year(o_orderdate) AS yr, sum(o_totalprice) AS revenue
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT n_name, CAST(yr AS INTEGER) AS yr, round(revenue, 2) AS revenue,
       round((revenue - lag(revenue) OVER w) / nullif(abs(lag(revenue) OVER w), 0) * 100, 4) AS revenue_yoy_pct
FROM y WINDOW w AS (PARTITION BY n_name ORDER BY yr)
"""
)
def period_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth over the prior period of a group."""
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    yearly = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", F.year("o_orderdate").alias("yr")).agg(F.sum("o_totalprice").alias("revenue"))
    prior = F.lag("revenue").over(Window.partitionBy("n_name").orderBy("yr"))
    growth = F.try_divide(F.col("revenue") - prior, F.nullif(F.abs(prior), F.lit(0.0))) * 100
    return yearly.select("n_name", "yr", F.round("revenue", 2).alias("revenue"), F.round(growth, 4).alias("revenue_yoy_pct"))


@query("SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS yr, arg_max(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) AS last_value FROM orders GROUP BY ALL")
def last_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each year."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("yr")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("last_value"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3")
def top3_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest three rows of each key."""
    return R.top_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT doc_id, source, round(avg(CAST(quality AS DOUBLE)) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING), 6) AS rate FROM labels JOIN documents USING (doc_id)")
def running_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative agreement in falling order of confidence."""
    v = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "source", "n_chars", F.col("quality").cast("long").alias("quality"))
    sums = {"agreed": F.col("quality"), "n": F.col("quality").isNotNull().cast("long")}
    running = R.prefix_sums(v, ["source"], R.ordered_ranges(v, -F.col("n_chars"), F.col("doc_id")), [-F.col("n_chars"), F.col("doc_id")], sums)
    return running.select("doc_id", "source", F.round(F.try_divide("agreed", "n"), 6).alias("rate"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) IN (SELECT DISTINCT CAST(ts AS DATE) FROM events ORDER BY 1 DESC LIMIT 6) GROUP BY ALL")
def last_n_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the latest six periods."""
    daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return R.last_periods(daily, "day", 6).select("day", "event_type", "n")


@query("SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang, md5(text) ORDER BY doc_id) = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of a composite key; a plain aggregate, so copies collapse before the shuffle."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source", "lang", F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source", "lang")


@query("SELECT n_nationkey AS key, n_name AS name FROM nation UNION SELECT s_nationkey, 'NATION_' || s_nationkey FROM supplier")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    return n.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).union(s.select("s_nationkey", F.concat(F.lit("NATION_"), "s_nationkey"))).distinct()


@query("SELECT n_regionkey, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS members FROM nation GROUP BY n_regionkey")
def ordered_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets as ordered lists."""
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("members"))


@query(
    """
WITH b AS (SELECT source, doc_id, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM documents),
p AS (SELECT source, CAST(k * 5000 AS BIGINT) AS pos FROM (SELECT DISTINCT source FROM documents), range(0, 6) t(k))
SELECT p.source, pos, doc_id FROM p JOIN b ON p.source = b.source AND pos >= start AND pos < start + n_chars"""
)
def range_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions inside intervals; an interval picks its positions from its key's short list of them, so there is no range join."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    ends = R.prefix_sums(d, ["source"], [F.floor(F.col("doc_id") / 1000)], [F.col("doc_id")], {"end": F.col("n_chars")})
    points = d.select("source").distinct().select("source", F.expr("sequence(0L, 25000L, 5000L)").alias("points"))
    inside = F.filter("points", lambda p: (p >= F.col("end") - F.col("n_chars")) & (p < F.col("end")))
    return ends.join(points, "source").select("source", F.explode(inside).alias("pos"), "doc_id")


@query("SELECT o_orderpriority, max(o_orderdate) AS latest FROM orders GROUP BY o_orderpriority ORDER BY latest DESC, o_orderpriority LIMIT 3")
def recent_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups with the latest rows."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.max("o_orderdate").alias("latest")).orderBy(F.desc("latest"), "o_orderpriority").limit(3)
