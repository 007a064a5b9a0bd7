"""Graph queries over edges made of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import graph as G
from quillspark.plans.registry import query, table

#: Customer-to-nation, nation-to-region and supplier-to-nation edges with made-up types and confidences.
#: The number of chunks follows the tables, so that the limit of a chunk stays one.
EDGE_SQL = """edges AS (
SELECT c_mktsegment AS ticker, 'c' || (c_custkey % greatest(100, (SELECT count(*) FROM customer) * 2 // 3)) AS chunk_id, c_name AS subject, ' has segment' AS predicate, 'NATION_' || c_nationkey AS object, (c_custkey % 13) / 10.0 AS confidence, CASE WHEN c_custkey % 7 = 0 THEN 'Thing' ELSE 'Company' END AS subject_type, CASE WHEN c_custkey % 5 = 0 THEN 'Metric' ELSE 'Segment' END AS object_type FROM customer
UNION ALL SELECT 'SUPPLY', 's' || (s_suppkey % greatest(10, (SELECT count(*) FROM supplier))), s_name, 'supplied by', 'NATION_' || s_nationkey, (s_suppkey % 11) / 10.0, 'Company', 'Metric' FROM supplier
UNION ALL SELECT 'WORLD', 'n', n_name, '', r_name, 1.0, 'Metric', 'Regulator' FROM nation JOIN region ON n_regionkey = r_regionkey),
valid AS (SELECT ticker, chunk_id, subject, CASE trim(predicate) WHEN 'has segment' THEN 'HAS_SEGMENT' WHEN 'supplied by' THEN 'SUPPLIED_BY' ELSE 'RELATED_TO' END AS predicate, object, greatest(0.0, least(1.0, confidence)) AS confidence, subject_type, object_type FROM edges WHERE subject_type <> 'Thing' AND least(1.0, confidence) >= 0.5),
ids AS (SELECT *, sha1(concat_ws(chr(31), ticker, chunk_id, lower(subject), lower(predicate), lower(object))) AS id FROM valid),
triples AS (SELECT * FROM ids QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY confidence DESC, id) <= 8)"""


def chunks(df: DataFrame, up: int, down: int, least: int) -> int:
    """How many chunks a table's rows are dealt to: in proportion to the table, so that a chunk holds a few rows at any size."""
    return max(least, df.count() * up // down)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, n, r = (table(spark, sf_dir, x) for x in ("customer", "supplier", "nation", "region"))
    tag = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    part = lambda col, k: (F.col(col) % k) / 10.0
    c_chunks, s_chunks = chunks(c, 2, 3, 100), chunks(s, 1, 1, 10)
    a = c.select(F.col("c_mktsegment").alias("ticker"), F.concat(F.lit("c"), (F.col("c_custkey") % c_chunks).cast("string")).alias("chunk_id"), F.col("c_name").alias("subject"), F.lit(" has segment").alias("predicate"), tag("NATION_", "c_nationkey").alias("object"), part("c_custkey", 13).alias("confidence"), F.when(F.col("c_custkey") % 7 == 0, "Thing").otherwise("Company").alias("subject_type"), F.when(F.col("c_custkey") % 5 == 0, "Metric").otherwise("Segment").alias("object_type"))
    b = s.select(F.lit("SUPPLY").alias("ticker"), F.concat(F.lit("s"), (F.col("s_suppkey") % s_chunks).cast("string")).alias("chunk_id"), F.col("s_name").alias("subject"), F.lit("supplied by").alias("predicate"), tag("NATION_", "s_nationkey").alias("object"), part("s_suppkey", 11).alias("confidence"), F.lit("Company").alias("subject_type"), F.lit("Metric").alias("object_type"))
    d = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("WORLD").alias("ticker"), F.lit("n").alias("chunk_id"), F.col("n_name").alias("subject"), F.lit("").alias("predicate"), F.col("r_name").alias("object"), F.lit(1.0).alias("confidence"), F.lit("Metric").alias("subject_type"), F.lit("Regulator").alias("object_type"))
    return a.unionByName(b).unionByName(d)


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.valid_triples(edges(spark, sf_dir))


@query(f"WITH {EDGE_SQL} SELECT id, chunk_id, subject, predicate, object, round(confidence, 2) AS confidence FROM triples")
def triple_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: candidate triples checked, cleaned and capped a chunk."""
    return triples(spark, sf_dir).select("id", "chunk_id", "subject", "predicate", "object", F.round("confidence", 2).alias("confidence"))


@query(f"WITH {EDGE_SQL} SELECT id FROM triples WHERE chunk_id IN ('c1', 'c2', 's1', 'n') AND id NOT IN (SELECT id FROM triples WHERE chunk_id IN ('c1', 's1')) GROUP BY id")
def triple_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only triples whose id is new, each once."""
    t = triples(spark, sf_dir)
    old, new = t.filter(F.col("chunk_id").isin("c1", "s1")), t.filter(F.col("chunk_id").isin("c1", "c2", "s1", "n"))
    return G.new_triples(old, new.unionByName(new)).select("id")


@query(f"WITH {EDGE_SQL}, m AS (SELECT subject AS metric FROM triples WHERE subject_type = 'Metric' UNION SELECT object FROM triples WHERE object_type = 'Metric'), s AS (SELECT metric, regexp_replace(lower(metric), '[^a-z0-9]+', '', 'g') AS ms FROM m), c AS (SELECT DISTINCT n_name AS concept, regexp_replace(lower(n_name), '[^a-z0-9]+', '', 'g') AS cs FROM nation) SELECT metric, min(concept) AS concept FROM s JOIN c ON contains(ms, cs) OR contains(cs, ms) GROUP BY metric")
def metric_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric nodes and the concepts that verify them."""
    return G.metric_links(triples(spark, sf_dir), table(spark, sf_dir, "nation").select(F.col("n_name").alias("concept")))


@query(f"WITH {EDGE_SQL} SELECT id, subject, object FROM triples WHERE subject ILIKE '%supplier%' OR object ILIKE '%supplier%' OR subject ILIKE '%nation_1%' OR object ILIKE '%nation_1%' ORDER BY confidence DESC NULLS LAST, id LIMIT 50")
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples about named entities."""
    return G.entity_search(triples(spark, sf_dir), ["Supplier", "nation_1"], 50).select("id", "subject", "object")


@query(f"WITH {EDGE_SQL} SELECT predicate, count(*) AS n, round(avg(confidence), 2) AS avg_confidence FROM triples GROUP BY predicate")
def graph_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates with counts and mean confidence."""
    return triples(spark, sf_dir).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 2).alias("avg_confidence"))


@query(f"WITH {EDGE_SQL} SELECT ticker, count(*) AS n, count(DISTINCT predicate) AS predicates, count(*) FILTER (WHERE predicate = 'SUPPLIED_BY' OR object_type = 'Regulator') AS verified, count(DISTINCT object_type) AS object_types FROM triples WHERE ticker <> '' GROUP BY ticker")
def graph_by_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5, A4-A6."""
    t = triples(spark, sf_dir).filter("ticker <> ''")
    return t.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("predicate").alias("predicates"), F.count_if((F.col("predicate") == "SUPPLIED_BY") | (F.col("object_type") == "Regulator")).alias("verified"), F.count_distinct("object_type").alias("object_types"))


@query(f"WITH {EDGE_SQL}, n AS (SELECT subject AS node FROM triples UNION ALL SELECT object FROM triples) SELECT node, count(*) AS degree FROM n GROUP BY node ORDER BY degree DESC, node LIMIT 15")
def degree_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes with most edges."""
    return G.seed_nodes(triples(spark, sf_dir), 15)


@query(f"WITH {EDGE_SQL} SELECT id, chunk_id FROM triples WHERE chunk_id = 'c7' ORDER BY id LIMIT 1")
def triple_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One piece of evidence by key."""
    return triples(spark, sf_dir).filter("chunk_id = 'c7'").orderBy("id").limit(1).select("id", "chunk_id")


@query(
    """
WITH e AS (SELECT DISTINCT 'P' || p_partkey AS ticker, 'P' || (p_partkey * 7 % (SELECT count(*) FROM part)) AS object FROM part WHERE p_partkey % 4 = 0),
s AS (SELECT 'P' || p_partkey AS ticker, p_brand AS sector FROM part),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY sector ORDER BY ticker) <= 5),
u AS (SELECT ticker, object AS peer, 0 AS way FROM e UNION ALL SELECT object, ticker, 1 FROM e UNION ALL SELECT s.ticker, f.ticker, 2 FROM s JOIN f USING (sector)),
g AS (SELECT ticker, peer, min(way) AS way FROM u WHERE ticker <> peer GROUP BY ALL)
SELECT ticker, peer, CAST(row_number() OVER (PARTITION BY ticker ORDER BY way, peer) AS INTEGER) AS rank FROM g QUALIFY rank <= 4"""
)
def peers_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peers by graph edges, then by sector."""
    p = table(spark, sf_dir, "part")
    n = max(1, p.count())
    name = lambda c: F.concat(F.lit("P"), c.cast("string"))
    e = p.filter("p_partkey % 4 = 0").select(name(F.col("p_partkey")).alias("ticker"), name(F.col("p_partkey") * 7 % n).alias("object")).distinct()
    return G.peers(e, p.select(name(F.col("p_partkey")).alias("ticker"), F.col("p_brand").alias("sector")))


@query("SELECT n_regionkey FROM (SELECT n_regionkey, string_agg(n_name, ' , ' ORDER BY n_name) AS l FROM nation GROUP BY 1) WHERE list_contains(list_transform(string_split(lower(l), ','), lambda x: trim(x)), 'nation_7')")
def comma_list_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: membership in a comma-separated list."""
    lists = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), " , ").alias("l"))
    return lists.filter(G.listed(F.col("l"), "Nation_7")).select("n_regionkey")


