"""Queries on merges, sinks, sources and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import relational as R
from quillspark.plans.registry import query, table
from quillspark.sources import layouts as L
from quillspark.sources import tables
from quillspark.streaming import events as S
from quillspark.streaming import merge as M
from quillspark.streaming import timers


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder; only a local master may do without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or f"file://{tempfile.mkdtemp(prefix='spark-scratch-')}"
    return f"{root}/{uuid.uuid4().hex}"


@query("WITH u AS (SELECT user_id, event_type, value, ts, event_id % 2 AS new, event_id FROM events) SELECT user_id, event_type, round(arg_max(value, struct_pack(a := ts, b := new, c := event_id)), 2) AS value FROM u GROUP BY ALL")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each key of old and new rows."""
    e = table(spark, sf_dir, "events")
    old, new = e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1")
    return R.keyed_latest(old, new, ["user_id", "event_type"], "ts").select("user_id", "event_type", F.round("value", 2).alias("value"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are new."""
    o = table(spark, sf_dir, "orders")
    return R.insert_ignore(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"), ["o_custkey"]).select("o_custkey")


@query("SELECT source, doc_id FROM documents WHERE doc_id % 2 = 0 AND source NOT IN (SELECT source FROM documents WHERE doc_id % 2 = 1 AND source IN ('src1', 'src2')) UNION ALL SELECT source, doc_id FROM documents WHERE doc_id % 2 = 1 AND source IN ('src1', 'src2')")
def delete_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a key replaced."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    return R.replace_partitions(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1 and source in ('src1', 'src2')"), ["source"]).select("source", "doc_id")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'patched' ELSE s_name END AS s_name, CASE WHEN s_suppkey % 6 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values patched by key."""
    s = table(spark, sf_dir, "supplier")
    changes = s.filter("s_suppkey % 3 = 0").select("s_suppkey", F.lit("patched").alias("s_name"), F.when(F.col("s_suppkey") % 6 == 0, 0.0).alias("s_acctbal"))
    return R.patch(s, changes, "s_suppkey", ["s_name", "s_acctbal"]).select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported to Parquet and restored where nothing is left."""
    n, folder = table(spark, sf_dir, "nation"), scratch(spark)
    tables.snapshot({"nation": n}, folder)
    return tables.restore(spark, folder, "nation", n.limit(0))


@query("SELECT s_nationkey, s_suppkey FROM supplier WHERE s_nationkey % 2 = 1 OR s_suppkey % 2 = 0")
def partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the partitions that are brought are rewritten."""
    s, path = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"), scratch(spark)
    tables.replace_partitions(s, path, ["s_nationkey"])
    tables.replace_partitions(s.filter("s_nationkey % 2 = 0 and s_suppkey % 2 = 0"), path, ["s_nationkey"])
    kept = spark.read.parquet(path)
    none_left = s.filter("s_nationkey % 2 = 0").select("s_nationkey").distinct().join(s.filter("s_nationkey % 2 = 0 and s_suppkey % 2 = 0"), "s_nationkey", "left_anti")
    return kept.join(none_left, "s_nationkey", "left_anti").select("s_nationkey", "s_suppkey")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 5 = 0 OR label = 3")
def resumable_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vector is missing or of the wrong size."""
    e = table(spark, sf_dir, "embeddings")
    broken = e.withColumn("embedding", F.when(F.col("vec_id") % 5 == 0, None).when(F.col("label") == 3, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")))
    return tables.to_embed(broken, "embedding", 64).select("vec_id")


@query("SELECT label, count(*) AS n FROM embeddings WHERE label NOT IN (SELECT label FROM embeddings WHERE vec_id % 97 = 0) GROUP BY label")
def complete_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings of which no vector is missing."""
    e = table(spark, sf_dir, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 97 != 0, F.col("embedding")))
    return tables.complete_only(e, ["label"], "embedding").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section 2.17: daily counts by a stream over the events file, the last days flushed at the end."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return written(spark, S.daily_counts(stream), "complete").select("day", "event_type", "n", F.round("total", 2).alias("total"))


def written(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream over all that is there gives, as Parquet in the scratch folder; the driver holds none of it."""
    folder = scratch(spark)
    S.run_once(stream, f"{folder}/rows", f"{folder}/checkpoint", mode)
    if not tables.exists(spark, f"{folder}/rows"):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@query()
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact limiter as a stateful stream over the events, a user at a time."""
    table(spark, sf_dir, "events")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    requests = stream.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").cast("double").alias("at"))
    return written(spark, S.rate_limited(requests, 3600, 3, forget=False))


@query(
    "WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), "
    "w AS (SELECT user_id, event_id, i, true AS allowed, [us] AS passed FROM e WHERE i = 1 UNION ALL "
    "SELECT e.user_id, e.event_id, e.i, len(list_filter(passed, lambda t: e.us - t < 3600000000)) < 3, CASE WHEN len(list_filter(passed, lambda t: e.us - t < 3600000000)) < 3 THEN list_append(list_filter(passed, lambda t: e.us - t < 3600000000), e.us) ELSE passed END "
    "FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1) SELECT user_id AS key, event_id AS id, allowed FROM w"
)
def stream_limiter_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B10, section 2.17: three requests an hour of every user, by event time; users idle for two hours leave the state by timers."""
    folder = scratch(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    requests = stream.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    rows = timers.limited(requests, 3600, 3, 7200)
    timers.run_counted(spark, rows, f"{folder}/rows", f"{folder}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


@query("SELECT user_id, event_type, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id, round(arg_max(value, struct_pack(a := ts, b := event_id)), 2) AS value FROM events GROUP BY ALL")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream of several batches, merged into a stored table that keeps each key's latest row."""
    folder = scratch(spark)
    table(spark, sf_dir, "events").repartition(4).write.parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    rows = stream.select("user_id", "event_type", "event_id", "value", F.struct("ts", "event_id").alias("at"))
    merged = M.MergedTable(spark, f"{folder}/table", ["user_id", "event_type"], "at")
    merged.follow(rows, f"{folder}/checkpoint", None).awaitTermination()
    return merged.read().select("user_id", "event_type", "event_id", F.round("value", 2).alias("value"))


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k"
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section 2.17: sessions of every user, ended by half an hour without an event, by a stream over all events."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    found = written(spark, S.sessions(stream, "user_id"), "complete")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("stop"), "n")


#: Layouts of an event log over time.
EVENT_LAYOUTS = [
    [L.Column("event_id", "int"), L.Column("value", "float")],
    [L.Column("event_id", "int"), L.Column("value", "double"), L.Column("event_type", "string", "'unknown'")],
    [L.Column("event_id", "bigint"), L.Column("value", "double"), L.Column("event_type", "string", "'unknown'"), L.Column("user_id", "bigint", "CAST(event_id % 10 AS BIGINT)")],
]


@query("SELECT event_id, round(CASE event_id % 3 WHEN 0 THEN CAST(CAST(value AS FLOAT) AS DOUBLE) ELSE value END, 2) AS value, CASE event_id % 3 WHEN 0 THEN 'unknown' ELSE event_type END AS event_type, CASE event_id % 3 WHEN 2 THEN user_id ELSE event_id % 10 END AS user_id FROM events WHERE value > 5")
def layout_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stored in three layouts, one after the other, read in the last: columns added with defaults, types widened."""
    e, folder = table(spark, sf_dir, "events"), scratch(spark)
    for i, layout in enumerate(EVENT_LAYOUTS, 1):
        some = e.filter(F.col("event_id") % 3 == i - 1).select(*[F.col(c.name).cast(c.type).alias(c.name) for c in layout])
        L.write_version(some, folder, EVENT_LAYOUTS, i)
    return L.read_versions(spark, folder, EVENT_LAYOUTS).filter("value > 5").withColumn("value", F.round("value", 2))
