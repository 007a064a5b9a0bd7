"""Stored tables: append, snapshot, restore, partition replacement, export."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, lengths and times of the files under a path: another one once any of them changes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True), []
    while found.hasNext():
        f = found.next()
        files.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return sha256("\n".join(sorted(files)).encode()).hexdigest()


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


#: Most characters of an event's name and view.
EVENT_NAME, EVENT_VIEW = 200, 100


def append_events(events: DataFrame, path: str) -> None:
    append(events.withColumns({"event": F.substring("event", 1, EVENT_NAME), "view": F.substring("view", 1, EVENT_VIEW)}), path)


def with_ids(df: DataFrame, name: str = "id") -> DataFrame:
    """A random id (version 4) a row, for logs that are appended once; a retried task draws others, so write before use."""
    return df.select(F.uuid().alias(name), "*")


def lists_as_json(df: DataFrame) -> DataFrame:
    """Array columns as JSON text."""
    return df.withColumns({f.name: F.to_json(f.name) for f in df.schema if f.dataType.typeName() == "array"})


def append_run(rows: DataFrame, run: DataFrame, folder: str, run_id: str) -> None:
    """Rows first, the run's own row last: what finished_rows shows is whole, whenever the writer stops."""
    append(rows.withColumn("run_id", F.lit(run_id)), f"{folder}/rows")
    append(run, f"{folder}/runs")


def finished_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of runs whose own row is there."""
    return spark.read.parquet(f"{folder}/rows").join(spark.read.parquet(f"{folder}/runs").select("run_id").distinct(), "run_id", "left_semi")


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Write the partitions that df brings, whole; others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def restore(spark: SparkSession, folder: str, name: str, current: DataFrame | None = None) -> DataFrame:
    """The current rows, or the snapshot's if there are none."""
    if current is not None and not current.isEmpty():
        return current
    return spark.read.parquet(f"{folder}/{name}")


def listed(spark: SparkSession) -> DataFrame:
    """name, temporary of the catalogue's tables and views."""
    return spark.createDataFrame([(t.name, t.isTemporary) for t in spark.catalog.listTables()], "name string, temporary boolean")


def export(df: DataFrame, folder: str) -> None:
    """As JSON and as CSV with a header."""
    df.write.mode("overwrite").json(f"{folder}/json")
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")


def mixed_sizes(df: DataFrame, vector: str) -> bool:
    """Whether the vectors differ in size."""
    return df.filter(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).distinct().count() > 1


def reset_if_mixed(df: DataFrame, vector: str, expected: int, keep_rows: bool = False) -> DataFrame:
    """The rows if all vectors have the expected size; else none, or all with their vectors nulled."""
    if df.filter(F.col(vector).isNotNull() & (F.size(vector) != expected)).isEmpty():
        return df
    return df.withColumn(vector, F.lit(None).cast(df.schema[vector].dataType)) if keep_rows else df.limit(0)


def to_embed(df: DataFrame, vector: str, size: int) -> DataFrame:
    """Rows whose vector is missing or of another size."""
    return df.filter(F.col(vector).isNull() | (F.size(vector) != size))


def complete_only(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Rows of keys none of whose vectors is missing."""
    whole = df.groupBy(*keys).agg(F.min(F.col(vector).isNotNull()).alias("_whole")).filter("_whole")
    return df.join(whole, keys, "left_semi")
