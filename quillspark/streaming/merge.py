"""Streaming upserts into a stored table: idempotent by batch, atomic by manifest, throttled by the trigger.

The table is a folder of buckets (a hash of the key); a batch rewrites only the buckets that it touches, each as a new version in a
folder of its own. A manifest, a small JSON file that names the version of every bucket, is put in place by one rename and makes
the batch count. Readers take the last manifest, so a batch that breaks leaves what they see as it was, and a batch that
is delivered again (its manifest is there) changes nothing. A stream has one batch in flight at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quillspark.operators.relational import keyed_latest

#: Buckets of a table, least seconds between two batches (and the default), manifests that are kept.
BUCKETS, LEAST_SECONDS, SECONDS, KEPT = 16, 60, 300, 3


class MergedTable:
    """A table of which each key's latest row stays. order: the column that says which is later; later batches win ties."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], order: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.keys, self.order, self.buckets = spark, folder, keys, order, buckets
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def batches(self) -> list[int]:
        """Batches that count, in order."""
        if not self.fs.exists(self.path("manifest")):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.path("manifest"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_"))

    def manifest(self, batch: int) -> dict:
        stream = self.fs.open(self.path(f"manifest/{batch:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        """The rows of the last batch that counts; None before the first."""
        done = self.batches()
        return self.rows(self.manifest(done[-1])) if done else None

    def rows(self, manifest: dict, buckets: list[str] | None = None) -> DataFrame:
        shape = StructType.fromJson(manifest["schema"])
        stored: dict[str, list[int]] = {}
        for bucket, version in manifest["versions"].items():
            if buckets is None or bucket in buckets:
                stored.setdefault(version, []).append(int(bucket))
        found = self.spark.createDataFrame([], shape)
        for version, some in sorted(stored.items()):  # no more versions than buckets
            files = self.spark.read.schema(StructType([*shape, StructField("_bucket", IntegerType())])).parquet(f"{self.folder}/{version}")
            found = found.unionByName(files.filter(F.col("_bucket").isin(some)).drop("_bucket"))
        return found

    def upsert(self, rows: DataFrame, batch: int) -> bool:
        """Merge a batch; False if it was merged before."""
        done = self.batches()
        if done and batch <= done[-1]:
            return False
        old = self.manifest(done[-1]) if done else {"versions": {}, "schema": rows.schema.jsonValue()}
        placed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        touched = [str(r._bucket) for r in placed.select("_bucket").distinct().collect()]  # at most as many as there are buckets
        merged = keyed_latest(self.rows(old, touched), rows, self.keys, self.order)
        version = f"version-{batch}-{uuid.uuid4().hex}"
        out = merged.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        out.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{version}")
        self.put({"versions": old["versions"] | dict.fromkeys(touched, version), "schema": old["schema"]}, batch)
        self.tidy()
        return True

    def put(self, manifest: dict, batch: int) -> None:
        draft = self.path(f"manifest/_{uuid.uuid4().hex}")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self.fs.rename(draft, self.path(f"manifest/{batch:012d}.json")):
            raise OSError(f"batch {batch} was put in place by somebody else")

    def tidy(self) -> None:
        """Drop manifests but the last few, and versions that none of these names."""
        done = self.batches()
        for batch in done[:-KEPT]:
            self.fs.delete(self.path(f"manifest/{batch:012d}.json"), False)
        named = {v for batch in done[-KEPT:] for v in self.manifest(batch)["versions"].values()}
        for folder in self.fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)):
            name = folder.getPath().getName()
            if name.startswith("version-") and name not in named:
                self.fs.delete(folder.getPath(), True)

    def follow(self, stream: DataFrame, checkpoint: str, seconds: int | None = SECONDS):
        """Merge a stream, a batch every so many seconds but no more often than every LEAST_SECONDS; None: what is there, then end."""
        writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: self.upsert(rows, batch) and None)
        writer = writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{max(LEAST_SECONDS, seconds)} seconds")
        return writer.start()
