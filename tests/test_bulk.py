"""Bulk copies into a database."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from quillspark.sources import bulk

SF = "/root/testdata/sf0.001"


@pytest.fixture
def base(tmp_path, spark):
    bulk.register(spark)
    path = f"{tmp_path}/base.db"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE chunks (id bigint PRIMARY KEY, name text, balance double precision, parts text)")
    return path


def read(path, sql="SELECT * FROM chunks ORDER BY id"):
    with sqlite3.connect(path) as db:
        return db.execute(sql).fetchall()


def copy(df, path, **options):
    df.write.format("bulk_copy").options(target=path, table="chunks", **options).mode("append").save()


def test_only_what_is_missing_is_inserted(spark, base):
    c = spark.read.parquet(f"{SF}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.split("c_name", "#").alias("parts"))
    copy(c.filter("id % 3 = 0").withColumn("name", F.lit("old")), base)
    copy(c.repartition(5), base, batch=7)
    copy(c.repartition(3), base)
    want = [(r.id, "old" if r.id % 3 == 0 else r.name, r.balance, f'["{r.parts[0]}", "{r.parts[1]}"]') for r in c.orderBy("id").collect()]
    assert read(base) == want
    assert [n for (n,) in read(base, "SELECT name FROM sqlite_master WHERE type = 'table'")] == ["chunks"]


def test_repeats_nulls_and_empty_tables(spark, base):
    df = spark.createDataFrame([(1, None, None, None), (2, "it's", 1.5, [None]), (2, "it's", 1.5, [None])], "id long, name string, balance double, parts array<string>")
    copy(df.limit(0), base)
    assert read(base) == []
    copy(df, base)
    assert read(base) == [(1, None, None, None), (2, "it's", 1.5, "[null]")]


def test_a_failed_copy_leaves_the_target_as_it_was(spark, base):
    copy(spark.range(3).withColumn("name", F.lit("first")), base)
    broken = spark.range(50, numPartitions=4).withColumn("name", F.when(F.col("id") == 49, F.raise_error("broke off")).otherwise("second"))
    with pytest.raises(Exception, match="broke off"):
        copy(broken, base, batch=2)
    assert [r[:2] for r in read(base)] == [(0, "first"), (1, "first"), (2, "first")]
    assert len(read(base, "SELECT name FROM sqlite_master WHERE type = 'table'")) == 1


def test_attempts_that_do_not_count_are_not_copied(base):
    import pyarrow as pa
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    writer = bulk.BulkWriter({"target": base, "table": "chunks", "batch": "2"}, StructType([StructField("id", LongType()), StructField("name", StringType())]))
    rows = lambda name: iter([pa.RecordBatch.from_pydict({"id": [1, 2, 3], "name": [name] * 3})])
    writer.write(rows("lost"))
    writer.commit([writer.write(rows("kept")), None])
    assert [r[:2] for r in read(base)] == [(1, "kept"), (2, "kept"), (3, "kept")]


@pytest.mark.parametrize("name", ["a;b", 'x" (', "", "a..b"])
def test_names_that_are_refused(name):
    with pytest.raises(ValueError, match="plain name"):
        bulk.quoted(name)


def test_a_copy_never_empties_its_target(spark, base):
    with pytest.raises(Exception, match="append"):
        spark.range(1).write.format("bulk_copy").options(target=base, table="chunks").mode("overwrite").save()
