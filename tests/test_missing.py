"""Companies that a store lacks."""

from pyspark.sql import functions as F

from quillspark.operators import missing


def test_stores_are_filled_once_and_one_failure_stops_no_other(spark, tmp_path):
    folder = f"file://{tmp_path}"
    companies = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "ticker string")
    spark.createDataFrame([("a", 1)], "ticker string, v int").write.parquet(f"{folder}/facts")
    facts = spark.createDataFrame([("a", 9), ("b", 2), ("b", 3), ("z", 4), (None, 5)], "ticker string, v int")
    broken = facts.withColumn("v", F.raise_error("no such file").cast("int"))
    chunks = facts.filter("ticker = 'b'")
    failed = missing.fill_missing(spark, companies, "ticker", {"facts": facts, "broken": broken, "chunks": chunks}, folder)
    assert set(failed) == {"broken"}
    read = lambda name: sorted(tuple(r) for r in spark.read.parquet(f"{folder}/{name}").collect())
    assert read("facts") == [("a", 1), ("b", 2), ("b", 3)] and read("chunks") == [("b", 2), ("b", 3)]
    assert missing.fill_missing(spark, companies, "ticker", {"facts": facts, "chunks": chunks}, folder) == {}
    assert read("facts") == [("a", 1), ("b", 2), ("b", 3)] and read("chunks") == [("b", 2), ("b", 3)]
    before = {"facts": spark.createDataFrame([("a", 1)], "ticker string, v int")}
    got = {r.ticker: (r.facts_state, r.facts_rows, r.chunks_state, r.chunks_rows) for r in missing.coverage(companies, "ticker", before, {n: spark.read.parquet(f"{folder}/{n}") for n in ("facts", "chunks")}).collect()}
    assert got == {"a": ("kept", 1, "none", 0), "b": ("added", 2, "added", 2), "c": ("none", 0, "none", 0)}


def test_empty_lists_and_offers(spark, tmp_path):
    folder, none = f"file://{tmp_path}", spark.createDataFrame([], "ticker string, v int")
    some = spark.createDataFrame([("a", 1)], "ticker string, v int")
    assert missing.fill_missing(spark, none.select("ticker"), "ticker", {"x": some}, folder) == {}
    assert missing.fill_missing(spark, some.select("ticker"), "ticker", {"x": none}, folder) == {}
    assert spark.read.schema("ticker string, v int").parquet(f"{folder}/x").count() == 0
