"""The limiter by event time: replayed results, state that leaves, late rows that are counted."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.streaming import timers


def replay(rows, seconds, most):
    passed, out = {}, {}
    for at, i, key in sorted(rows, key=lambda r: r[:2]):
        kept = [t for t in passed.get(key, []) if at - t < seconds]
        out[i] = len(kept) < most
        passed[key] = kept + [at] * out[i]
    return out


def streamed(spark, folder, name):
    source = spark.readStream.schema("key long, id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    dropped = timers.run_counted(spark, timers.limited(source, 10, 3, 20, "30 seconds"), f"{folder}/out", f"{folder}/check")
    return dropped, {r.id: r.allowed for r in spark.read.parquet(f"{folder}/out").collect()}


def put(spark, folder, rows):
    df = spark.createDataFrame(rows, "at double, id long, key long")
    df.select("key", "id", F.timestamp_micros((F.col("at") * 1e6).cast("long")).alias("ts")).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_batches_equal_a_replay_and_late_rows_are_counted(spark, tmp_path):
    rng, now, rows = random.Random(7), 1000.0, []
    for i in range(300):
        now += rng.choice([0, 0.5, 3])
        rows.append((now, i, rng.choice([1, 2, None])))
    folder = f"file://{tmp_path}"
    put(spark, folder, rows[:150])
    dropped, got = streamed(spark, folder, "a")
    assert dropped == 0 and got == replay(rows[:150], 10, 3)
    put(spark, folder, rows[150:])
    dropped, got = streamed(spark, folder, "a")
    assert dropped == 0 and got == replay(rows, 10, 3)
    put(spark, folder, [(500.0, 1000, 1), (501.0, 1001, 2), (now + 100, 1002, 1)])
    dropped, got = streamed(spark, folder, "a")
    assert dropped == 2 and got.keys() == {*range(300), 1002} and got[1002]


def test_idle_keys_leave_the_state(spark, tmp_path):
    folder = f"file://{tmp_path}"
    put(spark, folder, [(1000.0, 1, 1), (1001.0, 2, 2), (5000.0, 3, 3)])
    dropped, got = streamed(spark, folder, "a")
    assert dropped == 0 and got == {1: True, 2: True, 3: True}
    put(spark, folder, [(5001.0, 4, 3)])
    dropped, got = streamed(spark, folder, "a")
    assert dropped == 0 and len(got) == 4
    with timers.state_on_disk(spark):
        kept = spark.read.format("statestore").option("stateVarName", "passed").option("flattenCollectionTypes", True).load(f"{folder}/check").select("key.key").collect()
    assert {r.key for r in kept} == {3}


def test_memory_must_cover_the_window(spark):
    with pytest.raises(ValueError, match="whole window"):
        timers.limited(spark.createDataFrame([], "key long, id long, ts timestamp"), 60, 60, 30)
