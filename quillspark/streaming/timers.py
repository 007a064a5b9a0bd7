"""The sliding rate limiter by event time: idle keys leave the state by timers, rows behind the watermark are dropped and counted."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillspark.session import shipped
from quillspark.streaming.events import admitted

#: State with timers needs this store, whose tables lie on the executors' disks.
STORE_KEY, STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Limiter(StatefulProcessor):
    """Per key the times of the requests that passed within the window, at most as many as may pass, and one timer."""

    def __init__(self, seconds: int, most: int, idle: int):
        self.seconds, self.most, self.idle = seconds, most, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.passed = handle.getListState("passed", "at double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        passed = deque(t[0] for t in self.passed.get()) if self.passed.exists() else deque()
        held = [(b["at"].to_numpy(), b["id"].to_numpy()) for b in rows]
        at, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        for some, allowed in admitted(at, ids, passed, self.seconds, self.most):
            yield pd.DataFrame({"key": key[0], "id": some, "allowed": allowed})
        self.passed.put([(t,) for t in passed])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((passed[-1] + self.idle) * 1000) + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.passed.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited(requests: DataFrame, seconds: int = 60, most: int = 60, idle: int = 120, late: str = "60 seconds") -> DataFrame:
    """key, id, allowed of a stream of requests (key long, id long, ts timestamp). A request passes if fewer than most of the key
    passed in the seconds before it; refused ones are not remembered. Once the watermark is idle seconds past the last passed
    request of a key, a timer drops the key's state; idle must be as long as the window or longer, so no result depends on it.
    Requests behind the watermark are dropped (`run_counted` says how many); null keys share one state; requests without a time
    can't be placed and are left out. State is on disk, so there is no bound on the number of keys to evict live ones by."""
    if idle < seconds:
        raise ValueError("keys must be remembered for the whole window")
    timed = requests.filter("ts is not null").withWatermark("ts", late).select("key", "id", "ts", F.unix_micros("ts").alias("_us"))
    placed = timed.withColumn("at", F.col("_us") / 1e6).drop("_us")
    processor = shipped(Limiter(seconds, most, idle))
    return placed.groupBy("key").transformWithStateInPandas(processor, "key long, id long, allowed boolean", "append", "EventTime")


@contextmanager
def state_on_disk(spark: SparkSession):
    """The store that timers need, for queries that start within; the session's own setting is put back."""
    before = spark.conf.get(STORE_KEY, None)
    spark.conf.set(STORE_KEY, STORE)
    try:
        yield
    finally:
        spark.conf.unset(STORE_KEY) if before is None else spark.conf.set(STORE_KEY, before)


class _Counter(StreamingQueryListener):
    """Sums up what each batch of one query reports; a number per batch reaches the driver, no rows."""

    def __init__(self):
        self.dropped: dict[tuple[str, int], int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.dropped[str(p.id), p.batchId] = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))


def run_counted(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, patience: float = 30.0) -> int:
    """Process what is there into Parquet and end; returns how many rows were dropped for being late."""
    import time

    counter = _Counter()
    spark.streams.addListener(counter)
    try:
        with state_on_disk(spark):
            query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()
        until = time.monotonic() + patience
        while str(query.id) not in counter.ended and time.monotonic() < until:  # events arrive on a thread of their own
            time.sleep(0.05)
        if str(query.id) not in counter.ended:
            raise TimeoutError("the stream's last figures did not arrive")
    finally:
        spark.streams.removeListener(counter)
    return sum(n for (who, _), n in counter.dropped.items() if who == str(query.id))
