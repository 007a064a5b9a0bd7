"""Streaming forms of the event aggregates, and an exact sliding rate limiter."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.session import shipped


def daily_counts(events: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """day, event_type, n, total; rows later than the watermark are dropped."""
    windowed = events.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), "event_type")
    return windowed.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.to_date("window.start").alias("day"), "event_type", "n", "total")


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def admitted(at: np.ndarray, ids: np.ndarray, passed: deque, seconds: int, most: int) -> Iterator[tuple[np.ndarray, list[bool]]]:
    """Ids in order of time, in blocks, and whether each request passes; passed, the times within the window, is kept up."""
    order = np.lexsort((ids, at))
    for some in np.array_split(order, max(1, len(order) // 10_000)):
        allowed = []
        for now in at[some].tolist():
            while passed and now - passed[0] >= seconds:
                passed.popleft()
            allowed.append(len(passed) < most)
            if allowed[-1]:
                passed.append(now)
        yield ids[some], allowed


def limiter(seconds: int, most: int, forget: bool):
    """State function: requests in order of time; a request passes if fewer than most passed in the seconds before it.
    Refused requests are not remembered. The state, the passed times of the window, is bounded by most. Of a key's requests
    in one micro-batch (whose size the source bounds, see maxFilesPerTrigger) only time and id are held, 16 bytes each."""

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        passed = deque(sorted(state.get[0]) if state.exists else [])
        held = [(b["at"].to_numpy(), b["id"].to_numpy()) for b in batches]
        at, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        for some, allowed in admitted(at, ids, passed, seconds, most):
            yield pd.DataFrame({"key": key[0], "id": some, "allowed": allowed})
        state.update((list(passed),))
        if forget:
            state.setTimeoutDuration(2_000 * seconds)

    return judge


def rate_limited(requests: DataFrame, seconds: int = 60, most: int = 60, forget: bool = True) -> DataFrame:
    """key, id, allowed of a stream of requests (key, id, at in seconds). With forget, idle keys leave the state; a run over
    what is there (availableNow) needs forget=False, as pending timeouts would keep it going."""
    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout
    return requests.groupBy("key").applyInPandasWithState(shipped(limiter(seconds, most, forget)), "key long, id long, allowed boolean", "passed array<double>", "append", timeout)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and end. The file sink only appends: where results are kept whole (complete), every
    micro-batch replaces the files of the last one."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path))
    writer.start().awaitTermination()
