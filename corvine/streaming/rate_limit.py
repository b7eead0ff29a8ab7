"""Sliding-log rate limiting: a call passes if fewer than ``calls`` passed in the ``window`` seconds before it.

Refused calls leave no trace, so this is no range-window count. The state of a key is at most ``calls`` times. In a batch,
calls are sorted within their key's partition and read as a stream, so a key with very many calls needs no more memory
than another; over a stream the same step runs in keyed state.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.config import DEFAULTS


class Log:
    """The times of the calls of one key that passed, in microseconds."""

    def __init__(self, window: int, calls: int, times=()):
        self.window, self.calls, self.times = window * 1_000_000, calls, deque(times)

    def admit(self, now: int) -> bool:
        while self.times and now - self.times[0] > self.window:
            self.times.popleft()
        if len(self.times) >= self.calls:
            return False
        self.times.append(now)
        return True


def limited(calls: DataFrame, window: int = DEFAULTS.RATE_WINDOW_S, most: int = DEFAULTS.RATE_MAX_CALLS) -> DataFrame:
    """(key, at timestamp, id) -> (id, admitted); equal times go by id, calls without key or time are refused."""
    rows = calls.select("key", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "id")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        key, log = None, Log(window, most)
        for batch in batches:
            admitted = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    key, log = k, Log(window, most)
                admitted.append(k is not None and t is not None and log.admit(t))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(admitted, pa.bool_())], names=["id", "admitted"])

    return rows.repartition("key").sortWithinPartitions("key", "at", "id").mapInArrow(run, f"id {kind}, admitted boolean")


def limited_stream(calls: DataFrame, window: int = DEFAULTS.RATE_WINDOW_S, most: int = DEFAULTS.RATE_MAX_CALLS, late: str = "1 hour") -> DataFrame:
    """The same over a stream of (key long, at timestamp, id long).

    The state of a key goes when the watermark passes the last call that it holds by more than the window; calls that are
    later than ``late`` may be left out, as with every watermark. A key's calls of one micro-batch are sorted together (two
    numbers a call), so the trigger's limits bound them.
    """
    import numpy as np
    import pandas as pd

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        found = [(f["micros"].to_numpy(), f["id"].to_numpy()) for f in frames]
        times, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ids, times))
        log = Log(window, most, state.get[0] if state.exists else ())
        admitted = [log.admit(t) for t in times[order].tolist()]
        state.update((list(log.times),))
        over = (log.times[-1] + log.window) // 1000 + 1
        state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": ids[order], "admitted": admitted})

    rows = calls.withWatermark("at", late).select("key", "at", F.unix_micros("at").alias("micros"), "id")
    return rows.groupBy("key").applyInPandasWithState(step, "id long, admitted boolean", "times array<long>", "append", "EventTimeTimeout")


def limited_keys(calls: DataFrame, window: int = DEFAULTS.RATE_WINDOW_S, most: int = DEFAULTS.RATE_MAX_CALLS, late: str = "1 hour") -> DataFrame:
    """``limited_stream`` with a list of times and a timer as state of each key, over a RocksDB state store.

    The list has at most ``most`` times, so a key's state is small whatever its number of calls; only what changes is written.
    A timer stands a window behind the last time that the list has; when the watermark passes it, the state is removed.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Limiter(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle, self.times = handle, handle.getListState("times", "at long")

        def handleInputRows(self, key, rows, timerValues):
            found = [(f["micros"].to_numpy(), f["id"].to_numpy()) for f in rows]
            times, ids = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((ids, times))
            log = Log(window, most, [x[0] for x in self.times.get()])
            admitted = [log.admit(t) for t in times[order].tolist()]
            self.times.put([(t,) for t in log.times])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            over = (log.times[-1] + log.window) // 1000 + 1
            self.handle.registerTimer(max(over, timerValues.getCurrentWatermarkInMs() + 1))
            yield pd.DataFrame({"id": ids[order], "admitted": admitted})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.times.clear()
            yield pd.DataFrame({"id": np.zeros(0, np.int64), "admitted": np.zeros(0, bool)})

        def close(self) -> None:
            pass

    calls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = calls.withWatermark("at", late).select("key", "at", F.unix_micros("at").alias("micros"), "id")
    return rows.groupBy("key").transformWithStateInPandas(Limiter(), "id long, admitted boolean", "Append", "EventTime")
