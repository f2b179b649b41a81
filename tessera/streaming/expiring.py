"""First-seen keys that are forgotten: keyed state with timers, for streams whose keys never end.

A key's rows that are less than ``gap`` apart form a run. A run's first row is what "first seen" means after the key had
been forgotten; the run is given out once the watermark has passed its last row by ``gap``, and its state goes with it. So
state holds open runs only, however many keys there were. Runs are merged as rows come, in any order: the result does not
depend on batches, and a key with a third of the rows costs its open runs, one Arrow batch of its rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_RUN = "low long, high long, n long"


class _Runs(StatefulProcessor):
    def __init__(self, gap: int):
        self.gap = gap  # microseconds

    def init(self, handle) -> None:
        self.handle, self.open = handle, handle.getListState("runs", _RUN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        runs = [tuple(map(int, r)) for r in self.open.get()] if self.open.exists() else []
        before = min((self._due(r[1]) for r in runs), default=None)
        for part in rows:
            at = np.sort(part.iloc[:, -1].to_numpy())  # the rows' columns may come without their names
            cuts = np.flatnonzero(np.diff(at) >= self.gap)
            starts, ends = np.append(0, cuts + 1), np.append(cuts, len(at) - 1)
            runs += zip(at[starts].tolist(), at[ends].tolist(), (ends - starts + 1).tolist(), strict=True)
            runs = self._merged(runs)
        self.open.put(runs)
        # A key has a timer at or before the time its earliest run is due; one that comes too early finds nothing to close.
        due = min(self._due(r[1]) for r in runs)
        if before is None or due < before:
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        runs = [tuple(map(int, r)) for r in self.open.get()] if self.open.exists() else []
        done, going = [r for r in runs if self._due(r[1]) <= now], [r for r in runs if self._due(r[1]) > now]
        if going:
            if done:
                self.open.put(going)
            self.handle.registerTimer(min(self._due(r[1]) for r in going))
        elif runs:
            self.open.clear()
        if done:
            yield pd.DataFrame({"key": [key[0]] * len(done), "first": [r[0] for r in done], "last": [r[1] for r in done], "n": [r[2] for r in done]})

    def close(self) -> None:
        pass

    def _due(self, high: int) -> int:
        return -(-(high + self.gap) // 1000)

    def _merged(self, runs: list) -> list:
        out: list = []
        for low, high, n in sorted(runs):
            if out and low - out[-1][1] < self.gap:
                before = out.pop()
                low, high, n = before[0], max(high, before[1]), n + before[2]
            out.append((low, high, n))
        return out


def first_seen_again(rows: DataFrame, key: str, event_time: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """A row per closed run of a key: (key, first, last, n). Rows later than ``late`` are dropped, null keys are a key.

    Rows without a time have no part. State is kept in RocksDB, outside the heap; the session's provider is set for it.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    micros = spark.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {gap}) AS n").first().n
    timed = rows.where(F.col(event_time).isNotNull()).select(F.col(key).alias("key"), F.col(event_time).cast("timestamp").alias("at"))
    marked = timed.withWatermark("at", late).withColumn("_micros", F.unix_micros("at"))
    kind = marked.schema["key"].dataType.simpleString()
    runs = marked.groupBy("key").transformWithStateInPandas(_Runs(micros), f"key {kind}, first long, last long, n long", "Append", "EventTime")
    return runs.select("key", F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"), "n")
