"""Freshness of counters as streaming state: a counter turns stale and offline by timers, without a row of its own.

A counter's state is the newest time that it was read. Timers in event time stand at that time plus the ages at which it turns stale and offline; a newer reading moves them. When
the watermark, which all counters drive together, passes a timer, the counter's new state is given out. An offline counter keeps no state and starts again with its next reading.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plinth.operators.counters import FRESH_HOURS, STALE_HOURS

_HOUR = 3_600_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rows(key, seen: int, at: int, state: str) -> pd.DataFrame:
    times = pd.to_datetime([seen, at], unit="ms", utc=True)
    return pd.DataFrame({"key": [key], "seen": [times[0]], "at": [times[1]], "state": [state]})


class Freshness(StatefulProcessor):
    """Rows (key, ms) to (key, seen, at, state): ``fresh`` at a newer reading, ``stale`` and ``offline`` when the watermark passes their ages."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, stage int")

    def _move(self, old: int | None, new: int) -> None:
        for hours in (FRESH_HOURS, STALE_HOURS):
            if old is not None:
                self.handle.deleteTimer(old + hours * _HOUR + 1)
            # an age of exactly so many hours is still within
            self.handle.registerTimer(new + hours * _HOUR + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.last.get()[0] if self.last.exists() else None
        new = max(int(r["ms"].max()) for r in rows)
        if old is None or new > old:
            self._move(old, new)
            self.last.update((new, 0))
            yield _rows(key[0], new, new, "fresh")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, (seen, stage) = expiredTimerInfo.getExpiryTimeInMs(), self.last.get()
        offline = at > seen + STALE_HOURS * _HOUR
        # of two timers that one watermark passes, either can come first
        if offline:
            self.last.clear()
        elif stage == 0:
            self.last.update((seen, 1))
        if offline or stage == 0:
            yield _rows(key[0], seen, at, "offline" if offline else "stale")

    def close(self) -> None:
        pass


def freshness(stream: DataFrame, key: str, time: str, late: str = "30 minutes") -> DataFrame:
    """(key, seen, at, state): every change of a key's state, in update mode. Needs the RocksDB state store (``PROVIDER``)."""
    kind = stream.schema[key].dataType.simpleString()
    marked = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late).select(F.col(key).alias("key"), F.unix_millis(time).alias("ms"), time)
    return marked.groupBy("key").transformWithStateInPandas(Freshness(), f"key {kind}, seen timestamp, at timestamp, state string", "Update", "EventTime")
