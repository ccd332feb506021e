"""Retraining trigger with per-user state and event-time timers (STRM-4, WIN-5).

Per user the state holds the number of examples since the last fire, the time of that fire,
and the number of fires.  A user fires

* ``feedback_threshold`` when the ``every``-th example since the last fire arrives, at its time;
* ``periodic`` when there are examples since the last fire and the model is ``max_age`` old: at
  that very time if examples were already there, else at the next example's time.

The clock of a user without a fire starts with the first example.  A fire resets the count.
The periodic fire is an event-time timer, so it comes as soon as the watermark passes, with
no further example; an example that comes first finds the same fire, at the same time.

State and timers live in the RocksDB state store.  Examples are taken however late: the column
with the watermark does not reach the operator, so nothing is dropped there; a late example counts
from its arrival, and a fire's time is never before the user's latest example.  A micro-batch's examples
of one user are sorted by (time, id), as arrays of two numbers; how many there can be is set by the
source's files a trigger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import types as T

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

DAY_US = 24 * 3600 * 1_000_000
STATE = "n long, last long, latest long, fires long"


class RetrainTrigger(StatefulProcessor):
    """One user's examples in, the user's fires out."""

    def __init__(self, user: str, user_type: T.DataType, every: int, max_age_us: int):
        self.user, self.every, self.max_age = user, every, max_age_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("trigger", STATE)

    def _fires(self, key, found: list[tuple[int, int, str]]) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame({self.user: [key[0]] * len(found), "fire": [f for f, _, _ in found],
                                "fired_us": [t for _, t, _ in found], "reason": [r for _, _, r in found]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [r[["t", "event_id"]].to_numpy(np.int64) for r in rows]
        times = np.concatenate(parts)
        times = times[np.lexsort((times[:, 1], times[:, 0])), 0].tolist()
        n, last, latest, fires = self.state.get() if self.state.exists() else (0, times[0], times[0], 0)
        due = self._due(n, last)  # the timer that is set, if any
        found = []
        for t in times:
            t = latest = max(t, latest)
            if n and t >= last + self.max_age:  # the timer would have come before this example
                fires, n, last = fires + 1, 0, last + self.max_age
                found.append((fires, last, "periodic"))
            n += 1
            if n >= self.every or t >= last + self.max_age:
                fires += 1
                found.append((fires, t, "feedback_threshold" if n >= self.every else "periodic"))
                n, last = 0, t
        self.state.update((n, last, latest, fires))
        now = self._due(n, last)
        if due != now:
            if due is not None:
                self.handle.deleteTimer(due)
            if now is not None:
                self.handle.registerTimer(now)
        yield from self._fires(key, found)

    def _due(self, n: int, last: int) -> int | None:
        """Millisecond at which the timer comes: not before the age is reached."""
        return -(-(last + self.max_age) // 1000) if n else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, last, latest, fires = self.state.get()
        if n and self._due(n, last) == expiredTimerInfo.getExpiryTimeInMs():
            fires, last = fires + 1, last + self.max_age
            self.state.update((0, last, max(latest, last), fires))
            yield from self._fires(key, [(fires, last, "periodic")])

    def close(self) -> None:
        pass


def retrain_fires(rows: DataFrame, every: int = 10, max_age_us: int = DAY_US, user: str = "user_id", ts: str = "created_at",
                  key: str = "event_id", watermark: str = "1 hour") -> DataFrame:
    """Stream of fires ``(user, fire, fired_at, reason)`` of a stream of training examples, each seen once."""
    rows.sparkSession.conf.set(STATE_STORE, ROCKSDB)  # timers need it
    kind = rows.schema[user].dataType
    # only numbers reach the operator: without the watermark's column late examples stay in
    x = rows.withWatermark(ts, watermark).select(user, F.unix_micros(F.col(ts)).alias("t"), F.col(key).cast("long").alias("event_id"))
    out = T.StructType([T.StructField(user, kind), T.StructField("fire", T.LongType()), T.StructField("fired_us", T.LongType()),
                        T.StructField("reason", T.StringType())])
    fired = x.groupBy(user).transformWithStateInPandas(RetrainTrigger(user, kind, every, max_age_us), out, "Append", "EventTime")
    return fired.select(user, "fire", F.timestamp_micros("fired_us").alias("fired_at"), "reason")
