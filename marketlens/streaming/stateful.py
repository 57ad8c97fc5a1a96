"""State by key over streams: newest values that expire, and running totals that correct themselves.

Both give the same rows whatever the batches are, as long as rows come no later than the watermark allows.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marketlens.options import SECOND

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def state_on_disk(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB, which timers and typed state need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


#: What timed_values gives.
CHANGES = "key string, at timestamp, payload string, action string"


class _TimedValue(StatefulProcessor):
    """A key's newest event and a timer for the end of its life."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "us long, payload string")

    def _rows(self, key, changes: list[tuple[int, str, str]]) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]] * len(changes), "at": pd.to_datetime([us for us, _, _ in changes], unit="us"), "payload": [p for _, p, _ in changes], "action": [a for _, _, a in changes]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.newest.get() if self.newest.exists() else None
        before = known and tuple(known)
        now, changes = before, []
        for event in sorted((int(us), p) for f in rows for us, p in zip(f["us"], f["payload"], strict=True)):
            if now and event[0] - now[0] >= self.ttl:
                changes.append((now[0] + self.ttl, now[1], "expire"))
                now = None
            if now is None or event > now:
                changes.append((*event, "set"))
                now = event
        if now != before:
            if before:
                self.handle.deleteTimer(self._end(before))
            self.newest.update(now)
            self.handle.registerTimer(self._end(now))
        if changes:
            yield self._rows(key, changes)

    def _end(self, event: tuple) -> int:
        """The millisecond in which the event's life is over."""
        return -(-(event[0] + self.ttl) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.newest.exists():
            us, payload = self.newest.get()
            self.newest.clear()
            yield self._rows(key, [(us + self.ttl, payload, "expire")])

    def close(self) -> None:
        pass


def timed_values(events: DataFrame, ttl_seconds: int = 600, ts_col: str = "snapshot_time", late: str = "10 minutes") -> DataFrame:
    """Changes of the newest event of each key (its other columns as JSON): ``set`` when a newer one comes, ``expire`` when
    its time is over, be it that the watermark passed it or that the key's next event came after it.

    The state is one event a key and goes with it. Start the query inside ``state_on_disk``, in append mode. A null key is
    a key of its own; of events of one time the greater payload is the newer; events after the watermark are dropped.
    """
    rest = [c for c in events.columns if c not in ("key", ts_col)]
    e = events.withWatermark(ts_col, late).select("key", ts_col, F.unix_micros(F.col(ts_col).cast("timestamp")).alias("us"), F.to_json(F.struct(*rest)).alias("payload"))
    return e.groupBy("key").transformWithStateInPandas(_TimedValue(ttl_seconds), CHANGES, "Append", "EventTime")


#: What corrected_delta gives.
CORRECTIONS = "symbol_id long, exchange string, period string, snapshot_time timestamp, cvd_value double, cvd_change double, revision long"


def corrected_delta(flows: DataFrame, late: str = "1 hour", period_col: str = "period") -> DataFrame:
    """Cumulative taker delta per (symbol, venue, period) that a late flow corrects: with it come the totals of all later
    flows anew, with a higher ``revision``. The newest revision of each time is what a batch run over all rows gives.

    The state is the total before the watermark and the flows after it, in order of time, so it is bounded by ``late``.
    """
    f = flows.withWatermark("snapshot_time", late).select("symbol_id", "exchange", F.col(period_col).alias("period"), "snapshot_time", F.unix_micros("snapshot_time").alias("us"), F.coalesce("buy_sell_delta_quote", "buy_sell_delta").alias("change")).where("change is not null")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        base, times, changes, revision = state.get if state.exists else (0.0, [], [], 0)
        new = pd.concat(list(frames))
        us = np.concatenate([np.asarray(times, np.int64), new["us"].to_numpy(np.int64)])
        change = np.concatenate([np.asarray(changes, float), new["change"].to_numpy(float)])
        order = np.lexsort((change, us))
        us, change = us[order], change[order]
        total = base + np.cumsum(change)
        first = int(np.searchsorted(us, new["us"].min()))
        yield pd.DataFrame({"symbol_id": key[0], "exchange": key[1], "period": key[2], "snapshot_time": pd.to_datetime(us[first:], unit="us"), "cvd_value": total[first:], "cvd_change": change[first:], "revision": revision + 1})
        done = int(np.searchsorted(us, state.getCurrentWatermarkMs() * 1000))
        state.update((float(total[done - 1]) if done else base, us[done:].tolist(), change[done:].tolist(), revision + 1))

    return f.groupBy("symbol_id", "exchange", "period").applyInPandasWithState(step, CORRECTIONS, "base double, times array<long>, changes array<double>, revision long", "append", GroupStateTimeout.NoTimeout)


def newest_revisions(corrections: DataFrame) -> DataFrame:
    """The rows of corrected_delta that hold, by key and time."""
    on = ["symbol_id", "exchange", "period", "snapshot_time"]
    return corrections.groupBy(*on).agg(F.max_by(F.struct("cvd_value", "cvd_change"), "revision").alias("v")).select(*on, "v.*")
