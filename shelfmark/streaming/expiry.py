"""Runs that time out while their ledger streams in: the expiry of stale runs as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ledger import STALE_ERROR

#: Times are milliseconds in here, so no session's time zone matters.
FINISHED = "id long, topic_id long, status string, started long, completed long, error string"


class Expiry(StatefulProcessor):
    """Holds each run that started and hasn't finished. A finish lets it go; a timer that runs out first
    fails it. The state of a run is two values, and is gone when the run is."""

    def __init__(self, after: timedelta = timedelta(minutes=30)):
        self.after = after // timedelta(milliseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "topic_id long, started long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("ms", kind="stable")
        for e in events.itertuples():
            started = int(self.run.get()[1]) if self.run.exists() else None
            if e.status == "running":
                if started is None:
                    self.run.update((int(e.topic_id), int(e.ms)))
                    # failed when the clock is past the time, not on it
                    self.handle.registerTimer(int(e.ms) + self.after + 1)
                continue
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.run.clear()
            yield self._row(key[0], int(e.topic_id), e.status, e.ms if started is None else started, e.ms, "")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.run.exists():
            topic, started = self.run.get()
            self.run.clear()
            yield self._row(key[0], topic, "failed", started, expiredTimerInfo.getExpiryTimeInMs(), STALE_ERROR)

    @staticmethod
    def _row(id: int, topic: int, status: str, started: int, completed: int, error: str) -> pd.DataFrame:
        return pd.DataFrame({"id": [id], "topic_id": [topic], "status": [status], "started": [int(started)], "completed": [int(completed)], "error": [error]})

    def close(self) -> None:
        pass


def finished_runs(events: DataFrame, after: timedelta = timedelta(minutes=30), late: str = "0 seconds") -> DataFrame:
    """The runs of a stream of events (id, topic_id, status, at) as they finish: with the status that was
    told, or failed when `after` has passed since the start without one. Time is that of the events: a run
    expires when the watermark, which lags by `late`, has gone past it. The session needs the RocksDB state
    store. A finish that comes after its run expired is a run of its own whose start isn't known."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = events.select("id", "topic_id", "status", F.col("at").cast("timestamp").alias("at")).withColumn("ms", F.unix_millis("at")).withWatermark("at", late)
    done = timed.groupBy("id").transformWithStateInPandas(Expiry(after), FINISHED, "Append", "EventTime")
    return done.select("id", "topic_id", "status", F.timestamp_millis("started").alias("started_at"), F.timestamp_millis("completed").alias("completed_at"), "error")
