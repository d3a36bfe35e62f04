"""A resumable queue of scoring work as a stream: what is pending, done or timed out, with late and repeated events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = "key string, state string, worker string, score double, attempts int, at timestamp"
_STATE = "state string, worker string, score double, attempts int, at timestamp"


class Work(StatefulProcessor):
    """One key: seeded once, taken by a worker, done with its first score; taken work that stays undone is pending again.

    An event is ``seed``, ``take`` or ``done``; events of a batch are taken in the order of their time.
    Every change of state gives a row. A key that is done stays done: its state is a few bytes and goes
    ``keep_ms`` of event time after its last event.
    """

    def __init__(self, timeout_ms: int, keep_ms: int):
        self.timeout_ms, self.keep_ms = timeout_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.work = handle.getValueState("work", _STATE)

    def _timer(self, millis: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(millis)

    def _put(self, key: str, state: str, worker: str | None, score: float | None, attempts: int, at: pd.Timestamp) -> dict:
        self.work.update((state, worker, score, attempts, at.to_pydatetime()))
        millis = int(at.timestamp() * 1000)
        self._timer(millis + (self.timeout_ms if state == "taken" else self.keep_ms))
        return {"key": key, "state": state, "worker": worker, "score": score, "attempts": attempts, "at": at}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "event", "worker"])
        held = self.work.get() if self.work.exists() else None
        state, worker, score, attempts, since = held if held else (None, None, None, 0, None)
        timeout, out = pd.Timedelta(self.timeout_ms, "ms"), []
        for e in events.itertuples():
            if state == "taken" and e.at >= pd.Timestamp(since) + timeout:
                # the event tells that the time is over before the watermark does
                since = pd.Timestamp(since) + timeout
                out.append(self._put(key[0], "pending", None, None, attempts, since) | {"worker": worker, "state": "timed out"})
                state = "pending"
            if state is None or (state == "pending" and e.event in ("take", "done")) or (state == "taken" and e.event == "done"):
                state = {"seed": "pending", "take": "taken", "done": "done"}[e.event]
                worker = e.worker if state != "pending" else None
                score = float(e.score) if state == "done" and pd.notna(e.score) else None
                attempts, since = attempts + (state == "taken"), e.at
                out.append(self._put(key[0], state, worker, score, attempts, e.at))
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        state, worker, _, attempts, _ = self.work.get()
        if state == "taken":
            at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
            yield pd.DataFrame([self._put(key[0], "pending", None, None, attempts, at) | {"worker": worker, "state": "timed out"}])
        elif state == "done":
            self.work.clear()
        else:
            self._timer(expiredTimerInfo.getExpiryTimeInMs() + self.keep_ms)

    def close(self) -> None:
        pass


def queue(events: DataFrame, late: str = "10 minutes", timeout_ms: int = 3_600_000, keep_ms: int = 86_400_000) -> DataFrame:
    """Changes of state of each ``key`` of a stream of ``event_id``, ``key``, ``event``, ``worker``, ``score`` and ``at``.

    Events that come twice within the watermark count once; those later than it are left out. The stream's
    query needs the RocksDB state store and append mode; it goes on from its checkpoint after a stop.
    """
    rows = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    made = rows.select("key", "event", F.coalesce("worker", F.lit("")).alias("worker"), F.col("score").cast("double").alias("score"), "at")
    return made.groupBy("key").transformWithStateInPandas(statefulProcessor=Work(timeout_ms, keep_ms), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")
