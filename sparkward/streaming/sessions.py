"""Sessions over streams: a line for each one that ends, by a timer in the time of events."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schema import NO_SESSION
from .router import with_store

ENDED = "session_id string, started_at bigint, ended_at bigint, tool_call_count bigint, line string"


class Ends(StatefulProcessor):
    """Emits a session once `idle` ms have passed since its last call. State: when it began, its last call, and how many."""

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "started long, last long, n long")

    def ended(self, key, life: tuple) -> Row:
        started, last, n = life
        return Row(session_id=key[0], started_at=started, ended_at=last, tool_call_count=n, line=f"calls: {n}, duration: {(last - started) // 1000}s")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        life = tuple(self.life.get()) if self.life.exists() else None
        if life:
            self.handle.deleteTimer(life[1] + self.idle)
        for ts in sorted(r.ts_ms for r in rows):
            if life and ts - life[1] > self.idle:
                yield self.ended(key, life)
                life = None
            started, last, n = life or (ts, ts, 0)
            life = (min(started, ts), max(last, ts), n + 1)
        self.life.update(life)
        self.handle.registerTimer(life[1] + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        life = tuple(self.life.get()) if self.life.exists() else None
        if life and life[1] + self.idle <= expiredTimerInfo.getExpiryTimeInMs():
            self.life.clear()
            yield self.ended(key, life)

    def close(self) -> None:
        pass


def ended(calls: DataFrame, idle: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """session_id, started_at, ended_at, tool_call_count, line of sessions that an idle hour has ended; calls may come so late."""
    with_store(calls.sparkSession)
    timed = calls.select(F.coalesce("session_id", F.lit(NO_SESSION)).alias("session_id"), "ts_ms", F.timestamp_millis("ts_ms").alias("ts"))
    return timed.withWatermark("ts", late).groupBy("session_id").transformWithState(Ends(idle), ENDED, "append", "eventTime")
