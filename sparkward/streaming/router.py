"""The router over streams: escalation, dismissals as they are at each batch, and deduplication, one after another.

Each stateful step takes a batch's rows of a key at once, and keeps state for an hour: when a rule's and tool's
events came, and when an alert was sent last. Rows of a batch are taken in order of arrival, so what comes out is
what routing.routed() gives for rows in order, whatever the batches and however often the query starts again. What a
batch brings for one key is sorted in one task: bound batches by the source (files, bytes) rather than by time.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, NumericType, StructType

from ..operators.routing import undismissed
from ..operators.stateful import DEDUP_KEYS
from ..schema import SEVERITIES
from .state import expired

#: How long state lives without being written, in milliseconds of the machine's time: longer than all windows.
LIVES = 3_600_000
#: Into how many parts of its span the state of an escalation is cut.
PARTS = 16
#: Groups of keys that deduplication steps through at once; a checkpoint holds to it.
BUCKETS = 1024
RAISED = dict(zip(SEVERITIES, (*SEVERITIES[1:], SEVERITIES[-1])))
STORE = "spark.sql.streaming.stateStore.providerClass"


def with_store(spark: SparkSession) -> None:
    """Has streams of this session keep state in RocksDB, not in an executor's memory."""
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def in_pandas(events: DataFrame, steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """events through steps in pandas, which has no null among numbers: all but seq and ts_ms pass as text."""
    with_store(events.sparkSession)
    numbers = {f.name: f.dataType for f in events.schema if isinstance(f.dataType, NumericType | BooleanType) and f.name not in ("seq", "ts_ms")}
    if not numbers:
        return steps(events)
    out = steps(events.withColumns({c: F.col(c).cast("string") for c in numbers}))
    return out.withColumns({c: F.col(c).cast(t) for c, t in numbers.items()})


class Escalation(StatefulProcessor):
    """Raises the severity of what repeats within `span`. State: how many events came at each time, in PARTS of the span.

    What a batch costs a key is a call of the store for each part, however many events came in the span.
    """

    def __init__(self, columns: list[str], one: int, all_: int, span: int, lives: int) -> None:
        self.columns, self.one, self.all, self.span, self.lives = columns, one, all_, span, lives
        self.width = max(1, span // PARTS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getMapState("times", "part long", "counts binary", self.lives)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: bytes(v[0]) for k, v in self.times.iterator()} if self.times.exists() else {}
        flat = array("q", b"".join(known.values()))  # a time, how many came at it, the next time, ...
        held, n = dict(zip(flat[::2], flat[1::2])), sum(flat[1::2])
        times = sorted(held)  # a heap: what goes is the earliest
        rows = pd.concat(list(rows), ignore_index=True).set_axis(self.columns, axis=1)
        order, counts = np.argsort(rows.seq.to_numpy(), kind="stable"), []
        for ts in rows.ts_ms.to_numpy()[order].tolist():
            while times and times[0] <= ts - self.span:
                n -= held.pop(heappop(times))
            if ts not in held:
                held[ts] = 0
                heappush(times, ts)
            held[ts] += 1
            n += 1
            counts.append(n)
        after: dict[int, array] = {}
        for t in sorted(held):
            after.setdefault(t // self.width, array("q")).extend((t, held[t]))
        for part in known.keys() - after.keys():
            self.times.removeKey((part,))
        for part, some in after.items():
            if known.get(part) != some.tobytes():
                self.times.updateValue((part,), (some.tobytes(),))
        count = np.empty(len(rows), dtype="int64")
        count[order] = counts
        was = rows.severity.to_numpy(dtype=object)
        up = np.array([RAISED.get(s, SEVERITIES[0]) for s in was], dtype=object)
        now = np.where(count >= self.all, "critical", np.where(count >= self.one, up, was))
        yield rows.assign(severity=now, count=count, original_severity=was, escalated=now != was)

    def close(self) -> None:
        pass


def escalated(events: DataFrame, one: int = 3, all_: int = 10, span: int = 600_000, lives: int = LIVES) -> DataFrame:
    """Events with count, original_severity, escalated, and the severity that repeats of their rule and tool raise."""

    def steps(rows: DataFrame) -> DataFrame:
        schema = StructType(list(rows.schema.fields)).add("count", "long").add("original_severity", "string").add("escalated", "boolean")
        return rows.groupBy("rule_name", "tool_name").transformWithStateInPandas(Escalation(rows.columns, one, all_, span, lives), schema, "append", "processingTime")

    return in_pandas(events, steps)


def deduplicated(events: DataFrame, span: int = 300_000, keys: list[str] | None = None, lives: int = LIVES) -> DataFrame:
    """The first event of a key, then each that comes `span` after the last one that passed.

    Keys are many, with few rows each, so they are stepped in BUCKETS by hash. State of a bucket: its keys, when each
    passed last, and the machine's time then.
    """

    def step(bucket, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if expired(state, lives):
            return
        now = state.getCurrentProcessingTimeMs()
        known = {k: (t, at) for k, t, at in zip(*state.get) if now - at < lives} if state.exists else {}
        rows = pd.concat(list(batches), ignore_index=True)
        codes, own = pd.factorize(rows["_key"])
        order = np.lexsort((rows.seq.to_numpy(), rows.ts_ms.to_numpy(), codes))
        ts, ends = rows.ts_ms.to_numpy()[order].tolist(), np.cumsum(np.bincount(codes)).tolist()
        sent = []
        for key, start, end in zip(own, [0, *ends], ends):
            at = bisect_left(ts, known[key][0] + span, start, end) if key in known else start
            while at < end:
                sent.append(at)
                known[key] = ts[at], now
                at = bisect_left(ts, ts[at] + span, at, end)
        state.update((list(known), [t for t, _ in known.values()], [at for _, at in known.values()]))
        yield rows.iloc[order[sent]].drop(columns=["_key", "_bucket"])

    def steps(rows: DataFrame) -> DataFrame:
        key = F.to_json(F.struct(*(keys or DEDUP_KEYS)))  # leaves nulls out, so they are a value of their own
        keyed = rows.withColumn("_key", key).withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)))
        held = "keys array<string>, sent array<bigint>, written array<bigint>"
        return keyed.groupBy("_bucket").applyInPandasWithState(step, rows.schema, held, "append", GroupStateTimeout.ProcessingTimeTimeout)

    return in_pandas(events, steps)


def routed(events: DataFrame, dismissals: DataFrame, now_ms: int | Column | None = None) -> DataFrame:
    """Alerts of a stream of events, with their summary. dismissals: best Versions.live(), which each batch reads anew: a list that is broadcast."""
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
    out = deduplicated(undismissed(escalated(events), F.broadcast(dismissals), now))  # a managed list, which one task reads
    return out.withColumn("summary", F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("title")))


def caught_up(stream: DataFrame, out: str, checkpoint: str, once: bool = True) -> DataFrame:
    """Writes what a stream has by now to files in `out`, and goes on from the checkpoint when called again.

    once: all in one batch. Otherwise by the trigger that also moves the watermark on; where state lives by the
    machine's time that one never ends.
    """
    trigger = {"once": True} if once else {"availableNow": True}
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
