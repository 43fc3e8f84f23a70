"""The stateful operators over streams: the same results as in batch for calls in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schema import NO_SESSION

#: Milliseconds without a row after which a key's state is dropped.
IDLE = 3_600_000

def expired(state: GroupState, idle: int) -> bool:
    """Whether a key has been idle for so many ms, upon which its state goes; else its time starts anew."""
    if state.hasTimedOut:
        state.remove()
        return True
    state.setTimeoutDuration(idle)
    return False


def rate_limited(calls: DataFrame, most: int = 60, span: int = 60_000, idle: int = IDLE) -> DataFrame:
    """Calls over the rate of their session, in order of arrival. State: times within the last span, of sessions not idle."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if expired(state, idle):
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, ts in zip(rows.seq, rows.ts_ms):
            times = [t for t in times if t >= ts - span] + [int(ts)]
            n = len(times)
            if n > most:
                out.append((key[0], int(seq), n, "critical" if n > 2 * most else "high" if n > 1.5 * most else "medium"))
        state.update((times,))
        yield pd.DataFrame(out, columns=["session_key", "seq", "calls_in_window", "severity"])

    keyed = calls.withColumn("session_key", F.coalesce("session_id", "agent_id", F.lit(NO_SESSION)))
    return keyed.groupBy("session_key").applyInPandasWithState(
        step, "session_key string, seq long, calls_in_window long, severity string", "times array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def deduplicated(events: DataFrame, keys: list[str], span: int = 300_000, idle: int = IDLE) -> DataFrame:
    """Events that are sent. State: when the last one was, of keys not idle (idle is to be over span)."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if expired(state, idle):
            return
        last = state.get[0] if state.exists else None
        rows, out = pd.concat(list(batches)).sort_values(["ts_ms", "seq"]), []
        for seq, ts in zip(rows.seq, rows.ts_ms):
            if last is None or ts - last >= span:
                last = int(ts)
                out.append((int(seq), int(ts)))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["seq", "ts_ms"])

    return events.groupBy(*keys).applyInPandasWithState(step, "seq long, ts_ms long", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def drifted(calls: DataFrame, threshold: int = 20, ratio: float = 0.3, idle: int = 30 * 24 * IDLE) -> DataFrame:
    """Calls of tools that are new to a learned skill. State: its tools and counts, until a month without a call."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if expired(state, idle):
            return
        tools, total, learned, novel = (list(state.get[0]), *state.get[1:]) if state.exists else ([], 0, 0, 0)
        known, out = set(tools), []
        rows = pd.concat(list(batches)).sort_values("seq")
        for seq, tool in zip(rows.seq, rows.tool_name):
            total += 1
            new = tool not in known
            known.add(tool)
            learned = len(known) if total == threshold else learned
            if new and total >= threshold:
                novel += 1
                out.append((key[0], int(seq), tool, "high" if novel / max(learned, 1) > ratio else "medium"))
        state.update((sorted(known), total, learned, novel))
        yield pd.DataFrame(out, columns=["skill_name", "seq", "tool_name", "severity"])

    return calls.where("skill_name is not null").groupBy("skill_name").applyInPandasWithState(
        step, "skill_name string, seq long, tool_name string, severity string", "tools array<string>, total long, learned long, novel long", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def time_series(events: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts by window of events that come at most so late. events has ts_ms and action."""
    timed = events.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.count_if(F.col("action") == "blocked").alias("blocked"))
