"""Entities, enumerations and their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("info", "low", "medium", "high", "critical")
CATEGORIES = ("exec_danger", "path_violation", "network_suspect", "rate_anomaly", "baseline_drift", "prompt_injection", "data_exfil")
NO_SESSION = "__default__"

#: A tool call. seq is the order of arrival, which the stateful operators need to break ties.
CALLS = "seq bigint, ts_ms bigint, tool_name string, params string, session_id string, agent_id string, skill_name string"


def rank(severity: Column) -> Column:
    """info 1 to critical 5."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int")


def upgraded(severity: Column, levels: int | Column) -> Column:
    """Severity raised by so many levels, critical at most."""
    at = F.least(rank(severity) + levels, F.lit(len(SEVERITIES)))
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), at.cast("int"))


def event_id(seq: Column, rule: Column) -> Column:
    """The same id when a task is run again."""
    return F.concat(F.lit("evt_"), F.sha2(F.concat_ws("~", seq.cast("string"), rule), 256))
