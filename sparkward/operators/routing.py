"""Dismissals, and the way of an event from detection to an alert."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stateful import deduplicated, escalated

DISMISSAL = "rule_name string, tool_name string, skill_name string, expires_at bigint"
FIELDS = ("rule_name", "tool_name", "skill_name")


def active(dismissals: DataFrame, now_ms: int | Column) -> DataFrame:
    """Dismissals that name at least one field and haven't expired; 0 and null never do."""
    named = [F.coalesce(F.col(f), F.lit("")) != "" for f in FIELDS]
    open_ = F.coalesce("expires_at", F.lit(0)).isin(0) | (F.col("expires_at") >= now_ms)
    return dismissals.where((named[0] | named[1] | named[2]) & open_)


def listed(dismissals: DataFrame, now_ms: int) -> DataFrame:
    """Dismissals that haven't expired, the newest first. dismissals has created_at."""
    return active(dismissals, now_ms).orderBy(F.desc("created_at"), "id")


def undismissed(events: DataFrame, dismissals: DataFrame, now_ms: int | Column) -> DataFrame:
    """Events that no dismissal covers, an empty field covering any value; blocked and critical ones always stay.

    Dismissals are joined by the fields that they name: one equality join for each set of fields, whose side is as
    small as the different values of those fields.
    """
    named = lambda f: F.nullif(F.col(f), F.lit(""))
    given = active(dismissals, now_ms).select(*[named(f).alias(f) for f in FIELDS])
    open_ = (F.col("action") != "blocked") & (F.col("severity") != "critical")
    out = events
    for k in range(1, 1 << len(FIELDS)):
        some = [f for j, f in enumerate(FIELDS) if k >> j & 1]
        has = reduce(and_, [F.col(f).isNotNull() if f in some else F.col(f).isNull() for f in FIELDS])
        these = given.where(has).select(*[F.col(f).alias("d_" + f) for f in some]).distinct()
        out = out.join(these, reduce(and_, [F.col(f) == F.col("d_" + f) for f in some]) & open_, "left_anti")
    return out


def routed(events: DataFrame, dismissals: DataFrame, now_ms: int, escalate: bool = True, dismiss: bool = True) -> DataFrame:
    """Alerts: escalation, then dismissal, then deduplication by the escalated severity; summary is added."""
    out = escalated(events) if escalate else events
    out = undismissed(out, dismissals, now_ms) if dismiss else out
    return deduplicated(out).withColumn("summary", F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("title")))


def dismissals_of(events: DataFrame, ids: list[str]) -> DataFrame:
    """Dismissals made from events: their rule, tool and skill."""
    wanted = events.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    return events.join(wanted, "id").select(*FIELDS, F.lit(None).cast("bigint").alias("expires_at"))
