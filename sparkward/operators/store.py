"""Tables of events, sessions, baselines and dismissals: writing rules, and the read path."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import SEVERITIES, rank
from .stateful import newest


@dataclass(frozen=True)
class EventQuery:
    severity: str | None = None
    category: str | None = None
    skill_name: str | None = None
    session_id: str | None = None
    rule_name: str | None = None
    since: int | None = None
    until: int | None = None
    limit: int = 100
    offset: int = 0

    @staticmethod
    def from_http(args: dict[str, str]) -> EventQuery:
        """Decoded query string: unknown severities, long values and empty strings count as absent."""
        names = {"severity": "severity", "category": "category", "skillName": "skill_name", "sessionId": "session_id", "ruleName": "rule_name"}
        found = {to: args[k] for k, to in names.items() if args.get(k) and len(args[k]) <= 200}
        if found.get("severity") not in (None, *SEVERITIES):
            del found["severity"]
        whole = lambda k, low, high, other: min(max(int(args[k]), low), high) if re.fullmatch(r"-?\d{1,15}", args.get(k, "")) else other
        since = int(args["since"]) if re.fullmatch(r"\d{1,15}", args.get("since", "")) else None
        return EventQuery(**found, since=since, limit=whole("limit", 1, 10_000, 100), offset=whole("offset", 0, 100_000, 0))


def filtered(events: DataFrame, q: EventQuery) -> DataFrame:
    for name in ("severity", "category", "skill_name", "session_id", "rule_name"):
        if getattr(q, name) is not None:
            events = events.where(F.col(name) == getattr(q, name))
    if q.since is not None:
        events = events.where(F.col("ts_ms") >= q.since)
    return events.where(F.col("ts_ms") <= q.until) if q.until is not None else events


def page(events: DataFrame, q: EventQuery) -> DataFrame:
    return newest(filtered(events, q), q.limit, q.offset)


def by_id(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.where(F.col(key) == value).limit(1)


def totals(events: DataFrame) -> DataFrame:
    is_ = lambda a: F.count_if(F.col("action") == a)
    return events.agg(
        F.count("*").alias("total"), is_("blocked").alias("blocked"), is_("alert").alias("alerts"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms")
    )


def status(events: DataFrame) -> DataFrame:
    """Totals, and which event is the newest: newest_id, newest_at, newest_category; one row, as an aggregate."""
    newest_ = F.max(F.struct("ts_ms", "seq", "id", "category")).alias("_newest")
    is_ = lambda a: F.count_if(F.col("action") == a)
    rows = events.agg(F.count("*").alias("total"), is_("blocked").alias("blocked"), is_("alert").alias("alerts"), newest_)
    return rows.select("total", "blocked", "alerts", F.col("_newest.id").alias("newest_id"), F.col("_newest.ts_ms").alias("newest_at"), F.col("_newest.category").alias("newest_category"))


def check_counters(checks: DataFrame, events: DataFrame) -> DataFrame:
    """total_checks, total_blocked (checks with an event that blocks), total_alerts (events) of checks (seq)."""
    per = events.groupBy("seq").agg(F.count("*").alias("n"), F.bool_or("should_block").alias("blocks"))
    return checks.select("seq").join(per, "seq", "left").agg(
        F.count("*").alias("total_checks"), F.count_if("blocks").alias("total_blocked"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_alerts")
    )


def by_severity(events: DataFrame) -> DataFrame:
    """Counts of all five severities, zero where there is none."""
    every = events.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return every.join(events.groupBy("severity").count(), "severity", "left").select("severity", F.coalesce("count", F.lit(0)).alias("n"))


def by_column(events: DataFrame, name: str) -> DataFrame:
    return events.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))


def grouped_once(events: DataFrame) -> DataFrame:
    """All groupings in one pass: dimension, value, n, blocked."""
    sets = events.groupingSets([["severity"], ["category"], ["rule_name"], []], "severity", "category", "rule_name")
    found = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if(F.col("action") == "blocked").alias("blocked"))
    dimension = F.when(F.col("g") == 3, "severity").when(F.col("g") == 5, "category").when(F.col("g") == 6, "rule").otherwise("all")
    value = F.when(F.col("g") == 3, F.col("severity")).when(F.col("g") == 5, F.col("category")).when(F.col("g") == 6, F.col("rule_name")).otherwise("all")
    return found.select(dimension.alias("dimension"), value.alias("value"), "n", "blocked").where("value is not null")


def time_series(events: DataFrame, bucket: float = 60_000, since: int | None = None) -> DataFrame:
    """bucket_ms, n, blocked, rising; empty buckets are left out."""
    width = int(bucket)
    if width <= 0:
        raise ValueError("a bucket lasts at least a millisecond")
    rows = events if since is None else events.where(F.col("ts_ms") >= since)
    start = (F.floor(F.col("ts_ms") / width) * width).cast("long")
    return rows.groupBy(start.alias("bucket_ms")).agg(F.count("*").alias("n"), F.count_if(F.col("action") == "blocked").alias("blocked"))


def http_bucket(width: int) -> int:
    return 60_000 if width < 1000 else min(width, 86_400_000)


def skills(events: DataFrame, recent: int = 10_000) -> DataFrame:
    """Tools and events of each skill among the newest events, most events first."""
    rows = newest(events, recent).where("skill_name is not null")
    return rows.groupBy("skill_name").agg(F.countDistinct("tool_name").alias("tools"), F.count("*").alias("n")).orderBy(F.desc("n"), "skill_name")


def top_rules(events: DataFrame, n: int = 10) -> DataFrame:
    return by_column(events, "rule_name").orderBy(F.desc("n"), "rule_name").limit(n)


def inserted(events: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Insert that ignores ids which are there: the first row of each id, as an aggregate that combines before the shuffle."""
    first = events.groupBy(key).agg(F.min(order).alias(order))
    return events.join(first, [key, order], "left_semi")


def upserted(rows: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Insert that replaces: the last row of each key."""
    last = rows.groupBy(key).agg(F.max(order).alias(order))
    return rows.join(last, [key, order], "left_semi")


def updated(sessions: DataFrame, changes: DataFrame, columns: tuple[str, ...] = ("agent_id", "ended_at", "tool_call_count", "event_count")) -> DataFrame:
    """Partial update: given values replace, start and id never change, unknown ids do nothing."""
    new = changes.select("session_id", *[F.col(c).alias("_" + c) for c in columns if c in changes.columns])
    joined = sessions.join(new, "session_id", "left")
    return joined.select(*[F.coalesce("_" + c, c).alias(c) if "_" + c in new.columns else F.col(c) for c in sessions.columns])


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def retained(events: DataFrame, n: int) -> DataFrame:
    """The newest n events."""
    return events.orderBy(F.desc("ts_ms"), F.desc("seq")).limit(n)


def baselines(calls: DataFrame) -> DataFrame:
    """Stored profile of each skill over its sessions."""
    per = calls.where("skill_name is not null").groupBy("skill_name", "session_id").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"))
    return per.groupBy("skill_name").agg(
        F.min("first").alias("first_seen"), F.max("last").alias("last_seen"), F.count("*").alias("session_count"),
        F.avg("n").alias("avg_calls_per_session"), F.stddev_pop("n").alias("std_dev_calls"), F.max("n").alias("max_calls_observed"),
    )


def listed_baselines(profiles: DataFrame) -> DataFrame:
    """Stored profiles, the one that was seen last first."""
    return profiles.orderBy(F.desc("last_seen"), "skill_name")


def reset_baselines(profiles: DataFrame, skills: DataFrame, now_ms: int) -> DataFrame:
    """Profiles of which those of the given skills start anew: seen now, with no session; unknown skills get one."""
    zero = {c: F.lit(0).cast(profiles.schema[c].dataType) for c in ("session_count", "avg_calls_per_session", "std_dev_calls", "max_calls_observed")}
    fresh = skills.select("skill_name").distinct().withColumns({c: F.lit(now_ms).cast("long") for c in ("first_seen", "last_seen")} | zero)
    return without(profiles, fresh, "skill_name").unionByName(fresh)


def session_lines(summary: DataFrame) -> DataFrame:
    """session_id, line: what is said of a session when it ends."""
    line = F.format_string("calls: %d, alerts: %d, blocked: %d, duration: %ds", "tool_calls", "alerts", "blocked", "seconds")
    return summary.select("session_id", line.alias("line"))


#: The words of a first run's report; none stands for an empty list.
REPORT = ("首次运行报告", "会话", "时长", "工具使用", "文件访问", "网络域名", "命令执行", "安全事件")
NONE = "无"


def report_texts(reports: DataFrame, events: DataFrame) -> DataFrame:
    """skill_name, session_id, n_events, report of first runs (stateful.first_run), with the events of their skill and session after their first call."""
    here = ["skill_name", "session_id"]
    found = events.join(reports.select(*here, "first_seq"), here).where(F.col("seq") > F.col("first_seq")).groupBy(*here).agg(F.count("*").alias("n_events"))
    rows = reports.join(found, here, "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    some = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(NONE)
    commands = F.when(F.size("commands") > 0, F.concat(F.lit("\n    "), F.array_join("commands", "\n    "))).otherwise(NONE)
    seconds = F.concat(F.round((F.col("ended_at") - F.col("started_at")) / 1000).cast("long"), F.lit("s"))
    values = ("skill_name", "session_id", seconds, some("tools"), some("files"), some("domains"), commands, "n_events")
    lines = [F.concat(F.lit(("" if k == 0 else "  ") + name + ": "), v) for k, (name, v) in enumerate(zip(REPORT, values))]
    return rows.select(*here, "n_events", F.concat_ws("\n", *lines).alias("report"))


def tool_usage(calls: DataFrame) -> DataFrame:
    """skill_name, tool_name, n, place: tools of a skill by use."""
    n = calls.where("skill_name is not null").groupBy("skill_name", "tool_name").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(W.partitionBy("skill_name").orderBy(F.desc("n"), "tool_name")))


def session_summary(calls: DataFrame, events: DataFrame) -> DataFrame:
    """session_id, tool_calls, alerts, blocked, seconds."""
    made = calls.groupBy("session_id").agg(F.count("*").alias("tool_calls"), F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b"))
    found = events.groupBy("session_id").agg(F.count("*").alias("alerts"), F.count_if(F.col("action") == "blocked").alias("blocked"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return made.join(found, "session_id", "left").select("session_id", "tool_calls", zero("alerts"), zero("blocked"), F.floor((F.col("b") - F.col("a")) / 1000).alias("seconds"))



def duration_ms(text: Column) -> Column:
    """Milliseconds of "15m", "2h" and the like; null for anything else."""
    n = F.regexp_extract(text, r"^(\d+)([A-Za-z]+)\z", 1).try_cast("bigint")
    unit = F.lower(F.regexp_extract(text, r"^(\d+)([A-Za-z]+)\z", 2))
    each = {("ms",): 1, ("s", "sec"): 1000, ("m", "min"): 60_000, ("h", "hr"): 3_600_000, ("d", "day"): 86_400_000, ("w", "week"): 604_800_000}
    out = F.lit(None).cast("bigint")
    for names, ms in each.items():
        out = F.when(unit.isin(*names), n * ms).otherwise(out)
    return out


def relative_time(ts_ms: Column, now_ms: int) -> Column:
    diff = F.lit(now_ms) - ts_ms
    away = F.abs(diff)
    text = F.when(away < 3_600_000, F.concat(F.floor(away / 60_000), F.lit("m"))).when(away < 86_400_000, F.concat(F.floor(away / 3_600_000), F.lit("h"))).otherwise(F.concat(F.floor(away / 86_400_000), F.lit("d")))
    ahead = F.concat(F.lit("in "), F.when(away < 60_000, "<1m").otherwise(text))
    return F.when(diff < 0, ahead).when(diff < 60_000, "just now").otherwise(F.concat(text, F.lit(" ago")))
