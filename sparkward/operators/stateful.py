"""Operators whose result depends on earlier calls or events, as windows over arrival order."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import NO_SESSION, rank, upgraded
from ..shared import saved

#: A key's rows are windowed in slices of time of so many spans, so that no key is one task's alone.
SLICES = 64
#: Arrivals that are folded together.
BLOCK = 65_536


def running(rows: DataFrame, block: Column, order: list[str], value: str, fold: Callable[[str], Column], name: str) -> DataFrame:
    """Adds the fold of `value` over rows of the same _key up to each row: inside blocks, which rise with the order, then over blocks."""
    cut = rows.withColumn("_block", block)
    inside = W.partitionBy("_key", "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    upto = W.partitionBy("_key").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = cut.groupBy("_key", "_block").agg(fold(value).alias("_all")).select("_key", "_block", fold("_all").over(upto).alias("_before"))
    both = cut.withColumn("_inside", fold(value).over(inside)).join(blocks, ["_key", "_block"])
    total = F.greatest("_inside", "_before") if fold is F.max else F.col("_inside") + F.coalesce("_before", F.lit(0))
    return both.select(*rows.columns, total.alias(name))


def recent(rows: DataFrame, keys: list[str], span: int, name: str) -> DataFrame:
    """seq and how many rows of the same keys arrived up to each row and weren't over `span` ms old then, itself included.

    Rows count in the order of arrival (seq), late ones too: a row drops out once one that is over `span` ms
    younger arrives. So there is a clock, the latest time that has arrived, which never goes back; a row comes in at
    the clock of its arrival and goes out at the first clock that is over `span` later than its own time, and what
    is in is a running sum over both. A row that comes over `span` ms late counts for itself alone.
    """
    some = saved(rows.select("seq", "ts_ms", F.struct(*keys).alias("_key")), "arrivals")
    clocked = running(some, F.floor(F.col("seq") / BLOCK), ["seq"], "ts_ms", F.max, "_clock")
    clocked = saved(clocked.withColumn("_gone", F.col("ts_ms") < F.col("_clock") - span), "clocked")
    # Of equal clocks, what goes out is first.
    comes = clocked.select("_key", F.col("_clock").alias("_at"), "seq", F.when(F.col("_gone"), 0).otherwise(1).alias("_step"), "_gone")
    goes = clocked.where("not _gone").select("_key", (F.col("ts_ms") + span + 1).alias("_at"), F.lit(-1).cast("long").alias("seq"), F.lit(-1).alias("_step"), "_gone")
    steps = running(comes.unionByName(goes), F.floor(F.col("_at") / (span * 4)), ["_at", "seq"], "_step", F.sum, name)
    return steps.where("seq >= 0").select("seq", (F.col(name) + F.col("_gone").cast("int")).alias(name))


def evictions(rows: DataFrame, sessions_: int, span: int, every: int = 300_000) -> DataFrame:
    """session_key, seq: which sessions lose their calls at which call, where state is held of so many.

    State is swept by the first call and then by each that comes `every` ms or more after the sweep before; all but
    the sessions seen last go, of equal times those whose last call came first. What happens to a session that wasn't
    seen within `span` before a sweep makes no difference, so a sweep only looks at the calls of that time.
    """
    # A sweep is a call later than all before it, so only those are linked.
    one = saved(rows.select(F.lit(1).alias("_key"), "seq", "ts_ms"), "sweep-calls")
    clocked = running(one, F.floor(F.col("seq") / BLOCK), ["seq"], "ts_ms", F.max, "_clock").where("ts_ms = _clock")
    latest = clocked.groupBy("_key", "ts_ms").agg(F.min("seq").alias("seq"))
    sweeps = deduplicated(latest, every, ["_key"]).select(F.col("seq").alias("sweep"), F.col("ts_ms").alias("at"))
    sweeps = saved(sweeps, "sweeps").withColumn("bucket", F.floor(F.col("at") / every))
    bucket = lambda shift: F.floor((F.col("ts_ms") + shift) / every)
    near = rows.withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(0), bucket(span))))).join(sweeps, "bucket")
    near = near.where((F.col("seq") <= F.col("sweep")) & (F.col("ts_ms") >= F.col("at") - span))
    last = saved(near.groupBy("sweep", "session_key").agg(F.max(F.struct("ts_ms", "seq")).alias("last")), "last-seen")
    nth = F.row_number().over(W.partitionBy("sweep").orderBy(F.desc("last")))
    least = last.withColumn("nth", nth).where(F.col("nth") <= sessions_).groupBy("sweep").agg(F.count("*").alias("held"), F.min("last").alias("least"))
    gone = last.join(least.where(F.col("held") == sessions_), "sweep").where(F.col("last") < F.col("least"))
    return saved(gone.select("session_key", F.col("sweep").alias("seq")), "evictions")


def with_lives(rows: DataFrame, evictions_: DataFrame) -> DataFrame:
    """Adds `life`: how often the row's session had lost its calls before."""
    calls = rows.select(F.struct("session_key").alias("_key"), "seq", "ts_ms", F.lit(0).alias("gone"))
    marks = evictions_.select(F.struct("session_key").alias("_key"), "seq", F.lit(None).cast("long").alias("ts_ms"), F.lit(1).alias("gone"))
    both = running(saved(calls.unionByName(marks), "calls-and-evictions"), F.floor(F.col("seq") / BLOCK), ["seq", "gone"], "gone", F.sum, "life")
    return both.where("gone = 0").select("seq", "ts_ms", F.col("_key.session_key").alias("session_key"), "life")


def rate_limited(calls: DataFrame, most: float | None = 60, span: int = 60_000, sessions_: int | None = None) -> DataFrame:
    """Calls over the rate of their session: seq, session_key, calls_in_window, severity, should_block, ratio.

    sessions_: of how many sessions state is held; None for all. See evictions.
    """
    most = int(most) if most is not None and math.isfinite(most) and most >= 1 else 60
    rows = calls.select("seq", "ts_ms", F.coalesce("session_id", "agent_id", F.lit(NO_SESSION)).alias("session_key"))
    keys = ["session_key"]
    if sessions_ is not None:
        rows, keys = saved(with_lives(rows, evictions(rows, sessions_, span)), "lives"), ["session_key", "life"]
    over = recent(rows, keys, span, "calls_in_window").where(F.col("calls_in_window") > most)
    rows = rows.join(over, "seq")
    n = F.col("calls_in_window")
    severity = F.when(n > 2 * most, "critical").when(n > 1.5 * most, "high").otherwise("medium")
    return rows.select("seq", "session_key", "calls_in_window", severity.alias("severity"), (n > 2 * most).alias("should_block"), F.round(n / most, 2).alias("ratio"))


def drifted(calls: DataFrame, threshold: int = 20, ratio: float = 0.3) -> DataFrame:
    """Calls of tools that are new to a skill after it was learned: seq, skill_name, tool_name, severity, total_calls, unique_tools, known_tools.

    Only the first call of each tool of a skill can be one. How many calls a skill made up to it is counted over
    blocks of arrivals, and row by row only in the block where it lies; what is windowed are a skill's tools.
    """
    rows = calls.where("skill_name is not null").select("seq", "skill_name", "tool_name", F.floor(F.col("seq") / BLOCK).alias("block"))
    firsts = rows.groupBy("skill_name", "tool_name").agg(F.min("seq").alias("seq")).withColumn("block", F.floor(F.col("seq") / BLOCK))
    upto = W.partitionBy("skill_name").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = rows.groupBy("skill_name", "block").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    inside = rows.drop("tool_name").join(firsts.select("skill_name", "block").distinct(), ["skill_name", "block"], "left_semi")
    inside = inside.withColumn("nth", F.row_number().over(W.partitionBy("skill_name", "block").orderBy("seq")))
    firsts = firsts.join(inside, ["skill_name", "block", "seq"]).join(before, ["skill_name", "block"]).withColumn("total_calls", F.col("before") + F.col("nth"))
    skill = W.partitionBy("skill_name").orderBy("seq")
    upto = skill.rowsBetween(W.unboundedPreceding, 0)
    new = F.col("total_calls") >= threshold
    firsts = firsts.withColumns(
        {
            "unique_tools": F.count("*").over(upto),
            "learned": F.sum((F.col("total_calls") <= threshold).cast("int")).over(W.partitionBy("skill_name")),
            "novel": F.sum(new.cast("int")).over(upto),
            "known_tools": F.array_sort(F.collect_set("tool_name").over(skill.rowsBetween(W.unboundedPreceding, -1))),
        }
    ).where(new)
    share = F.col("novel") / F.greatest(F.col("learned"), F.lit(1))
    return firsts.select(
        "seq", "skill_name", "tool_name", F.when(share > ratio, "high").otherwise("medium").alias("severity"),
        F.col("total_calls").cast("long").alias("total_calls"), F.col("unique_tools").cast("long").alias("unique_tools"), "known_tools",
    )


def learning(calls: DataFrame, threshold: int = 20) -> DataFrame:
    """skill_name, total_calls, is_learning of each skill."""
    n = F.count("*")
    return calls.where("skill_name is not null").groupBy("skill_name").agg(n.alias("total_calls"), (n < threshold).alias("is_learning"))


def escalated(events: DataFrame, one: int = 3, all_: int = 10, span: int = 600_000) -> DataFrame:
    """Adds count, escalated, and the severity that repeats of a rule and tool raise."""
    rows = events.join(recent(events, ["rule_name", "tool_name"], span - 1, "count"), "seq").select(*events.columns, "count")
    n, old = F.col("count"), F.col("severity")
    new = F.when(n >= all_, "critical").when(n >= one, upgraded(old, 1)).otherwise(old)
    return rows.withColumn("original_severity", old).withColumn("severity", new).withColumn("escalated", F.col("severity") != F.col("original_severity"))


DEDUP_KEYS = ["session_id", "rule_name", "tool_name", "matched_pattern", "severity"]


def deduplicated(events: DataFrame, span: int = 300_000, keys: list[str] | None = None) -> DataFrame:
    """Events that are sent: the first of a key, then each that comes at least `span` ms after the last one sent.

    Each event links to the first one that comes `span` ms later or more; what is sent is what links reach from
    the events with a pause of `span` before them. Links are found in slices of time and followed by doubling, so
    a key that never pauses is many tasks.
    """
    keys, width = keys or DEDUP_KEYS, span * SLICES
    at = lambda shift: F.floor((F.col("ts_ms") + shift) / width)
    rows = events.select(*keys, "ts_ms", "seq").withColumn("_own", at(0))
    rows = rows.withColumn("_slice", F.explode(F.array_distinct(F.array("_own", at(span), at(-2 * span)))))
    # A row's link is what came last, backwards in time, when its probe comes a span later: each window is one pass.
    before = F.lag("ts_ms").over(W.partitionBy(*keys, "_slice").orderBy("ts_ms", "seq"))
    rows = rows.withColumn("_start", F.coalesce(F.col("ts_ms") - before >= span, F.lit(True)))
    rows = rows.withColumn("_probe", F.explode(F.when(F.col("_own") == F.col("_slice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    back = W.partitionBy(*keys, "_slice").orderBy(F.desc("_at"), "_probe", F.desc("seq")).rowsBetween(W.unboundedPreceding, 0)
    then = F.last(F.when(F.col("_probe") == 0, F.struct("ts_ms", "seq")), ignorenulls=True).over(back)
    rows = rows.withColumn("_at", F.col("ts_ms") + F.col("_probe") * span).withColumn("_then", then).where("_probe = 1")
    link = F.when(F.col("_then.ts_ms") < F.col("ts_ms") + 2 * span, F.col("_then.seq"))
    links = rows.select("seq", F.col("_start").alias("start"), link.alias("next"))
    links = saved(links, "sent-links")
    sent = links.where("start").select("seq")
    jump = links.where("next is not null").select("seq", "next").join(sent.toDF("next"), "next", "left_anti")  # what starts a run needs no link
    jump = saved(jump.select("seq", "next"), "sent-links")
    while not jump.isEmpty():
        more = saved(sent.join(jump, "seq").select(F.col("next").alias("seq")).join(sent, "seq", "left_anti").distinct(), "sent")
        if more.isEmpty():
            break
        sent = sent.unionByName(more)
        jump = saved(jump.join(jump.toDF("next", "after"), "next").select("seq", F.col("after").alias("next")), "sent-links")
    return events.join(sent, "seq", "left_semi")


def sessions(calls: DataFrame, idle: int = 3_600_000) -> DataFrame:
    """session_id, life, started_at, ended_at, tool_call_count: a session's lives, ended by an idle hour.

    Calls are cut at pauses inside slices of time first; what is windowed by session are those stretches.
    """
    rows = calls.select(F.coalesce("session_id", F.lit(NO_SESSION)).alias("session_key"), "ts_ms", F.floor(F.col("ts_ms") / (idle * SLICES)).alias("slice"))
    inside = W.partitionBy("session_key", "slice").orderBy("ts_ms")
    pause = lambda since: F.coalesce((F.col(since) - F.col("before") > idle).cast("int"), F.lit(0))
    cut = rows.withColumn("before", F.lag("ts_ms").over(inside)).withColumn("stretch", F.sum(pause("ts_ms")).over(inside))
    cut = cut.groupBy("session_key", "slice", "stretch").agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b"), F.count("*").alias("n"))
    order = W.partitionBy("session_key").orderBy("a")
    lives = cut.withColumn("before", F.lag("b").over(order)).withColumn("life", F.sum(pause("a")).over(order))
    return lives.groupBy(F.col("session_key").alias("session_id"), "life").agg(
        F.min("a").alias("started_at"), F.max("b").alias("ended_at"), F.sum("n").alias("tool_call_count")
    )


def first_run(calls: DataFrame, threshold: int = 20) -> DataFrame:
    """What a skill does while it is learned, by session: tools, files, domains, commands, each in order of appearance. calls.params is JSON."""
    value = lambda *names: F.coalesce(*[F.get_json_object("params", f"$.{n}") for n in names])
    url = value("url", "uri", "endpoint")
    host = F.expr("try_parse_url(u, 'HOST')")
    n = F.row_number().over(W.partitionBy("skill_name").orderBy("seq"))
    rows = calls.where("skill_name is not null").withColumn("_n", n).where(F.col("_n") <= threshold)
    rows = rows.withColumn("u", F.when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit("https://"), url)))

    def some(c: str | Column, most: int) -> Column:
        seen = F.array_sort(F.collect_list(F.struct("seq", (F.col(c) if isinstance(c, str) else c).alias("value"))))  # threshold rows at most
        return F.slice(F.array_distinct(F.array_compact(F.transform(seen, lambda x: x["value"]))), 1, most)

    return rows.groupBy("skill_name", "session_id").agg(
        some("tool_name", 500).alias("tools"),
        some(value("path", "file_path", "file", "filename"), 500).alias("files"),
        some(host, 200).alias("domains"),
        some(F.substring(value("command", "cmd"), 1, 1024), 1000).alias("commands"),
        F.count("*").alias("n_calls"),
        F.min("seq").alias("first_seq"),
        F.min("ts_ms").alias("started_at"),
        F.max("ts_ms").alias("ended_at"),
    )


def severity_floor(events: DataFrame, least: str = "high") -> DataFrame:
    return events.where(rank(F.col("severity")) >= rank(F.lit(least)))


def newest(rows: DataFrame, n: int, offset: int = 0, most: int = 10_000) -> DataFrame:
    """Newest first; ties by arrival."""
    return rows.orderBy(F.desc("ts_ms"), F.desc("seq")).offset(offset).limit(min(n, most))


