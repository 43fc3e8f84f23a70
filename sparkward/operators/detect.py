"""Stateless detectors: one plan per family, best match without a shuffle, and the merge per call."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.candidates import may_match
from ..functions.redact import redacted_params
from ..functions.regex import compiled, java, open_ended
from ..plans.patterns import exec as exec_patterns
from ..plans.patterns import exfil, injection, net
from ..plans.patterns import path as path_patterns
from ..schema import SEVERITIES, event_id, rank
from ..sources.views import results_as_calls

RANK = {s: k + 1 for k, s in enumerate(SEVERITIES)}
#: Tools that run commands.
EXEC_TOOLS = (
    "exec", "eval", "bash", "shell", "run_command", "execute", "terminal", "cmd", "powershell", "subprocess", "system",
    "spawn", "computer", "run", "invoke", "sh", "zsh", "ssh", "cli", "script", "evaluate", "repl", "code_interpreter",
    "runner", "action", "apply", "computer_use", "execute_command", "execute_code", "run_code", "code_execution",
    "deno", "bun",
)
EXEC_TOOL = r"(?:^|[_\-.])(exec|executor|shell|bash|command|terminal|subprocess|run|runner|cmd|script|ssh)(?:\z|[_\-.])"
EVENT = ["seq", "id", "ts_ms", "category", "severity", "title", "description", "details", "tool_name", "tool_params", "skill_name", "session_id", "agent_id", "rule_name", "matched_pattern", "action", "should_block"]


#: Rows of a list up to which it is broadcast; longer ones are shuffled with what they are held against.
SMALL = 10_000


@dataclass(frozen=True)
class Family:
    rule: str
    category: str
    patterns: tuple
    read: object  # parameters -> (raw, chunk) pairs


FAMILIES = {
    "exec": Family("exec-guard", "exec_danger", exec_patterns.PATTERNS, T.commands),
    "path": Family("path-guard", "path_violation", path_patterns.PATTERNS, T.paths),
    "net": Family("network-guard", "network_suspect", net.PATTERNS, T.addresses),
    "injection": Family("prompt-injection", "prompt_injection", injection.PATTERNS, T.model_text),
    "exfil": Family("data-exfil", "data_exfil", exfil.PATTERNS, T.outgoing),
}


def is_exec_tool(name: Column) -> Column:
    names = [F.lower(name), F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"))]
    return names[0].isin(*EXEC_TOOLS) | names[1].isin(*EXEC_TOOLS) | names[0].rlike(EXEC_TOOL) | names[1].rlike(EXEC_TOOL)


def matches(x: Column, k: int, source: str, flags: str) -> Column:
    """Whether a chunk matches expression k; it is tried where the chunk's mask has it."""
    return may_match(x, k) & x["chunk"].rlike(java(source, flags))


def first_hit(texts: Column, patterns) -> Column:
    """struct(-rank, text, pattern) of the most severe match, then the first text, then the first pattern."""
    order = sorted(range(len(patterns)), key=lambda k: (-RANK[patterns[k][1]], k))  # the first that matches is the best of its chunk
    hit = lambda k, i: F.struct(F.lit(-RANK[patterns[k][1]]).alias("rank"), i.alias("text"), F.lit(k).alias("pattern"))
    best = lambda x, i: F.coalesce(*[F.when(matches(x, k, patterns[k][5], patterns[k][6]), hit(k, i)) for k in order])
    return F.array_min(F.array_compact(F.transform(texts, best)))


def with_user_patterns(name: str, user: list[str]) -> tuple:
    """A family's patterns, then the user's: paths as expressions, domains as names."""
    out = list(FAMILIES[name].patterns)
    for u in user:
        source = u
        if name == "net":
            escaped = "".join("\\" + c if c in ".*+?^${}()|[]\\" else c for c in u)
            source = rf"(?:^|[/.]|\b){escaped}(?:[:/]|$)"
        if compiled(source) is None:
            continue
        title = f"自定义敏感路径匹配: {u}" if name == "path" else f"访问被阻断域名: {u}"
        out.append((f"{name}.user", "high", "custom" if name == "path" else "", title, f"访问用户阻断域名: {u}", source, "i"))
    return tuple(out)


def detect(calls: DataFrame, name: str, user: list[str] | None = None) -> DataFrame:
    """Events of one family: at most one a call."""
    family, patterns = FAMILIES[name], with_user_patterns(name, user or [])
    rows = calls.where(is_exec_tool(F.col("tool_name"))) if name == "exec" else calls
    sources = tuple(p[5] for p in patterns) + (exfil.DESTINATIONS if name == "exfil" else ())
    rows = T.once(rows, "texts", T.reader(family.read, tuple(sources))("params")).where(F.size("texts") > 0)
    sought = [(*p[:5], open_ended(p[5]) if name == "exfil" else p[5], p[6]) for p in patterns]  # of leaks texts are whole
    rows = T.once(rows, "hit", first_hit(F.col("texts"), sought))
    spark = calls.sparkSession
    table = spark.createDataFrame(
        [(k, *p[:6], java(*s[5:])) for k, (p, s) in enumerate(zip(patterns, sought))],
        "pattern int, pattern_id string, severity string, sub_category string, title string, description string, source string, regex string",
    )
    if name == "exfil":
        return outgoing_events(rows, table, len(patterns))
    rows = rows.where("hit is not null").join(F.broadcast(table), F.col("hit.pattern") == F.col("pattern"))  # as many rows as patterns
    found = F.element_at("texts", F.col("hit.text") + 1)
    tool = F.col("tool_name")
    if name == "exec":
        long = F.length(found["raw"]) > T.SHOWN
        command = F.when(long, F.concat(F.substring(found["raw"], 1, T.SHOWN), F.lit("...[truncated]"))).otherwise(found["raw"])
        details = F.struct(command.alias("command"), F.col("source").alias("matchedPattern"), tool.alias("toolName"), F.col("skill_name").alias("skillName"))
        description = F.col("description")
    elif name == "path":
        details = F.struct(found["raw"].alias("path"), F.col("source").alias("matchedPattern"), F.col("sub_category").alias("pathCategory"))
        description = F.concat(F.lit('工具 "'), tool, F.lit('" 尝试访问敏感路径（'), F.col("sub_category"), F.lit("类）"))
    elif name == "net":
        details, description = F.struct(found["raw"].alias("url"), F.col("source").alias("matchedPattern")), F.col("description")
    else:
        snippet = F.substring(F.call_function("regexp_extract", found["chunk"], F.col("regex"), F.lit(0)), 1, 80)
        details = F.struct(F.col("source").alias("matchedPattern"), F.col("sub_category").alias("injectionCategory"), snippet.alias("snippet"))
        description = F.concat(F.lit('工具 "'), tool, F.lit('" 的参数中检测到潜在 Prompt 注入（'), F.col("sub_category"), F.lit("类）"))
    return events(rows, family, F.col("severity"), F.col("title"), description, details, F.col("source"))


def outgoing_events(rows: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """Patterns of leaks; a known destination beside a sign of sending overrides them. Destinations are the expressions from n on."""
    sends = lambda x: reduce(or_, [x["chunk"].rlike(java(p, f)) for p, f in exfil.CONDITIONS])
    places = lambda x, i: F.coalesce(*[
        F.when(matches(x, n + k, d, "i"), F.struct(i.alias("text"), F.lit(k).alias("place"))) for k, d in enumerate(exfil.DESTINATIONS)
    ])
    near = F.array_compact(F.transform("texts", places))
    rows = T.once(rows, "place", F.array_min(F.filter(near, lambda p: sends(F.element_at("texts", p["text"] + 1)))))
    rows = rows.where("hit is not null or place is not null")
    rows = rows.join(F.broadcast(table), F.col("hit.pattern") == F.col("pattern"), "left")  # as many rows as patterns
    known, tool = F.col("place").isNotNull(), F.col("tool_name")
    sources = F.array(*[F.lit(d) for d in exfil.DESTINATIONS])
    regexes = F.array(*[F.lit(java(d, "i")) for d in exfil.DESTINATIONS])
    chunk = F.element_at("texts", F.when(known, F.col("place.text")).otherwise(F.col("hit.text")) + 1)["chunk"]
    place = F.when(known, F.element_at(regexes, F.col("place.place") + 1)).otherwise(F.lit("x"))
    destination = F.call_function("regexp_extract", chunk, place, F.lit(0))
    snippet = F.substring(F.call_function("regexp_extract", chunk, F.coalesce("regex", F.lit("x")), F.lit(0)), 1, 100)
    details = F.struct(
        F.when(known, "exfil_destination").otherwise(F.col("sub_category")).alias("exfilCategory"),
        F.when(known, destination).alias("destination"),
        F.when(~known, F.col("source")).alias("matchedPattern"),
        F.when(~known, snippet).alias("snippet"),
    )
    said = F.concat(F.lit('工具 "'), tool, F.lit('" 中检测到数据外泄模式（'), F.col("sub_category"), F.lit("类）"))
    sent = F.concat(F.lit('工具 "'), tool, F.lit('" 正在向已知文件共享/外泄服务发送数据'))
    return events(
        rows, FAMILIES["exfil"], F.when(known, "critical").otherwise(F.col("severity")), F.when(known, exfil.DESTINATION_TITLE).otherwise(F.col("title")),
        F.when(known, sent).otherwise(said), details, F.when(known, F.element_at(sources, F.col("place.place") + 1)).otherwise(F.col("source")),
    )


def events(rows: DataFrame, family: Family, severity, title, description, details, pattern) -> DataFrame:
    block = severity == "critical"
    return rows.select(
        "seq", event_id(F.col("seq"), F.lit(family.rule)).alias("id"), "ts_ms", F.lit(family.category).alias("category"), severity.alias("severity"),
        title.alias("title"), description.alias("description"), redacted_params(F.to_json(details)).alias("details"), "tool_name",
        redacted_params("params").alias("tool_params"), "skill_name", "session_id", "agent_id", F.lit(family.rule).alias("rule_name"),
        pattern.alias("matched_pattern"), F.when(block, "blocked").otherwise("alert").alias("action"), block.alias("should_block"),
    )


def untrusted(calls: DataFrame, trusted: list[str]) -> DataFrame:
    """Calls of skills that aren't trusted: trimmed names without case; a null skill never is."""
    names = sorted({t.strip().lower() for t in trusted})
    if not names:
        return calls
    known = calls.sparkSession.createDataFrame([(n,) for n in names], "name string")
    known = F.broadcast(known) if len(names) <= SMALL else known
    return calls.join(known, F.lower(F.trim("skill_name")) == F.col("name"), "left_anti")


def evaluate(calls: DataFrame, trusted: list[str] = (), rules: tuple[str, ...] = tuple(FAMILIES), more: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Events of all rules over the calls of untrusted skills, rule by rule."""
    rows, out = untrusted(calls, list(trusted)), None
    for k, found in enumerate([*(detect(rows, r) for r in rules), *more]):
        found = found.withColumn("rule_order", F.lit(k))
        out = found if out is None else out.unionByName(found)
    return out


#: Fixed value: what stands before the title of an event found in a result.
RESPONSE = "[响应] "


def response_events(raw: DataFrame, trusted: list[str] = (), more_than: int = 50) -> DataFrame:
    """Events of leaks in results of calls (phase after, result of more than so many characters): alerts, whatever their severity."""
    found = detect(untrusted(results_as_calls(raw, more_than), list(trusted)), "exfil")
    return found.withColumns({"title": F.concat(F.lit(RESPONSE), "title"), "action": F.lit("alert"), "should_block": F.lit(False)})


def verdicts(found: DataFrame) -> DataFrame:
    """seq, blocked, alerts, said: what a tested text would come to."""
    n = found.groupBy("seq").agg(F.count_if("should_block").alias("blocked"), F.count_if(~F.col("should_block")).alias("alerts"))
    some = F.format_string("Result: %d would be BLOCKED, %d would trigger ALERT", "blocked", "alerts")
    return n.withColumn("said", F.when(F.col("blocked") > 0, some).otherwise(F.format_string("Result: %d would trigger ALERT (no blocks)", "alerts")))


def decisions(found: DataFrame, block_on_critical: bool = True) -> DataFrame:
    """One row a call with events: triggered, should_block, block, block_reason, n_events."""
    order = F.when(F.col("should_block"), F.struct((-rank(F.col("severity"))).alias("rank"), "rule_order"))  # min_by leaves nulls out
    merged = found.groupBy("seq").agg(F.bool_or("should_block").alias("should_block"), F.min_by("title", order).alias("block_reason"), F.count("*").alias("n_events"))
    return merged.select(
        "seq", F.lit(True).alias("triggered"), "should_block", (F.col("should_block") & F.lit(block_on_critical)).alias("block"), "block_reason", "n_events"
    )
