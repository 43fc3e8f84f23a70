"""What goes out: payloads of each kind of receiver as columns, and their delivery."""

from __future__ import annotations

import posixpath
import random
import re
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import saved

#: Hosts that a receiver must not have.
PRIVATE = (
    r"^127\.", r"^10\.", r"^172\.(1[6-9]|2\d|3[01])\.", r"^192\.168\.", r"^169\.254\.", r"^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.", r"^0\.", r"^::1$", r"^::$",
    r"^fc[0-9a-f]{0,2}:", r"^fd[0-9a-f]{0,2}:", r"^fe80:", r"^::ffff:", r"^0{0,4}:0{0,4}:0{0,4}:0{0,4}:0{0,4}:ffff:", r"^localhost$", r"^0x[0-9a-f]+$",
    r"(?:^|\.)(0x[0-9a-f]+)(?:\.|$)", r"(?:^|\.)(0\d+)(?:\.|$)", r"^\d{8,10}$", r"^0[0-7]{1,3}\.", r"\.nip\.io$", r"\.sslip\.io$", r"\.xip\.io$",
    r"\blocaltest\.me$", r"\blvh\.me$", r"\bvcap\.me$", r"\btraefik\.me$",
)


def is_public(url: Column) -> Column:
    """Whether a receiver's URL is http or https to a host that isn't private."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), r"[\[\]]", "")
    private = F.lit(False)
    for p in PRIVATE:
        private = private | host.rlike("(?i)" + p)
    return F.coalesce(url.rlike("(?i)^https?://") & (host != "") & ~private, F.lit(False))


def iso(ts_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ts_ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def csv_cell(text: Column) -> Column:
    """A quoted cell on one line that no spreadsheet takes for a formula."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n|\r|\n", " "), '"', '""')
    return F.concat(F.when(flat.rlike(r"^[=+\-@\t\r]"), "\"'").otherwise('"'), flat, F.lit('"'))


CSV_HEADER = "timestamp,severity,action,rule,skill,tool,category,message"


def csv_line(events: DataFrame) -> Column:
    cells = [iso(F.col("ts_ms")), F.coalesce("severity", F.lit("info")), F.coalesce("action", F.lit("alert")), *[F.col(c) for c in ("rule_name", "skill_name", "tool_name", "category", "description")]]
    return F.concat_ws(",", *[csv_cell(c) for c in cells])


def console_line() -> Column:
    known = lambda c: F.coalesce(c, F.lit("?"))
    head = F.concat(F.lit("["), F.upper("severity"), F.lit("]"), F.when(F.col("action") == "blocked", " BLOCKED").otherwise(""))
    return F.concat(head, F.lit(" "), F.col("title"), F.lit(" | "), F.col("description"), F.lit(" | tool="), known("tool_name"), F.lit(" skill="), known("skill_name"), F.lit(" rule="), known("rule_name"))


def members(*names: tuple[str, Column | str]) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in names])


def webhook(source: str, version: str) -> Column:
    event = members(("id", "id"), ("timestamp", iso(F.col("ts_ms"))), ("severity", "severity"), ("category", "category"), ("title", "title"), ("description", "description"), ("toolName", "tool_name"), ("skillName", "skill_name"), ("action", "action"))
    return F.to_json(members(("source", F.lit(source)), ("version", F.lit(version)), ("event", event)))


def splunk(source: str, index: str | None = None) -> Column:
    event = members(("id", "id"), ("timestamp", "ts_ms"), ("severity", "severity"), ("category", "category"), ("title", "title"), ("description", "description"), ("rule", "rule_name"), ("tool", "tool_name"), ("skill", "skill_name"), ("session", "session_id"), ("action", "action"))
    more = [("index", F.lit(index))] if index else []
    return F.to_json(members(("event", event), ("sourcetype", F.lit(source)), *more))


def elastic() -> Column:
    return F.to_json(members(("@timestamp", iso(F.col("ts_ms"))), *[(c, c) for c in ("severity", "category", "title", "description", "rule_name", "tool_name", "skill_name", "session_id", "action")]))


def elastic_index(name: str) -> str:
    import re

    if not re.fullmatch(r"[a-z0-9][a-z0-9._-]*", name) or ".." in name:
        raise ValueError(f"not an index name: {name}")
    return name


def datadog(source: str, service: str, tags: list[str]) -> Column:
    status = F.when(F.col("severity") == "critical", "critical").when(F.col("severity") == "high", "error").when(F.col("severity") == "medium", "warn").otherwise("info")
    attributes = members(("severity", "severity"), ("category", "category"), ("title", "title"), ("rule", "rule_name"), ("tool", "tool_name"), ("skill", "skill_name"), ("session", "session_id"), ("action", "action"))
    return F.to_json(F.array(members(("ddsource", F.lit(source)), ("ddtags", F.lit(",".join(tags))), ("service", F.lit(service)), ("status", status), ("message", "summary"), ("timestamp", "ts_ms"), ("attributes", attributes))))


def syslog(host: str, app: str, facility: int = 16) -> Column:
    if not 0 <= facility <= 23:
        raise ValueError("a facility is 0 to 23")
    level = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 4).when(F.col("severity") == "low", 5).otherwise(6)
    known = lambda c: F.coalesce(c, F.lit("-"))
    body = F.concat(F.lit("["), F.col("category"), F.lit("] "), F.upper("action"), F.lit(": "), F.col("title"), F.lit(" | rule="), known("rule_name"), F.lit(" tool="), known("tool_name"), F.lit(" severity="), F.col("severity"))
    line = F.concat(F.lit("<"), (level + facility * 8).cast("string"), F.lit(">1 "), iso(F.col("ts_ms")), F.lit(f" {host} {app} - - - "), body)
    return F.regexp_replace(line, r"[\x00-\x1f\x7f]", "")


def hook_text() -> Column:
    return F.concat_ws("\n", F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("title")), "description", F.concat(F.lit("rule: "), F.coalesce("rule_name", F.lit("?"))))


def deliver(payloads: DataFrame, url: str, headers: dict[str, str] | None = None, retries: int = 2, private: bool = False) -> DataFrame:
    """Posts a column named payload, a partition at a time; returns what wasn't taken: payload, error.

    A receiver that fails is tried again, later and later. Receivers on private hosts are refused unless `private`.
    A task that runs again sends its rows again: receivers tell repeats by the ids that payloads carry.
    """
    if not private and not payloads.sparkSession.range(1).select(is_public(F.lit(url))).first()[0]:
        raise ValueError(f"not a public address: {url}")

    def post(payload: str) -> str | None:
        said = None
        for attempt in range(retries + 1):
            try:
                ask = urllib.request.Request(url, payload.encode(), {"Content-Type": "application/json"} | (headers or {}))
                urllib.request.urlopen(ask, timeout=5).close()
                return None
            except OSError as e:
                said = str(e)
                if attempt < retries:
                    time.sleep(min(0.5 * 2**attempt, 10) * (0.5 + random.random() / 2))
        return said

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["error"] = [post(p) for p in batch.payload]
            yield batch[batch.error.notna()]

    return saved(payloads.select("payload").where("payload is not null").mapInPandas(send, "payload string, error string"), "undelivered")


def fan_out(alerts: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> dict[str, str | None]:
    """All sinks over one computed batch; the failure of one doesn't reach the others."""
    rows, said = alerts.persist(), {}
    for name, sink in sinks.items():
        try:
            sink(rows)
            said[name] = None
        except Exception as e:  # each sink is on its own
            said[name] = str(e)
    rows.unpersist()
    return said


#: Folders that logs don't go to.
SYSTEM = ("/etc", "/bin", "/sbin", "/usr", "/boot", "/dev", "/proc", "/sys", "/lib", "/root/.ssh")


def append_jsonl(events: DataFrame, path: str) -> None:
    """Appends events as lines of JSON to a folder outside those of the system, however its path is spelled."""
    plain = posixpath.normpath("/" + re.sub(r"(?i)^file:", "", path).lstrip("/"))
    if (path.startswith("/") or re.match(r"(?i)^file:", path) or ".." in path.split("/")) and any(plain == p or plain.startswith(p + "/") for p in SYSTEM):
        raise ValueError(f"not a place for logs: {path}")
    events.write.mode("append").json(path)
