"""Rules that users declare: reading them, checking them, and their plan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.regex import compiled
from ..schema import CATEGORIES, SEVERITIES, event_id


def scalar(text: str):
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"-?\d{1,15}", text):
        return int(text)
    return float(text) if len(text) <= 20 and re.fullmatch(r"-?\d+\.\d+", text) else text


def parsed(text: str) -> dict:
    """Maps nested by indentation and lists of strings, as rule files have them; not YAML at large."""
    if len(text) > 1_000_000:
        raise ValueError("a rule file has a million characters at most")
    top: dict = {}
    stack: list[tuple[int, dict]] = [(-1, top)]
    last: tuple[dict, str] | None = None
    for line in text.split("\n")[:10_000]:
        body = re.sub(r"(^|\s)#.*$", "", line) if not re.search(r"[\"'].*#.*[\"']", line) else line
        if not body.strip():
            continue
        indent = len(body) - len(body.lstrip(" "))
        body = body.strip()
        if body.startswith("- "):
            if last:
                held = last[0].setdefault(last[1], []) if isinstance(last[0].get(last[1]), list) else last[0].__setitem__(last[1], []) or last[0][last[1]]
                item = body[2:].strip()
                held.append(item[1:-1] if len(item) >= 2 and item[0] == item[-1] and item[0] in "\"'" else item)
            continue
        name, colon, value = body.partition(":")
        if not colon or len(name) > 200 or len(stack) > 20:
            continue
        while stack[-1][0] >= indent:
            stack.pop()
        name = name.strip().strip("\"'")
        if value.strip():
            stack[-1][1][name] = scalar(value[:10_000])
            last = None
        else:
            stack[-1][1][name] = child = {}
            last = (stack[-1][1], name)
            stack.append((indent, child))
    return top


def rule_of(doc: dict) -> dict:
    """A checked rule, or ValueError: four texts, known severity and category, lists of expressions."""
    for name in ("name", "description", "severity", "category"):
        if not isinstance(doc.get(name), str) or not doc[name]:
            raise ValueError(f"{name} is missing")
    if doc["severity"] not in SEVERITIES or doc["category"] not in CATEGORIES:
        raise ValueError("unknown severity or category")
    match = doc.get("match") if isinstance(doc.get("match"), dict) else {}
    listed = lambda v: [x for x in v if isinstance(x, str)] if isinstance(v, list) else []
    params = match.get("params") if isinstance(match.get("params"), dict) else {}
    return {
        "name": doc["name"], "description": doc["description"], "severity": doc["severity"], "category": doc["category"], "should_block": doc.get("shouldBlock") is True,
        "tool_name": match.get("toolName") if isinstance(match.get("toolName"), str) else None,
        "params": {k: listed(v) for k, v in params.items() if listed(v)}, "any_param": listed(match.get("any_param")),
    }


def rules_of(text: str) -> list[dict]:
    """Rules of a file of several documents; bad ones are skipped."""
    out = []
    for doc in re.split(r"(?m)^---\s*$", text):
        try:
            out.append(rule_of(parsed(doc)))
        except ValueError:
            continue
    return out


def declared(calls: DataFrame, rule: dict) -> DataFrame:
    """Events of one declared rule. Expressions that aren't admissible are left out, as if not given."""
    some = lambda xs: [(x, c) for x in xs if (c := compiled(x))]
    tool = compiled(rule["tool_name"]) if rule.get("tool_name") else None
    named = {k: some(v) for k, v in rule.get("params", {}).items()}
    named = {k: v for k, v in named.items() if v}
    anywhere = some(rule.get("any_param", []))
    rows = calls.where(F.col("tool_name").rlike(tool)) if tool else calls
    hit = F.lit(None).cast("struct<place:string,pattern:string>")
    found = lambda place, pattern: F.struct(place.alias("place"), F.lit(pattern).alias("pattern"))
    if anywhere or named:
        rows = T.once(rows, "texts", T.reader(T.any_param)("params"))
        best = lambda x, i: F.array_min(F.array_compact(F.array(*[F.when(x["chunk"].rlike(c), F.struct(i.alias("i"), F.lit(k).alias("k"))) for k, (_, c) in enumerate(anywhere)])))
        if anywhere:
            rows = T.once(rows, "first", F.array_min(F.array_compact(F.transform("texts", best))))
            sources = F.array(*[F.lit(p) for p, _ in anywhere])
            hit = F.when(F.col("first").isNotNull(), F.struct(F.element_at("texts", F.col("first.i") + 1)["raw"].alias("place"), F.element_at(sources, F.col("first.k") + 1).alias("pattern")))
        for k, expressions in reversed(named.items()):
            value = F.get_json_object("params", f"$['{k}']")
            for p, c in reversed(expressions):
                hit = F.when(value.rlike(c), found(F.lit(k), p)).otherwise(hit)
    elif tool:
        hit = found(F.lit("toolName"), rule["tool_name"])
    rows = rows.withColumn("hit", hit).where("hit is not null")
    block = bool(rule.get("should_block"))
    title = f"[{rule['name']}] {rule['description']}"
    text = F.concat(F.lit("自定义规则匹配: "), F.col("hit.place"), F.lit(" 匹配模式 /"), F.col("hit.pattern"), F.lit("/"))
    details = F.to_json(F.struct(F.lit(rule["name"]).alias("rule"), F.col("hit.place").alias("paramKey"), F.col("hit.pattern").alias("pattern"), F.col("tool_name").alias("toolName")))
    return rows.select(
        "seq", event_id(F.col("seq"), F.lit(rule["name"])).alias("id"), "ts_ms", F.lit(rule["category"]).alias("category"), F.lit(rule["severity"]).alias("severity"),
        F.lit(title).alias("title"), text.alias("description"), details.alias("details"), "tool_name", F.col("params").alias("tool_params"), "skill_name", "session_id",
        "agent_id", F.lit(rule["name"]).alias("rule_name"), F.col("hit.pattern").alias("matched_pattern"), F.lit("blocked" if block else "alert").alias("action"), F.lit(block).alias("should_block"),
    )
