"""One configuration's plan: calls to events, decisions and alerts."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect, policy, routing, rules, stateful
from ..schema import event_id
from ..shared import saved


@dataclass
class Config:
    block_on_critical: bool = True
    max_calls_per_minute: float | None = 60
    enable_rate: bool = True
    enable_baseline: bool = True
    trusted_skills: list[str] = field(default_factory=list)
    sensitive_paths: list[str] = field(default_factory=list)
    blocked_domains: list[str] = field(default_factory=list)
    declared: list[dict] = field(default_factory=list)
    disabled_rules: list[str] = field(default_factory=list)
    force_block: list[str] = field(default_factory=list)


def stateful_events(calls: DataFrame, found: DataFrame, rule: str, category: str, title: str) -> DataFrame:
    """Events of a stateful rule, in the columns of all others."""
    block = F.col("should_block") if "should_block" in found.columns else F.lit(False)
    some = found.select("seq", "severity", block.alias("should_block"))
    rows, no = calls.join(some, "seq"), F.lit(None).cast("string")
    return rows.select(
        "seq", event_id(F.col("seq"), F.lit(rule)).alias("id"), "ts_ms", F.lit(category).alias("category"), "severity", F.lit(title).alias("title"), F.lit(title).alias("description"),
        no.alias("details"), "tool_name", F.col("params").alias("tool_params"), "skill_name", "session_id", "agent_id", F.lit(rule).alias("rule_name"), no.alias("matched_pattern"),
        F.when(F.col("should_block"), "blocked").otherwise("alert").alias("action"), "should_block",
    )


def isolated(rules_: dict[str, Callable[[], DataFrame]]) -> tuple[list[DataFrame], dict[str, str]]:
    """(events of rules that can be planned; of the others, what is wrong): one bad rule doesn't stop the rest."""
    good, wrong = [], {}
    for name, made in rules_.items():
        try:
            rows = made()
            rows.schema  # noqa: B018  analysed here
            good.append(rows)
        except Exception as e:  # whatever a user's rule brings
            wrong[name] = str(e).split("\n")[0]
    return good, wrong


def events(calls: DataFrame, config: Config, families: tuple[str, ...] = tuple(detect.FAMILIES)) -> DataFrame:
    rows, more = detect.untrusted(calls, config.trusted_skills), []
    if config.enable_rate:
        more.append(stateful_events(rows, stateful.rate_limited(rows, config.max_calls_per_minute), "rate-limiter", "rate_anomaly", "call rate"))
    if config.enable_baseline:
        more.append(stateful_events(rows, stateful.drifted(rows), "baseline-drift", "baseline_drift", "new tool"))
    good, wrong = isolated({f"{k} {r.get('name') if isinstance(r, dict) else r}": partial(rules.declared, rows, r) for k, r in enumerate(config.declared)})
    for name, said in wrong.items():
        logging.getLogger(__name__).warning("rule %s is left out: %s", name, said)
    more += good
    found = detect.evaluate(calls, config.trusted_skills, families, tuple(more))
    return policy.applied(found, config.disabled_rules, config.force_block)


def alerts(found: DataFrame, dismissals: DataFrame, now_ms: int) -> DataFrame:
    """Alerts of events(). Found once and saved, as routing reads them several times; a call's events come one after another, by rule."""
    found = saved(found, "found")
    rules_ = (found.agg(F.max("rule_order")).first()[0] or 0) + 1
    own = found.withColumns({"_call": F.col("seq"), "seq": F.col("seq") * rules_ + F.col("rule_order")})
    return routing.routed(own, dismissals, now_ms).withColumn("seq", F.col("_call")).drop("_call")
