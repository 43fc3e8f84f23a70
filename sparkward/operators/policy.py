"""Policies that inherit: chains, what they come to, templates, import and export."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import saved

DEEPEST = 10
SCHEMA = "name string, description string, extends string, config map<string,string>, yaml_rules string, trusted array<string>, force_block array<string>, disabled array<string>"
#: Templates as (name, description, settings, rules that always block).
TEMPLATES = (
    ("permissive", "宽松策略：仅告警，不阻断任何操作", {"blockOnCritical": "false", "debug": "false"}, []),
    ("standard", "标准策略：自动阻断 critical 级别威胁", {"blockOnCritical": "true", "maxToolCallsPerMinute": "60", "enableBaseline": "true"}, []),
    (
        "strict", "严格策略：阻断所有威胁，启用全部检测，限速 30 次/分钟", {"blockOnCritical": "true", "maxToolCallsPerMinute": "30", "enableBaseline": "true"},
        ["exec-guard", "path-guard", "network-guard", "prompt-injection", "data-exfil"],
    ),
)
NAME = r"[\w\-.]{1,100}"


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, d, None, config, None, [], force, []) for n, d, config, force in TEMPLATES], SCHEMA)


def put(policies: DataFrame, changes: DataFrame) -> DataFrame:
    """Policies added, or put in the place of those of their names; names that aren't fit are left out."""
    fit = changes.where(F.col("name").rlike(rf"^{NAME}\z"))
    return policies.join(fit.select("name"), "name", "left_anti").unionByName(fit)


def removed(policies: DataFrame, names: list[str]) -> DataFrame:
    return policies.where(~F.col("name").isin(names)) if names else policies


def chains(policies: DataFrame) -> DataFrame:
    """leaf, name, depth (0 for the leaf), status of each policy's chain: ok, cycle, missing or deep.

    Policies are a managed list; each level of inheritance is a join of it with itself.
    """
    parents = policies.select(F.col("name").alias("p_name"), F.col("extends").alias("p_extends"))
    level = policies.select(F.col("name").alias("leaf"), "name", F.lit(0).alias("depth"), F.col("extends").alias("next"), F.array("name").alias("seen"), F.lit("ok").alias("status"))
    for depth in range(1, DEEPEST + 1):
        level = saved(level, "policy-level")
        out = level if depth == 1 else out.unionByName(level)
        open_ = level.where("status = 'ok' and next is not null")
        if open_.isEmpty():
            break
        up = open_.join(parents, F.col("next") == F.col("p_name"), "left")
        status = F.when(F.array_contains("seen", F.col("next")), "cycle").when(F.col("p_name").isNull(), "missing").when(F.lit(depth >= DEEPEST), "deep").otherwise("ok")
        level = up.select("leaf", F.col("next").alias("name"), F.lit(depth).alias("depth"), F.col("p_extends").alias("next"), F.concat("seen", F.array("next")).alias("seen"), status.alias("status"))
    else:
        out = out.unionByName(level)
    return out.select("leaf", "name", "depth", "status")


def effective(policies: DataFrame) -> DataFrame:
    """leaf, config (JSON by key, the nearest policy wins), trusted, force_block, disabled, of chains without error."""
    found = chains(policies)
    wrong = found.where("status <> 'ok'").select("leaf").distinct()
    good = found.join(wrong, "leaf", "left_anti").join(policies.drop("extends", "description"), "name")
    pairs = good.select("leaf", "depth", F.explode_outer("config").alias("key", "value")).where("key is not null")
    near = pairs.groupBy("leaf", "key").agg(F.min_by("value", "depth").alias("value"))
    config = near.groupBy("leaf").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))).alias("config"))
    ordered = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), F.coalesce(c, F.array().cast("array<string>")).alias("x")))), lambda s: s["x"])))
    lists = good.groupBy("leaf").agg(ordered("trusted").alias("trusted"), ordered("force_block").alias("force_block"), ordered("disabled").alias("disabled"))
    return lists.join(config, "leaf", "left")


def applied(events: DataFrame, disabled: list[str], force_block: list[str]) -> DataFrame:
    """Events under a policy: disabled rules fall away, forced ones block."""
    among = lambda names: F.coalesce(F.col("rule_name").isin(names), F.lit(False)) if names else F.lit(False)  # noqa: E731  events may be of no rule
    rows, force = events.where(~among(disabled)), among(force_block)
    return rows.withColumn("should_block", F.col("should_block") | force).withColumn("action", F.when(F.col("should_block"), "blocked").otherwise("alert"))


def applied_by_leaf(events: DataFrame, policies: DataFrame) -> DataFrame:
    """Events (with leaf, the policy that each is under) as their policies leave them; a leaf without a sound policy changes nothing."""
    rules = effective(policies).select("leaf", "disabled", "force_block")
    none = F.array().cast("array<string>")
    rows = events.join(rules, "leaf", "left").where(~F.coalesce(F.array_contains(F.coalesce("disabled", none), F.col("rule_name")), F.lit(False)))
    force = F.coalesce(F.array_contains(F.coalesce("force_block", none), F.col("rule_name")), F.lit(False))
    rows = rows.withColumn("should_block", F.col("should_block") | force)
    return rows.withColumn("action", F.when(F.col("should_block"), "blocked").otherwise("alert")).drop("disabled", "force_block")


def imported(exports: DataFrame, known: DataFrame) -> DataFrame:
    """Policies of exports (source, text): source, place, name, extends, reason; null where it holds up, else what is wrong.

    Reasons: format (no list of policies), name, config, overrides, parent (none of its name is known or holds up; those
    that extend it fall too). Of one source's policies of the same name the last counts, if it holds up.
    """
    get = lambda p: F.try_variant_get("p", p, "variant")
    kind = lambda p: F.coalesce(F.schema_of_variant(get(p)), F.lit(""))
    absent = lambda p: ~F.array_contains(F.coalesce(F.json_object_keys(F.to_json(F.col("p"))), F.array()), p)
    strings = lambda p: kind(p).isin("", "ARRAY<STRING>", "ARRAY<VOID>") & ((kind(p) != "ARRAY<VOID>") | (F.to_json(get(p)) == "[]"))
    list_ = F.try_variant_get(F.try_parse_json("text"), "$.policies", "array<variant>")
    rows = exports.select("source", F.posexplode_outer(list_).alias("place", "p"))
    name = F.when(kind("$.name") == "STRING", F.try_variant_get("p", "$.name", "string"))
    config = (absent("config") | F.startswith(kind("$.config"), F.lit("OBJECT"))) & strings("$.config.trustedSkills") & kind("$.config.blockOnCritical").isin("", "BOOLEAN")
    over = strings("$.overrides.forceBlock") & strings("$.overrides.disabledRules") & strings("$.overrides.additionalTrustedSkills")
    reason = F.when(F.col("place").isNull(), "format").when(~F.coalesce(name.rlike(rf"^{NAME}\z"), F.lit(False)), "name").when(~config, "config").when(~over, "overrides")
    rows = saved(rows.select("source", "place", name.alias("name"), F.try_variant_get("p", "$.extends", "string").alias("extends"), reason.alias("reason")), "imports")
    good = rows.where("reason is null and extends is not null and extends <> ''").join(known.select(F.col("name").alias("extends")), "extends", "left_anti")
    fallen = None  # (source, name) of those whose parents are nowhere, in rounds until there are no more
    while True:
        there = rows.where("reason is null").select("source", F.col("name").alias("extends"))
        there = there if fallen is None else there.join(fallen.withColumnRenamed("name", "extends"), ["source", "extends"], "left_anti")
        now = saved(good.join(there, ["source", "extends"], "left_anti").select("source", "name").distinct(), "fallen")
        if fallen is not None and now.count() == fallen.count():
            break
        fallen = now
    marks = fallen.withColumn("lost", F.lit("parent"))
    return rows.join(marks, ["source", "name"], "left").select("source", "place", "name", "extends", F.coalesce("reason", "lost").alias("reason"))


def import_(text: str) -> tuple[dict[str, dict], int]:
    """Policies of an export that hold up, and how many don't. Those whose parent falls away fall too."""
    given, kept, skipped = json.loads(text).get("policies", []), {}, 0
    strings = lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v)
    for p in given:
        over = p.get("overrides", {}) if isinstance(p, dict) else None
        ok = isinstance(p, dict) and isinstance(p.get("name"), str) and re.fullmatch(NAME, p["name"]) and isinstance(p.get("config", {}), dict)
        ok = ok and isinstance(over, dict) and all(strings(v) for v in over.values()) and strings(p.get("config", {}).get("trustedSkills", []))
        if ok:
            kept[p["name"]] = p
        else:
            skipped += 1
    while orphans := [n for n, p in kept.items() if p.get("extends") and p["extends"] not in kept]:
        for n in orphans:
            del kept[n]
        skipped += len(orphans)
    return kept, skipped


def export(policies: DataFrame) -> DataFrame:
    """All policies, by name, as one text of JSON: a managed list."""
    by_name = lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)
    rows = F.array_sort(F.collect_list(F.struct(*policies.columns)), by_name)
    return policies.agg(F.to_json(F.struct(rows.alias("policies"))).alias("json"))
