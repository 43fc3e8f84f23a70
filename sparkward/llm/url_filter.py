"""URL filtering: listed rules first, else association rules that FP-growth mines from labelled URLs.

A URL is a set of tokens: host suffixes by level, host label parts, path segments, query keys, scheme.
Labelled pages that are bad carry one more item, and FP-growth finds the combinations that go with it.
Labels are given by page; where none are given the listed rules label the pages that they fit, so that what
is mined carries them on to pages of other hosts and paths. Tokens that lie on the very same labelled pages
are one item, so that they don't multiply combinations. Rules under the confidence or support asked for are
pruned, and those whose confidence exceeds the share of bad labels by less than GAIN of what remains to 1: a
rule that is always right stays, whatever that share. So is any rule that is as sure without one of its
items. A page is matched by an inverted index: each rule stands under its rarest item, so that common items
join nothing, and is then held against the page's whole set.

A null URL or one without :// has an empty host and path: no listed rule fits, it has no tokens, and
it is allowed. Every row gets a row, repeated ids included. Without labels nothing is mined and what
no listed rule fits is allowed. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: (verdict, host, path)
LISTED = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BAD = "label=bad"
SUPPORT, ROWS, CONFIDENCE, GAIN = 0.001, 20, 0.6, 0.4


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def listed(host: Column, path: Column, rules=LISTED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda n: F.concat(F.lit("host="), F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")),
    )
    parts = F.transform(F.split(host, r"[.\-]"), lambda x: F.concat(F.lit("name="), x))
    words = F.filter(F.split(path, r"[/._\-]"), lambda x: x.rlike(r"[^0-9]"))
    segments = F.transform(words, lambda x: F.concat(F.lit("path="), F.lower(x)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key="), F.substring_index(x, "=", 1)))
    scheme = F.array(F.concat(F.lit("scheme="), F.lower(F.substring_index(url, "://", 1))))
    return F.when(host != "", F.array_distinct(F.concat(suffixes, parts, segments, keys, scheme))).otherwise(F.array().cast("array<string>"))


def mined(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, item: the frequent tokens and what they count as; item, rule, confidence: rules by their rarest item).

    pages: tokens, bad (null: no label). At most 1 / SUPPORT tokens a place are frequent, so the rules don't grow with pages.
    """
    labelled = pages.where("bad is not null and size(tokens) > 0").select("tokens", "bad", F.monotonically_increasing_id().alias("row"))
    labelled = saved(labelled, "labelled-urls")
    size = labelled.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
    base, least = size.bad / max(size.n, 1), max(ROWS, SUPPORT * size.n)  # a combination of under ROWS rows is chance
    places = labelled.select("row", F.explode("tokens").alias("token"))
    where = (F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit("y"))).alias("y"))
    frequent = saved(places.groupBy("token").agg(*where).where(F.col("n") >= least), "url-tokens")
    leads = frequent.groupBy("n", "x", "y").agg(F.min("token").alias("item"))
    items = saved(frequent.join(leads, ["n", "x", "y"]).select("token", "item", "n"), "url-items")
    baskets = places.join(items, "token").groupBy("row").agg(F.collect_set("item").alias("items"))
    baskets = labelled.select("row", "bad").join(baskets, "row", "left").select(F.coalesce("items", F.array().cast("array<string>")).alias("items"), "bad")
    baskets = baskets.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / max(size.n, 1)), minConfidence=CONFIDENCE).fit(baskets)
    sure = (F.element_at("consequent", 1) == BAD) & (F.col("confidence") >= base + GAIN * (1 - base))
    found = saved(model.associationRules.where(sure).select(F.array_sort("antecedent").alias("rule"), "confidence"), "url-rules")
    # A rule is pruned beside one that is as sure with an item less.
    shorter = found.select("rule", "confidence", F.explode("rule").alias("item")).select("rule", "confidence", F.array_remove("rule", F.col("item")).alias("inner"))
    covered = shorter.join(found.toDF("inner", "sure"), "inner").where("sure >= confidence").select("rule").distinct()
    kept = found.join(covered, "rule", "left_anti").select("rule", "confidence", F.explode("rule").alias("item"))
    kept = kept.join(items.select("item", "n").distinct(), "item")
    rules = kept.groupBy("rule").agg(F.min(F.struct("n", "item"))["item"].alias("item"), F.max("confidence").alias("confidence"))
    return items.select("token", "item"), rules


def filtered(pages: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, mined (the surest mined rule that matches).

    labels: page_id, bad. A page with several is bad if one of them says so.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = listed(F.col("host"), F.col("path"))
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    if labels is None:
        marked = rows.select("tokens", (F.col("listed") == "block").alias("bad"))
    else:
        marked = rows.join(labels.groupBy("page_id").agg(F.bool_or("bad").alias("bad")), "page_id").select("tokens", "bad")
    items, rules = mined(marked)
    rules = saved(rules, "url-index")
    sets = rows.where("listed is null and size(tokens) > 0").select("tokens").distinct()
    own = sets.select("tokens", F.explode("tokens").alias("token")).join(items, "token").groupBy("tokens").agg(F.collect_set("item").alias("items"))
    matched = (
        own.select("tokens", "items", F.explode("items").alias("item"))
        .join(rules, "item")
        .where(F.size(F.array_except("rule", "items")) == 0)
        .groupBy("tokens")
        .agg(F.max(F.struct("confidence", F.array_join("rule", " & ").alias("name")))["name"].alias("mined"))
    )
    # Rows that a listed rule decides, or without tokens, go round the join.
    judged, other = rows.where("listed is null and size(tokens) > 0"), rows.where("listed is not null or size(tokens) = 0")
    hits = judged.join(matched, "tokens", "left").select(*rows.columns, "mined").unionByName(other.withColumn("mined", F.lit(None).cast("string")))
    blocked = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return hits.select("page_id", "host", "path", "rule", F.coalesce("listed", blocked).alias("verdict"), "mined")
