"""Quality rules: base rules, and a log-likelihood ratio of hashed n-grams, in DataFrame operations.

Two multinomials over hashed n-grams (the last three characters of each word and of the word before
it) are counted: one over labelled trusted documents, one over all documents. A document's
score is the mean over its n-grams of the log ratio of the two, with SMOOTH expected counts on either
side. It is kept if it passes the base rules and scores at least THRESHOLD: the same decision for the
same document at any size of table.

Null and empty texts have no words and fail the base rules. Every row gets a row, repeated ids
included. Without trusted documents the ratio is zero and every document that passes the base rules
stays. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, constant_array, saved, without, words

BUCKETS = 1 << 16
#: Trusted documents that are used at most (those with the smallest hash of their id), so that the
#: list of their ids can be sent to all workers: 160 KB.
TRUSTED = 20_000
SMOOTH = 10.0
#: Nats a n-gram. Documents of the corpus' own kind score about 0.
THRESHOLD = -0.2
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def with_ngrams(rows: DataFrame) -> DataFrame:
    """Adds grams, the bucket of each word with the word before it, from w."""
    rows = rows.withColumn("ends", F.transform("w", lambda x: F.xxhash64(F.substring(x, -3, 3))))
    before = F.slice(F.concat(F.array(F.lit(0).cast("long")), "ends"), F.lit(1), F.size("ends"))
    return rows.withColumn("grams", F.zip_with(before, "ends", lambda x, y: F.pmod(F.xxhash64(x, y), F.lit(BUCKETS)).cast("int"))).drop("ends")


def ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """The log ratio of each bucket: BUCKETS numbers, whatever the size of the table."""
    trusted = (
        labels.where("quality = 1").select(F.col("doc_id").alias("trusted_id")).distinct().orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(TRUSTED)
    )
    counts = (
        with_ngrams(docs.select("doc_id", words(F.col("text")).alias("w")))
        .join(F.broadcast(trusted), F.col("doc_id") == F.col("trusted_id"), "left")
        .select(F.col("trusted_id").isNotNull().cast("long").alias("trusted"), F.explode("grams").alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("trusted").alias("target"))
        .collect()  # BUCKETS rows at most
    )
    raw, target = sum(r.raw for r in counts), sum(r.target for r in counts)
    out = [0.0] * BUCKETS
    for r in counts:
        expected = r.raw * target / raw
        out[r.bucket] = round(math.log((r.target + SMOOTH) / (expected + SMOOTH)), 6)
    return out


def adjacent(keys: str, step: int) -> Column:
    """Each key with the one `step` behind it, hashed together: an array shorter by step."""
    n = F.greatest(F.size(keys) - step, F.lit(0))
    return F.zip_with(F.slice(keys, F.lit(1), n), F.slice(keys, F.lit(step + 1), n), lambda x, y: F.xxhash64(x, y))


def twice(entries: str) -> Column:
    """Of sorted (key, at) those whose key is another's too."""
    same = lambda s, i, step: F.coalesce(F.get(entries, i + step)["key"] == s["key"], F.lit(False))
    return F.filter(entries, lambda s, i: same(s, i, F.lit(-1)) | same(s, i, F.lit(1)))


def repeated_words(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words from w. Windows are compared by hash, and where hashes repeat by their words."""
    rows = rows.withColumn("keys", F.transform("w", lambda x: F.xxhash64(x)))
    for step in (1, 2, 4):  # WINDOW words, by doubling
        rows = rows.withColumn("keys", adjacent("keys", step))
    none = lambda kind: F.array().cast(f"array<struct<key:{kind},at:int>>")
    repeats = F.size(F.array_distinct("keys")) < F.size("keys")
    listed = F.sort_array(F.transform("keys", lambda k, i: F.struct(k.alias("key"), i.alias("at"))))
    rows = rows.withColumn("listed", F.when(repeats, listed).otherwise(none("bigint"))).withColumn("listed", twice("listed"))
    read = F.sort_array(F.transform("listed", lambda s: F.struct(F.array_join(F.slice("w", s["at"] + 1, WINDOW), " ").alias("key"), s["at"].alias("at"))))
    rows = rows.withColumn("listed", F.when(F.size("listed") > 0, read).otherwise(none("string")))
    rows = rows.withColumn("starts", F.sort_array(F.transform(twice("listed"), lambda s: s["at"])))
    # Each start adds WINDOW words, less what the next one covers too.
    gaps = F.transform("starts", lambda a, i: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", i + 1) - a, F.lit(WINDOW))))
    return rows.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda x, y: x + y)).drop("keys", "listed", "starts")


def judged(docs: DataFrame, labels: DataFrame, carry: bool = False) -> DataFrame:
    """One row a document: doc_id, the base figures, base_failed, score, kept; with carry its row as _row."""
    text = F.coalesce("text", F.lit(""))
    weights = constant_array(ratios(docs, labels), "double")
    row = [F.struct("*").alias("_row")] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row, text.alias("_text"), words(F.col("text")).alias("w"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))
    rows = repeated_words(
        rows.withColumns(
            {
                "n_words": F.size("w").cast("long"),
                "word_chars": F.length(F.array_join("w", "")).cast("long"),
                "n_symbols": (F.length("_text") - F.length(without(F.col("_text"), SYMBOLS))).cast("long"),
                "lines": lines,
            }
        )
    )
    rows = with_ngrams(rows)
    total = F.aggregate("grams", F.lit(0.0), lambda x, b: x + F.element_at(weights, b + 1))
    score = F.round(total / F.greatest(F.size("grams"), F.lit(1)), 6)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    kept = ~failed & (score >= THRESHOLD)
    out = rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        failed.alias("base_failed"),
        score.alias("score"),
        kept.alias("kept"),
        *(["_row"] if carry else []),
    )
    # A filter on the verdict then reads it, instead of having all of its columns written into the filter.
    return saved(out, "verdicts")
