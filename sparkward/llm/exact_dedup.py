"""Exact deduplication through a log-structured merge index of digests, in DataFrame operations.

Each task is a memtable: its rows' digests are flushed as a run, a Parquet file sorted by digest with
a Bloom filter on it. Compaction merges the runs, keeping for each digest how many rows it has and
which row stays. Digests of more than one row set bits in a filter of fixed size; the rows that the
filter lets through are grouped by their bytes, aggregated before the shuffle, so that a text with a
third of all rows costs a row a task. Only where bytes differ under one digest are rows regrouped by
their text.

Null counts as an empty text, and empty texts are equal. Of rows that repeat or lack a document id each
is a row of its own, and one row of a group is kept; rows without an id give way to those that have one. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, marked, saved, without

RUN = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "1000000"}


def best() -> Column:
    """The row that stays: most code points, then the smallest id, then the smallest key."""
    down = lambda c: F.bitwise_not(F.col(c))
    return F.max(F.struct("n_chars", down("doc_id").alias("rank"), down("_row").alias("row"))).alias("best")


def rows(docs: DataFrame, digest: Callable[[Column], Column], key: list[str]) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *key, F.length(text).alias("n_chars"), without(text, SPACES).alias("norm"))
    return norm.withColumn("digest", digest(F.col("norm")))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = F.xxhash64, key: str | None = None) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256; and key, if docs has one of each row's own."""
    keys = [key] if key else []
    made = rows(docs, digest, keys)
    row = F.col(key) if key else F.monotonically_increasing_id()  # saved with the runs, and used from there alone
    runs = saved(
        made.select("digest", "doc_id", row.alias("_row"), "n_chars", F.unhex(F.sha2("norm", 256)).alias("sha")).sortWithinPartitions("digest"),
        "digest-runs",
        **RUN,
    )
    level = saved(runs.groupBy("digest").agg(best(), F.count("*").alias("n")), "digest-level")
    by_bytes = (
        marked(made.select("digest", "norm"), "digest", level.where("n > 1").select("digest"), "several")
        .where("several")
        .groupBy("digest", "norm")
        .agg(F.first(F.unhex(F.sha2("norm", 256))).alias("sha"))
    )
    texts = by_bytes.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1")
    different = saved(texts, "digest-collisions")
    if different.isEmpty():
        found = runs.join(level, "digest")
    else:
        one = runs.join(different, "digest", "left_anti").join(level, "digest")
        apart = runs.join(different, "digest", "left_semi")
        several = apart.join(apart.groupBy("digest", "sha").agg(best(), F.count("*").alias("n")), ["digest", "sha"])
        found = one.unionByName(several)
    keep = F.bitwise_not(F.col("best.rank"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("_row") == F.bitwise_not(F.col("best.row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *[F.col("_row").alias(k) for k in keys],
    )
