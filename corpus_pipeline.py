"""The corpus pipeline: quality rules, exact and near deduplication, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the
columns of documents; the last returns the packed pieces. Both deduplications judge rows by a key of
their own: rows that repeat or lack an id are rows like others, and of equal rows one stays. Null texts fail the quality rules, so no
stage after them sees one in run(); each stage by itself handles them as its operator does.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.llm import exact_dedup, ngram_join, packing, pii, quality
from sparkward.llm.common import fresh, saved, table, with_row_key
from sparkward.llm.queries import PII_KEY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judged(docs, table(spark, sf_dir, "labels"), carry=True).where("kept").select("_row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = fresh(docs, "_key")
    docs = with_row_key(docs, key)
    stays = exact_dedup.exact_groups(docs, key=key).where("kept").select(key)
    return docs.join(stays, key, "left_semi").drop(key)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays, any one of equal ids."""
    key = fresh(docs, "_key")
    docs = with_row_key(docs, key)
    stays = ngram_join.linked(docs.select(F.col(key).alias("doc_id"), "text")).where("component_id = doc_id")
    return docs.join(stays.select(F.col("doc_id").alias(key)), key, "left_semi").drop(key)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replaced(docs, PII_KEY).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("pii_surrogates", replace_personal_data),
    ("packing", pack_sequences),
]

#: The later stages can't be put in SQL (tokens, keyed surrogates); tests hold each against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
