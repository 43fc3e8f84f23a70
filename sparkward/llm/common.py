"""What the operators of this subpackage share: the shared folder, tables, word splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import forget, saved  # noqa: F401

#: A word is a run of characters other than ASCII white space. Java regex.
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as plain characters, for translate().
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A name like this one that no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def ids_are_keys(docs: DataFrame) -> bool:
    """Whether each row has a doc_id and no two share one."""
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    return ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").isEmpty()


def with_row_key(docs: DataFrame, name: str = "_key") -> DataFrame:
    """docs with a key of its own for each row, a long that rises with doc_id; rows without an id come last.

    Where all ids are there and differ, the id is the key. Else the rows are sorted, numbered and saved.
    """
    own = F.col("doc_id").cast("long")
    if ids_are_keys(docs):
        return docs.withColumn(name, own)
    rows = docs.withColumn(name, F.monotonically_increasing_id()).orderBy(own.asc_nulls_last(), name)
    return saved(rows.withColumn(name, F.monotonically_increasing_id()), "keyed")


def words(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def without(text: Column, chars: str) -> Column:
    """text with every character of chars deleted."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def constant_array(values: list, kind: str) -> Column:
    """A list of bounded length as one literal, folded by the optimizer: element_at() reads it in place."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), f"array<{kind}>")


#: Bits of the filter of marked(), whatever the size of the tables.
FILTER_BITS = 1 << 21


def marked(df: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """df with a boolean column: whether its key may be one of keys (a table of one column).

    A filter of fixed size is broadcast for it; it lets more through the more keys there are, never less.
    """
    place = lambda k: F.pmod(F.xxhash64(F.col(k), F.lit("filter")), F.lit(FILTER_BITS))
    word, bit = lambda k: (place(k) / 64).cast("int"), lambda k: (place(k) % 64).cast("int")
    one = keys.columns[0]
    marks = keys.select(word(one).alias("_word"), bit(one).alias("bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("_bits"))
    known = df.withColumn("_word", word(key)).join(F.broadcast(marks), "_word", "left")  # FILTER_BITS / 64 rows at most
    return known.withColumn(name, F.getbit(F.coalesce("_bits", F.lit(0).cast("long")), bit(key)) == 1).drop("_word", "_bits")
