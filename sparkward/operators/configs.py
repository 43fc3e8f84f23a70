"""Configurations of many installations: layers put over each other, and their audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that no layer sets.
RESERVED = ("__proto__", "constructor", "prototype")


def merged(layers: DataFrame) -> DataFrame:
    """installation, key, value (JSON): of layers (installation, layer, text) the highest that has the key. Texts that aren't objects of JSON have none."""
    keys = layers.select("installation", "layer", F.explode(F.from_json("text", "map<string,variant>")).alias("key", "value"))
    keys = keys.where(~F.col("key").isin(*RESERVED)).select("installation", "layer", "key", F.coalesce(F.to_json("value"), F.lit("null")).alias("value"))
    return keys.groupBy("installation", "key").agg(F.max_by("value", "layer").alias("value"))


def audited(layers: DataFrame) -> DataFrame:
    """installation, status, blocks, trusted: FAILED where its database isn't reachable, WARNING where critical findings don't block, else OK."""
    value = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    found = merged(layers).groupBy("installation").agg(value("blockOnCritical").alias("block"), value("trustedSkills").alias("trust"))
    all_ = layers.groupBy("installation").agg(F.coalesce(F.bool_and("reachable"), F.lit(False)).alias("reachable")).join(found, "installation", "left")
    count = F.coalesce(F.json_array_length("trust"), F.size(F.json_object_keys("trust")), F.lit(0)).cast("long")
    blocks = F.coalesce(F.col("block") == "true", F.lit(False))
    status = F.when(~F.col("reachable"), "FAILED").when(~blocks, "WARNING").otherwise("OK")
    return all_.select("installation", status.alias("status"), blocks.alias("blocks"), F.greatest(count, F.lit(0)).alias("trusted"))
