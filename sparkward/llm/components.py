"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id that it reaches) of every id in edges (a, b)."""
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels.id == near.a).select("id", "component", F.least("component", "near").alias("low"))
        # The label of the label: halves the distance to the smallest id.
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("lowest"))
        after = lower.join(jump, "low", "left").select("id", "component", F.coalesce("lowest", "low").alias("next"))
        moved = saved(after, "labels")
        labels = moved.select("id", F.col("next").alias("component"))
        if moved.where("next <> component").isEmpty():
            return labels
