"""Transitive closure of pairs by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.runtime import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes of edges (u, v): the least node that each reaches."""
    both = cut(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("c")))
    while True:
        offered = both.join(labels.select(F.col("u").alias("v"), "c"), "v").select("u", "c")
        least = offered.union(labels.select("u", "c")).groupBy("u").agg(F.min("c").alias("c"))
        jumped = least.join(labels.select(F.col("u").alias("c"), F.col("c").alias("far")), "c", "left")
        new = cut(jumped.select("u", F.least("c", F.coalesce("far", "c")).alias("c")))
        if not new.join(labels.withColumnRenamed("c", "old"), "u").filter("c <> old").limit(1).count():
            return new.select(F.col("u").alias("node"), F.col("c").alias("component"))
        labels = new
