"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, spread_join


#: Edges up to which a node's own ones may be all in one task.
FEW_EDGES = 1_000_000


def _with_least(rows: DataFrame, least: DataFrame, many: bool) -> DataFrame:
    return spread_join(rows, cut(least), "u") if many else rows.join(least.drop("n"), "u")


def _large_star(edges: DataFrame, many: bool) -> DataFrame:
    """Connect each node's larger neighbours to the least of it and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return _with_least(both.filter("v > u"), least, many).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, many: bool) -> DataFrame:
    """Connect each node and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(down, least, many).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (u, v); component is the least node reachable.

    Edges with a null end and loops are left out; an empty table gives an empty result.
    Every round is cut; only a count and a checksum reach the
    driver. Of many edges, a node that has very many of them is joined by broadcast,
    and its edges stay dealt out.
    """
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    seen = edges.agg(F.count("*"), mark).first()
    while seen[0]:
        many = seen[0] > FEW_EDGES
        edges = cut(_small_star(_large_star(edges, many).distinct(), many).distinct())
        now = edges.agg(F.count("*"), mark).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
