"""Keyed upserts over DataFrames: latest wins, guarded columns, patches, append logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in an append log; the whole row counts, nulls too."""
    best = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def merged(old: DataFrame, new: DataFrame, keys: list[str], updates: list[str] | None = None) -> DataFrame:
    """Rows of ``new`` over those of ``old``; of keys in both only ``updates`` (all columns, if None) change."""
    columns = [c for c in old.columns if c not in keys]
    taken = columns if updates is None else updates
    a = old.select(*keys, *[F.col(c).alias(f"o_{c}") for c in columns], F.lit(True).alias("_old"))
    b = new.select(*keys, *[F.col(c).alias(f"n_{c}") for c in columns], F.lit(True).alias("_new"))
    both = a.join(b, keys, "full")
    pick = lambda c: F.when(F.col("_new") & (F.lit(c in taken) | F.col("_old").isNull()), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c)
    return both.select(*keys, *[pick(c) for c in columns])


def patched(log: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Changes folded by key: each column's last value that was given; ``given`` holds the names a change sets, null values among them."""
    at = F.struct(*order)
    return log.groupBy(*keys).agg(*[F.max_by(F.col(c), F.when(F.array_contains("given", c), at)).alias(c) for c in columns])
