"""Boxes: algebra as columns, and joins of overlapping boxes through a grid.

A box is a struct of x, y, x2, y2 with x <= x2 and y <= y2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EMPTY = 0.0


def box(x, y, x2, y2) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).cast("double").alias(n) for c, n in zip((x, y, x2, y2), ("x", "y", "x2", "y2"), strict=True)])


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x"], F.lit(EMPTY)) * F.greatest(b["y2"] - b["y"], F.lit(EMPTY))


def overlap(a: Column, b: Column) -> Column:
    """Area of the intersection."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(EMPTY)) * F.greatest(h, F.lit(EMPTY))


def covered(a: Column, b: Column) -> Column:
    """Share of the first box that lies in the second; 0 for one without area."""
    return F.when(area(a) > 0, overlap(a, b) / area(a)).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where there's no union."""
    union = area(a) + area(b) - overlap(a, b)
    return F.when(union > 0, overlap(a, b) / union).otherwise(F.lit(0.0))


def y_overlap(a: Column, b: Column) -> Column:
    """Common height over the lower of both heights."""
    common = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y"], b["y"]), F.lit(0.0))
    low = F.least(a["y2"] - a["y"], b["y2"] - b["y"])
    return F.when(low > 0, common / low).otherwise(F.lit(0.0))


def contains(a: Column, b: Column, slack: float = 0.0) -> Column:
    return (a["x"] <= b["x"] + slack) & (a["y"] <= b["y"] + slack) & (a["x2"] >= b["x2"] - slack) & (a["y2"] >= b["y2"] - slack)


def gap(a: Column, b: Column) -> Column:
    """Distance between the nearest points of two boxes."""
    dx = F.greatest(a["x"] - b["x2"], b["x"] - a["x2"], F.lit(0.0))
    dy = F.greatest(a["y"] - b["y2"], b["y"] - a["y2"], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def union(boxes: DataFrame, keys: list[str], b: str = "box") -> DataFrame:
    """The bounding box of each key's boxes."""
    c = F.col(b)
    return boxes.groupBy(*keys).agg(F.struct(F.min(c["x"]).alias("x"), F.min(c["y"]).alias("y"), F.max(c["x2"]).alias("x2"), F.max(c["y2"]).alias("y2")).alias(b))


def _cells(b: Column, cell: float) -> Column:
    """Grid cells that a box touches; its far edges count, so touching boxes meet in a cell."""
    side = lambda lo, hi: F.sequence(F.floor(lo / cell), F.floor(hi / cell))
    return F.flatten(F.transform(side(b["x"], b["x2"]), lambda i: F.transform(side(b["y"], b["y2"]), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], cell: float, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs of overlapping boxes of equal keys, each once.

    Boxes go to the grid cells that they touch and meet by equi-join; a pair
    counts in the cell of its intersection's lower corner only, so no distinct
    is needed.
    """
    left = left.withColumn("_cell", F.explode(_cells(F.col(a), cell)))
    right = right.withColumn("_cell", F.explode(_cells(F.col(b), cell)))
    pairs = left.join(right, [*keys, "_cell"])
    corner = F.struct(F.floor(F.greatest(F.col(a)["x"], F.col(b)["x"]) / cell).alias("i"), F.floor(F.greatest(F.col(a)["y"], F.col(b)["y"]) / cell).alias("j"))
    return pairs.filter((overlap(F.col(a), F.col(b)) > 0) & (F.col("_cell") == corner)).drop("_cell")


def best_match(pairs: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return pairs.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, lo: str, hi: str, width: int) -> DataFrame:
    """Rows of left with the right ranges [lo, hi] that hold ``at``, by ranges of ``width``."""
    left = left.withColumn("_r", F.floor(F.col(at) / width))
    right = right.withColumn("_r", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return left.join(right, [*keys, "_r"]).filter((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))).drop("_r")


def coverage_gaps(boxes: DataFrame, keys: list[str], lo: Column, hi: Column) -> DataFrame:
    """Stretches between the first and last edge that no [lo, hi) covers, by a sweep over edges."""
    edges = boxes.select(*keys, F.explode(F.array(F.struct(lo.alias("p"), F.lit(1).alias("d")), F.struct(hi.alias("p"), F.lit(-1).alias("d")))).alias("e"))
    points = edges.groupBy(*keys, F.col("e.p").alias("p")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("p")
    open_ = points.withColumn("depth", F.sum("d").over(w)).withColumn("next", F.lead("p").over(w))
    return open_.filter("depth = 0 and next is not null").select(*keys, F.col("p").alias("lo"), F.col("next").alias("hi"))
