"""Page layout: spatial joins, neighbours, medians, gaps, runs of characters and lines.

The boxes are made of part and lineitem columns, with whole-number coordinates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.operators import spatial as S
from scriptorium.runtime import table

#: Parts of a page.
PAGE = 100


def chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small boxes, ``PAGE`` to a page."""
    p = table(spark, sf_dir, "part")
    x, y = (F.col("p_partkey") * 7 % 500).cast("double"), (F.col("p_partkey") * 13 % 700).cast("double")
    return p.select(F.expr(f"p_partkey div {PAGE}").alias("page"), F.col("p_partkey").alias("char_id"), "p_size", S.box(x, y, x + 5 + F.col("p_size") % 6, y + 8 + F.col("p_size") % 5).alias("a"))


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large boxes with a class, at most 2 * ``PAGE`` to a page, so pages grow in number and not in size."""
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("k")).union(table(spark, sf_dir, "customer").select(F.col("c_custkey") * 2 + 1))
    x, y = (F.col("k") * 31 % 400).cast("double"), (F.col("k") * 17 % 600).cast("double")
    kind = F.when(F.col("k") % 5 == 0, "title").when(F.col("k") % 5 == 1, "formula").when(F.col("k") % 5 == 2, "figure").otherwise("text")
    return s.select(F.expr(f"k div {2 * PAGE}").alias("page"), F.col("k").alias("layout_id"), kind.alias("class"), S.box(x, y, x + 60 + F.col("k") % 50, y + 40 + F.col("k") % 30).alias("b"))


PRIORITY = {"title": 0, "text": 1, "figure": 2}
TEXT_CLASSES = ("title", "text")


def bbox_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout of each character: least class priority (unknown classes last), then most overlap."""
    pairs = S.overlap_join(chars(spark, sf_dir), layouts(spark, sf_dir), ["page"], 50.0)
    rank = F.coalesce(F.create_map(*[F.lit(v) for kv in PRIORITY.items() for v in kv])[F.col("class")], F.lit(99))
    pairs = pairs.withColumn("share", S.covered(F.col("a"), F.col("b"))).filter("share > 0")
    return S.best_match(pairs, ["char_id"], [rank, F.desc("share"), F.col("layout_id")]).select("char_id", "layout_id", F.round("share", 6).alias("share"))


def formula_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters with over 0.4 of their box in a formula; the first such layout."""
    pairs = S.overlap_join(chars(spark, sf_dir), layouts(spark, sf_dir).filter("class = 'formula'"), ["page"], 50.0)
    return pairs.filter(S.covered(F.col("a"), F.col("b")) > 0.4).groupBy("char_id").agg(F.min("layout_id").alias("layout_id"))


def lonely_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formula layouts that no text layout overlaps by half of their area become isolated ones."""
    all_ = layouts(spark, sf_dir)
    formulas = all_.filter("class = 'formula'").select("page", "layout_id", F.col("b").alias("a"))
    texts = all_.filter(F.col("class").isin(*TEXT_CLASSES)).select("page", "b")
    inside = S.overlap_join(formulas, texts, ["page"], 50.0).filter(S.covered(F.col("a"), F.col("b")) >= 0.5).select("layout_id").distinct()
    return formulas.join(inside.withColumn("hit", F.lit(1)), "layout_id", "left").select("layout_id", F.when(F.col("hit").isNull(), "isolate_formula").otherwise("formula").alias("class"))


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of layouts of a page that overlap, with coverage and IoU."""
    all_ = layouts(spark, sf_dir)
    left = all_.select("page", F.col("layout_id").alias("i"), F.col("b").alias("a"))
    pairs = S.overlap_join(left, all_.select("page", F.col("layout_id").alias("j"), "b"), ["page"], 50.0).filter("i < j")
    return pairs.select("page", "i", "j", F.round(S.covered(F.col("a"), F.col("b")), 6).alias("covered"), F.round(S.iou(F.col("a"), F.col("b")), 6).alias("iou"), F.round(S.y_overlap(F.col("a"), F.col("b")), 6).alias("y_overlap"))


def nearest_blocker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a layout may grow to the right: the least left edge of those beside it, or 90 % of the page's width."""
    all_ = layouts(spark, sf_dir)
    me = all_.select("page", F.col("layout_id").alias("i"), F.col("b").alias("a"))
    # Boxes in one horizontal band meet in one strip of the grid.
    strip = lambda c: F.explode(F.sequence(F.floor(F.col(c)["y"] / 50), F.floor(F.col(c)["y2"] / 50)))
    pairs = me.withColumn("s", strip("a")).join(all_.withColumn("s", strip("b")), ["page", "s"])
    beside = (S.y_overlap(F.col("a"), F.col("b")) > 0) & (F.col("b")["x"] > F.col("a")["x2"])
    limit = pairs.filter(beside).groupBy("i").agg(F.min(F.col("b")["x"]).alias("x"))
    return me.join(limit, "i", "left").select("i", F.least(F.coalesce("x", F.lit(450.0)), F.lit(450.0)).alias("limit"))


def char_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median character area and the bounding box of each page."""
    rows = chars(spark, sf_dir)
    box = F.col("a")
    return rows.groupBy("page").agg(F.round(F.percentile(S.area(box), 0.5), 6).alias("median_area"), F.min(box["x"]).alias("x"), F.min(box["y"]).alias("y"), F.max(box["x2"]).alias("x2"), F.max(box["y2"]).alias("y2"))


def line_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of a page's height without any layout."""
    rows = layouts(spark, sf_dir)
    return S.coverage_gaps(rows, ["page"], F.col("b")["y"], F.col("b")["y2"])


def line_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median of the steps between a page's line positions; 10 where there are none."""
    rows = layouts(spark, sf_dir).select("page", F.col("b")["y"].alias("y"), "layout_id")
    steps = rows.withColumn("d", F.abs(F.col("y") - F.lag("y").over(Window.partitionBy("page").orderBy("layout_id"))))
    good = F.sort_array(F.collect_list(F.when(F.col("d") > 0, F.col("d"))))
    return steps.groupBy("page").agg(good.alias("ds")).select("page", F.coalesce(F.get("ds", F.floor(F.size("ds") / 2).cast("int")), F.lit(10.0)).alias("spacing"))


def paragraph_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive line items of one flag and status as runs."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_quantity")
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    starts = items.withColumn("new", F.coalesce((F.lag("l_returnflag").over(w) != F.col("l_returnflag")).cast("int"), F.lit(1)))
    runs = starts.withColumn("run", F.sum("new").over(w))
    return runs.groupBy("l_suppkey").agg(F.max("run").alias("n_runs"), F.count("*").alias("n"))


def title_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last title before each text layout of its page, and the document's first title."""
    rows = layouts(spark, sf_dir)
    w = Window.partitionBy("page").orderBy("layout_id").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.filter("class = 'title'").agg(F.min_by("layout_id", F.struct("page", "layout_id")).alias("first_title"))
    carried = rows.withColumn("title", F.last(F.when(F.col("class") == "title", F.col("layout_id")), ignorenulls=True).over(w))
    return carried.filter("class = 'text'").crossJoin(F.broadcast(first)).select("layout_id", "title", "first_title")


def page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last text of a page with the first of the next one, and texts above one another's column start."""
    rows = layouts(spark, sf_dir).filter("class = 'text'")
    ends = rows.groupBy("page").agg(F.max("layout_id").alias("last"), F.min("layout_id").alias("first"))
    after = ends.select((F.col("page") - 1).alias("page"), F.col("first").alias("next_first"))
    return ends.join(after, "page").select("page", "last", "next_first")


def scale_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most used scale, weighted by units; the least of equally used; larger ones are capped at it."""
    rows = table(spark, sf_dir, "part").select(F.bround(F.col("p_size") / 10, 1).alias("scale"))
    used = rows.groupBy("scale").agg(F.count("*").alias("n"))
    mode = used.agg(F.max_by("scale", F.struct("n", -F.col("scale"))).alias("mode"))
    return used.crossJoin(F.broadcast(mode)).groupBy(F.least("scale", "mode").alias("scale")).agg(F.sum("n").alias("n"))


def descent_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's most frequent descent, the one seen first of equals."""
    rows = chars(spark, sf_dir).withColumn("descent", -(F.col("p_size") % 4) * 10 / F.lit(1000.0))
    used = rows.groupBy("page", "descent").agg(F.count("*").alias("n"), F.min("char_id").alias("first"))
    return used.groupBy("page").agg(F.round(F.max_by("descent", F.struct("n", -F.col("first"))), 6).alias("shift"))


def space_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second least distinct gap over 1 between a page's characters; the only one if single; 0 if none."""
    rows = chars(spark, sf_dir)
    gaps = rows.withColumn("g", F.col("a")["x"] - F.lag(F.col("a")["x2"]).over(Window.partitionBy("page").orderBy("char_id")))
    distinct = F.sort_array(F.collect_set(F.when(F.col("g") > 1, F.col("g"))))
    return gaps.groupBy("page").agg(distinct.alias("gs")).select("page", F.coalesce(F.get("gs", F.lit(1)), F.get("gs", F.lit(0)), F.lit(0.0)).alias("threshold"))


def line_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts of a page aligned left within 10 and at most 30 apart, closed into groups."""
    rows = layouts(spark, sf_dir)
    grown = rows.select("page", F.col("layout_id").alias("i"), "b", S.box(F.col("b")["x"] - 30, F.col("b")["y"] - 30, F.col("b")["x2"] + 30, F.col("b")["y2"] + 30).alias("a"))
    pairs = S.overlap_join(grown.select("page", "i", "a", F.col("b").alias("own")), rows.select("page", F.col("layout_id").alias("j"), "b"), ["page"], 50.0)
    near = pairs.filter((F.col("i") < F.col("j")) & (F.abs(F.col("own")["x"] - F.col("b")["x"]) <= 10) & (S.gap(F.col("own"), F.col("b")) <= 30))
    from scriptorium.operators.graph import components

    groups = components(near.select(F.col("i").alias("u"), F.col("j").alias("v")))
    return groups.groupBy("component").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (bbox_join, formula_chars, lonely_formulas, overlap_pairs, nearest_blocker, char_medians, line_gaps, line_spacing, paragraph_runs, title_context, page_pairs, scale_mode, descent_shift, space_threshold, line_neighbours)}

_C = f"""c AS (SELECT p_partkey // {PAGE} AS page, p_partkey AS char_id, p_size, (p_partkey * 7 % 500)::DOUBLE AS x, (p_partkey * 13 % 700)::DOUBLE AS y,
        (p_partkey * 7 % 500 + 5 + p_size % 6)::DOUBLE AS x2, (p_partkey * 13 % 700 + 8 + p_size % 5)::DOUBLE AS y2 FROM part)"""
_L = f"""k AS (SELECT s_suppkey * 2 AS k FROM supplier UNION ALL SELECT c_custkey * 2 + 1 FROM customer),
        l AS (SELECT k // {2 * PAGE} AS page, k AS layout_id, CASE k % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'formula' WHEN 2 THEN 'figure' ELSE 'text' END AS class, (k * 31 % 400)::DOUBLE AS x, (k * 17 % 600)::DOUBLE AS y,
        (k * 31 % 400 + 60 + k % 50)::DOUBLE AS x2, (k * 17 % 600 + 40 + k % 30)::DOUBLE AS y2 FROM k)"""
_OV = "greatest(least(a.x2, b.x2) - greatest(a.x, b.x), 0) * greatest(least(a.y2, b.y2) - greatest(a.y, b.y), 0)"
_AR = "((a.x2 - a.x) * (a.y2 - a.y))"
ORACLE_SQL = {
    "bbox_join": f"""WITH {_C}, {_L}, p AS (SELECT a.char_id, b.layout_id, b.class, {_OV} / {_AR} AS share FROM c a JOIN l b ON a.page = b.page AND {_OV} > 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY char_id ORDER BY CASE class WHEN 'title' THEN 0 WHEN 'text' THEN 1 WHEN 'figure' THEN 2 ELSE 99 END, share DESC, layout_id) AS n FROM p)
        SELECT char_id, layout_id, round(share, 6) AS share FROM r WHERE n = 1""",
    "formula_chars": f"WITH {_C}, {_L} SELECT a.char_id, min(b.layout_id) AS layout_id FROM c a JOIN l b ON a.page = b.page AND b.class = 'formula' AND {_OV} / {_AR} > 0.4 GROUP BY a.char_id",
    "lonely_formulas": f"""WITH {_L} SELECT a.layout_id, CASE WHEN EXISTS (SELECT 1 FROM l b WHERE b.page = a.page AND b.class IN ('title', 'text') AND {_OV} / {_AR} >= 0.5) THEN 'formula' ELSE 'isolate_formula' END AS class
        FROM l a WHERE a.class = 'formula'""",
    "overlap_pairs": f"""WITH {_L} SELECT a.page, a.layout_id AS i, b.layout_id AS j, round({_OV} / {_AR}, 6) AS covered, round({_OV} / ({_AR} + (b.x2 - b.x) * (b.y2 - b.y) - {_OV}), 6) AS iou,
        round(greatest(least(a.y2, b.y2) - greatest(a.y, b.y), 0) / least(a.y2 - a.y, b.y2 - b.y), 6) AS y_overlap FROM l a JOIN l b ON a.page = b.page AND a.layout_id < b.layout_id AND {_OV} > 0""",
    "nearest_blocker": f"""WITH {_L} SELECT a.layout_id AS i, least(coalesce(min(b.x), 450), 450) AS "limit" FROM l a LEFT JOIN l b ON a.page = b.page AND least(a.y2, b.y2) > greatest(a.y, b.y) AND b.x > a.x2 GROUP BY a.layout_id""",
    "char_medians": f"WITH {_C} SELECT page, round(quantile_cont((x2 - x) * (y2 - y), 0.5), 6) AS median_area, min(x) AS x, min(y) AS y, max(x2) AS x2, max(y2) AS y2 FROM c GROUP BY page",
    "line_gaps": f"""WITH {_L}, o AS (SELECT page, y, y2, max(y2) OVER (PARTITION BY page ORDER BY y, y2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM l)
        SELECT page, seen AS lo, y AS hi FROM o WHERE y > seen""",
    "line_spacing": f"""WITH {_L}, d AS (SELECT page, abs(y - lag(y) OVER (PARTITION BY page ORDER BY layout_id)) AS d FROM l), s AS (SELECT page, list_sort(list(d) FILTER (d > 0)) AS ds FROM d GROUP BY page)
        SELECT page, coalesce(ds[len(ds) // 2 + 1], 10.0::DOUBLE) AS spacing FROM s""",
    "paragraph_runs": """WITH i AS (SELECT l_suppkey, CASE WHEN lag(l_returnflag) OVER w IS DISTINCT FROM l_returnflag THEN 1 ELSE 0 END AS new FROM lineitem
        WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity)) SELECT l_suppkey, CAST(sum(new) AS BIGINT) AS n_runs, count(*) AS n FROM i GROUP BY l_suppkey""",
    "title_context": f"""WITH {_L}, t AS (SELECT layout_id, class, last_value(CASE WHEN class = 'title' THEN layout_id END IGNORE NULLS) OVER (PARTITION BY page ORDER BY layout_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS title FROM l)
        SELECT layout_id, title, (SELECT layout_id FROM l WHERE class = 'title' ORDER BY page, layout_id LIMIT 1) AS first_title FROM t WHERE class = 'text'""",
    "page_pairs": f"WITH {_L}, e AS (SELECT page, max(layout_id) AS last, min(layout_id) AS first FROM l WHERE class = 'text' GROUP BY page) SELECT a.page, a.last, b.first AS next_first FROM e a JOIN e b ON b.page = a.page + 1",
    "scale_mode": """WITH u AS (SELECT CAST(round_even(p_size::DOUBLE / 10, 1) AS DOUBLE) AS scale, count(*) AS n FROM part GROUP BY 1), m AS (SELECT scale AS mode FROM u ORDER BY n DESC, scale LIMIT 1)
        SELECT least(scale, mode) AS scale, CAST(sum(n) AS BIGINT) AS n FROM u, m GROUP BY 1""",
    "descent_shift": f"""WITH {_C}, u AS (SELECT page, -(p_size % 4) * 10 / 1000.0::DOUBLE AS d, count(*) AS n, min(char_id) AS f FROM c GROUP BY ALL)
        SELECT page, round(d, 6) AS shift FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, f) AS r FROM u) WHERE r = 1""",
    "space_threshold": f"""WITH {_C}, g AS (SELECT page, x - lag(x2) OVER (PARTITION BY page ORDER BY char_id) AS g FROM c), s AS (SELECT page, list_sort(list_distinct(list(g) FILTER (g > 1))) AS gs FROM g GROUP BY page)
        SELECT page, coalesce(gs[2], gs[1], 0.0::DOUBLE) AS threshold FROM s""",
    "line_neighbours": f"""WITH RECURSIVE {_L}, p AS (SELECT a.layout_id AS i, b.layout_id AS j FROM l a JOIN l b ON a.page = b.page AND a.layout_id <> b.layout_id AND abs(a.x - b.x) <= 10
            AND sqrt(pow(greatest(a.x - b.x2, b.x - a.x2, 0), 2) + pow(greatest(a.y - b.y2, b.y - a.y2, 0), 2)) <= 30),
        r AS (SELECT DISTINCT i, i AS root FROM p UNION SELECT p.j, r.root FROM r JOIN p ON p.i = r.i),
        m AS (SELECT i, min(root) AS component FROM r GROUP BY i)
        SELECT component, count(*) AS n FROM m GROUP BY component""",
}
