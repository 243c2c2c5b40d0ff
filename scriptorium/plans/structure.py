"""Document structure: assignments, styles, lines, fonts, names, formulas and reports."""

from __future__ import annotations

from bisect import insort

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.operators import spatial as S
from scriptorium.operators.folds import ordered_fold
from scriptorium.plans.chunks import PAGE_TOKENS, page_chunks
from scriptorium.plans.language import domain_gate
from scriptorium.plans.layout import _AR, _C, _L, _OV, PAGE, chars, layouts
from scriptorium.runtime import table

#: Share of pages that makes a document scanned; slack and share of exact containment.
SCANNED, SLACK, EXACT = 0.8, 2.0, 0.95


def domain_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    verdict = domain_gate(F.when(F.col("doc_id") % 2 == 0, "legal").otherwise("hr"), F.when(F.col("doc_id") % 3 == 0, "legal").otherwise("hr"), (F.col("doc_id") % 10) / 10)
    return docs.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def curve_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formula of each small box, of the same object unless one has none: one that holds it exactly, else the nearest within the slack; each box once."""
    formulas = layouts(spark, sf_dir).filter("class = 'formula'").withColumn("own_object", F.when(F.col("layout_id") % 4 != 0, F.col("layout_id") % 2))
    boxes = chars(spark, sf_dir).withColumn("object", F.when(F.col("char_id") % 3 != 0, F.col("char_id") % 2))
    grown = formulas.select("page", "layout_id", "own_object", F.col("b").alias("own"), S.box(F.col("b")["x"] - SLACK, F.col("b")["y"] - SLACK, F.col("b")["x2"] + SLACK, F.col("b")["y2"] + SLACK).alias("b"))
    pairs = S.overlap_join(boxes, grown, ["page"], 50.0).filter("object is null or own_object is null or object = own_object")
    exact = S.covered(F.col("a"), F.col("own")) >= EXACT
    middle = lambda b: ((b["x"] + b["x2"]) / 2, (b["y"] + b["y2"]) / 2)
    (ax, ay), (bx, by) = middle(F.col("a")), middle(F.col("own"))
    score = F.when(exact, F.lit(1.0)).otherwise(0.5 + 0.4 * F.greatest(F.lit(0.0), 1 - F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) / 100))
    inside = pairs.filter(exact | S.contains(F.col("own"), F.col("a"), SLACK)).withColumn("score", score)
    return S.best_match(inside, ["char_id"], [F.desc(exact), F.desc("score"), F.col("layout_id")]).select("char_id", "layout_id", F.round("score", 6).alias("score"))


def figure_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small boxes with over 0.3 of their area in a figure."""
    pairs = S.overlap_join(chars(spark, sf_dir), layouts(spark, sf_dir).filter("class = 'figure'"), ["page"], 50.0)
    return pairs.filter(S.covered(F.col("a"), F.col("b")) > 0.3).select("char_id").distinct()


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page turned upside down (height 800) that lie in a text layout by more than half."""
    a = F.col("a")
    flipped = chars(spark, sf_dir).withColumn("a", S.box(a["x"], 800 - a["y2"], a["x2"], 800 - a["y"]))
    pairs = S.overlap_join(flipped, layouts(spark, sf_dir).filter("class = 'text'"), ["page"], 50.0)
    return pairs.filter(S.covered(F.col("a"), F.col("b")) > 0.5).groupBy("layout_id").agg(F.countDistinct("char_id").alias("n"))


def column_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive texts of a page where the next starts more than 20 higher, each text in one pair: greedy, in order."""
    rows = layouts(spark, sf_dir).filter("class in ('text', 'title')").select("page", "layout_id", F.col("b")["y2"].alias("y2"))

    def pair(page: pd.DataFrame) -> pd.DataFrame:
        out, i, ids, y = [], 0, page["layout_id"].tolist(), page["y2"].tolist()
        while i + 1 < len(ids):
            if y[i + 1] - y[i] > 20:
                out.append((page["page"][0], ids[i], ids[i + 1]))
                i += 1
            i += 1
        return pd.DataFrame(out, columns=["page", "first", "second"])

    return ordered_fold(rows, ["page"], ["layout_id"], pair, "page long, first long, second long")


def overlap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertical overlaps of a page's layouts removed from the top down: each starts below those before it that it would overlap."""
    b = F.col("b")
    rows = layouts(spark, sf_dir).select("page", "layout_id", b["x"].alias("x"), b["x2"].alias("x2"), b["y"].alias("y"), b["y2"].alias("y2"))

    def push(page: pd.DataFrame) -> pd.DataFrame:
        placed: list[tuple[float, ...]] = []  # by their tops, so one pass finds the first free place
        shifts = []
        for r in page.itertuples(index=False):
            y, height = r.y, r.y2 - r.y
            for top, bottom, x, x2 in placed:
                if top >= y + height:
                    break
                if y < bottom and x < r.x2 and r.x < x2:
                    y = bottom
            insort(placed, (y, y + height, r.x, r.x2))
            shifts.append(y - r.y)
        return pd.DataFrame({"page": page["page"], "layout_id": page["layout_id"], "shift": shifts})

    return ordered_fold(rows, ["page"], ["y", "layout_id"], push, "page long, layout_id long, shift double")


def base_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group's style where all agree, else the most frequent one (the least of equals), and whether they agree."""
    p = table(spark, sf_dir, "part").select("p_brand", F.substring("p_type", 1, 5).alias("font"), (F.col("p_size") % 3).alias("size"))
    used = p.groupBy("p_brand", "font", "size").agg(F.count("*").alias("n"))
    w = Window.partitionBy("p_brand").orderBy(F.desc("n"), "font", "size")
    ranked = used.withColumn("r", F.row_number().over(w)).withColumn("kinds", F.count("*").over(Window.partitionBy("p_brand")))
    return ranked.filter("r = 1").select("p_brand", "font", "size", (F.col("kinds") == 1).alias("agreed"))


def scanned_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents more than 80 % of whose lines have no letters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("ls"))
    blank = F.size(F.filter("ls", lambda x: ~x.rlike(r"\p{L}")))
    return docs.select("doc_id", (blank / F.size("ls") > SCANNED).alias("scanned")).groupBy("scanned").agg(F.count("*").alias("n"))


def line_number_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of digits alone between two others are line numbers: the line after them joins the one before."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    number = F.col("l_partkey") % 3 == 0
    rows = lines.withColumn("number", number).withColumn("before", F.lag(number).over(w)).withColumn("seen", F.coalesce(F.max((~number).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joins = ~F.col("number") & F.coalesce(F.col("before"), F.lit(False)) & (F.col("seen") == 1)
    return rows.groupBy("l_orderkey").agg(F.count(F.when(~F.col("number") & ~joins, 1)).alias("paragraphs"), F.count(F.when(joins, 1)).alias("joined"))


def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of lines: a new one after a line of 20 dots, after one short of 0.8 of the median, or at a bullet."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t"))
    lines = lines.withColumn("len", F.length("t"))
    median = lines.groupBy("doc_id").agg(F.percentile("len", 0.5).alias("median"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = lines.join(median, "doc_id").withColumn("before", F.lag("t").over(w))
    new = F.col("before").isNull() | F.col("before").rlike(r"\.{20,}") | (F.length("before") < 0.8 * F.col("median")) | F.col("t").rlike(r"^[-*•]")
    return rows.withColumn("new", new.cast("int")).groupBy("doc_id").agg(F.sum("new").alias("paragraphs"))


def compatible_form(text: Column) -> Column:
    """NFKC; Spark has no such function, so Arrow batches go to Python, and only texts beyond ASCII need it."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.str.normalize("NFKC")

    return run(text)


def line_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's characters in order, with a space where the gap is wider than 1.5 mean widths."""
    a = F.col("a")
    rows = chars(spark, sf_dir).select("page", a["x"].alias("x"), a["x2"].alias("x2"), "char_id", F.chr((F.col("char_id") % 26 + 65).cast("long")).alias("c"))
    mean = rows.groupBy("page").agg(F.avg(F.col("x2") - F.col("x")).alias("mean"))
    gap = F.lead("x").over(Window.partitionBy("page").orderBy("x", "char_id")) - F.col("x2")
    spaced = rows.withColumn("gap", gap).join(mean, "page").withColumn("s", F.when(F.col("gap") > 1.5 * F.col("mean"), F.concat("c", F.lit(" "))).otherwise(F.col("c")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("x", "char_id", "s"))), lambda t: t["s"])
    return spaced.groupBy("page").agg(F.array_join(parts, "").alias("line"))


def unicode_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.sha2(compatible_form(F.concat("text", F.lit("ﬁ²"))), 256).alias("sha256"))


def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version and display name: the vendor's prefix goes, the first hyphen becomes a space, words are capitalised."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("vendor/"), F.lower("p_brand"), F.lit("-"), F.col("p_size").cast("string"), F.lit("-x")).alias("model")).distinct()
    version = F.regexp_replace("model", "^[^/]*/", "")
    return parts.select("model", version.alias("version"), F.initcap(F.regexp_replace(version, "^([^-]*)-", "$1 ")).alias("display"))


def without_invented(given: Column, out: Column, pattern: str) -> tuple[Column, Column]:
    """The marks of an output that its input doesn't have, and the output without them, each mark taken as plain text."""
    bad = F.array_except(F.regexp_extract_all(out, F.lit(pattern), F.lit(0)), F.regexp_extract_all(given, F.lit(pattern), F.lit(0)))
    return bad, F.aggregate(bad, out, lambda t, b: F.replace(t, b, F.lit("")))


def placeholder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders of an output, some of them broken, and those that its input doesn't have taken out."""
    turns = table(spark, sf_dir, "conversations")
    mark = lambda n: F.concat(F.lit("<b"), n.cast("string"), F.lit(">"))
    given = F.concat(F.lit("<b1> "), F.col("text"), mark(F.col("turn")))
    words = F.split("text", " ")
    out = F.array_join(F.transform(words, lambda w, i: F.when(i % 3 == 0, F.concat(w, mark(i % 5 + F.col("turn") % 2))).when(i % 7 == 1, F.concat(w, F.lit("<b>< b1>"))).otherwise(w)), " ")
    bad, clean = without_invented(given, out, r"<b\d+>")
    return turns.select("conv_id", "turn", F.regexp_count(out, F.lit(r"<b\d+>")).cast("long").alias("n"), F.size(bad).cast("long").alias("invented"), F.sha2(clean, 256).alias("clean_sha256"))


def top_level_pieces(text: Column) -> Column:
    """Pieces of a formula that commas outside all brackets cut."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("n"))
    step = lambda s, c: F.struct((s["depth"] + F.when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)).alias("depth"), (s["n"] + F.when((c == ",") & (s["depth"] == 0), 1).otherwise(0)).alias("n"))
    return F.aggregate(F.split(text, ""), start, step, lambda s: s["n"])


def formula_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas, nested and of names with commas, cut at commas outside brackets, and whether they are numbers only."""
    p = table(spark, sf_dir, "part")
    k, n = F.col("p_partkey") % 4, (F.col("p_size") % 5).cast("int")
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("f("), size, F.lit(",2), g[1,(3,4)], "), key))
        .when(k == 1, F.concat(size, F.lit(", 1.5")))
        .when(k == 2, F.concat(F.lit("{a,[b,(c,d)],e},"), F.repeat(F.lit("("), n), F.lit("x,y"), F.repeat(F.lit(")"), n), F.repeat(F.lit(",z"), n)))
        .otherwise(F.concat(F.lit(","), F.replace(F.col("p_name"), F.lit(" "), F.lit(",")), F.lit("[,]")))
    )
    return p.select("p_partkey", top_level_pieces(text).alias("pieces"), text.rlike("^[0-9, .]+$").alias("numeric"))


def layout_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each layout's box grown by the small boxes that it was given."""
    pairs = S.overlap_join(chars(spark, sf_dir), layouts(spark, sf_dir), ["page"], 50.0)
    inside = pairs.filter(S.covered(F.col("a"), F.col("b")) > 0.5)
    a, b = F.col("a"), F.col("b")
    return inside.groupBy("layout_id").agg(F.least(F.min(a["x"]), F.min(b["x"])).alias("x"), F.least(F.min(a["y"]), F.min(b["y"])).alias("y"), F.greatest(F.max(a["x2"]), F.max(b["x2"])).alias("x2"), F.greatest(F.max(a["y2"]), F.max(b["y2"])).alias("y2"))


def font_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The font of each part: its object's own one, else its page's, else a default."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(f"p_partkey div {PAGE}").alias("page"), F.col("p_brand").alias("object"), "p_size")
    page_fonts = p.groupBy("page").agg(F.min("p_size").alias("page_font")).filter("page % 4 <> 0")
    own = p.groupBy("page", "object").agg(F.max("p_size").alias("own_font")).filter("page % 3 = 0")
    return p.join(own, ["page", "object"], "left").join(page_fonts, "page", "left").select("p_partkey", F.coalesce("own_font", "page_font", F.lit(-1)).alias("font"))


def formula_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest character on the same line of each formula, by y-overlap over 0.6, with the offset zeroed when tiny or far."""
    formulas = layouts(spark, sf_dir).filter("class = 'formula'").select("page", "layout_id", "b")
    band = lambda c: F.explode(F.sequence(F.floor(F.col(c)["y"] / 50), F.floor(F.col(c)["y2"] / 50)))
    pairs = formulas.withColumn("s", band("b")).join(chars(spark, sf_dir).withColumn("s", band("a")), ["page", "s"]).filter(S.y_overlap(F.col("a"), F.col("b")) > 0.6)
    dx = F.col("a")["x"] - F.col("b")["x2"]
    best = S.best_match(pairs, ["layout_id"], [F.abs(dx), F.col("char_id")])
    return best.select("layout_id", "char_id", F.when((F.abs(dx) < 0.1) | ~dx.between(-5, 10), 0.0).otherwise(dx).alias("offset"))


def fallback_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ten units of height become layouts numbered after the page's own ones."""
    own = layouts(spark, sf_dir).select("page", "layout_id", "class")
    lines = chars(spark, sf_dir).select("page", F.floor(F.col("a")["y"] / 100).alias("line")).distinct()
    top = own.groupBy("page").agg(F.max("layout_id").alias("top"))
    added = lines.join(top, "page").withColumn("layout_id", F.col("top") + F.row_number().over(Window.partitionBy("page").orderBy("line"))).select("page", "layout_id", F.lit("fallback_line").alias("class"))
    return own.unionByName(added).groupBy("page", "class").agg(F.count("*").alias("n"), F.max("layout_id").alias("last"))


def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, and pages parsed against pages there are."""
    chunks = page_chunks(spark, sf_dir)
    each = chunks.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum(F.col("end_page") - F.col("start_page") + 1).alias("parsed"), (F.max("end_page") + 1).cast("long").alias("pages"))
    return each.agg(F.sum("parts").alias("parts"), F.sum("parsed").alias("parsed"), F.sum("pages").alias("pages"), (F.sum("parsed") * PAGE_TOKENS).alias("tokens"))


def part_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices of merged parts: each part starts behind the units of the parts before it, in part order."""
    turns = table(spark, sf_dir, "conversations").withColumn("part", F.floor(F.col("turn") / 3).cast("int"))
    sizes = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = turns.withColumn("i", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn")) - 1)
    return local.join(sizes.withColumn("offset", offset), ["conv_id", "part"]).select("conv_id", "turn", (F.col("i") + F.col("offset")).alias("chunk_index"))


def reviews_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events, newest first, and the order in which the largest would be scheduled."""
    rows = table(spark, sf_dir, "events").filter("user_id = 7")
    return rows.select("event_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")).alias("newest"), (1_048_576 - F.floor("value").cast("long")).alias("priority"))


def formula_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive characters that are formula ones or not, as runs; very small characters never break a run."""
    a = F.col("a")
    rows = chars(spark, sf_dir).select("page", "char_id", (F.col("char_id") % 7 < 3).alias("formula"), (S.area(a) < 45).alias("tiny"))
    w = Window.partitionBy("page").orderBy("char_id")
    # A small character takes the class of the last larger one; the first ones of a page have their own.
    carried = F.last(F.when(~F.col("tiny"), F.col("formula")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("kind", F.coalesce(carried, F.col("formula")))
    new = F.coalesce((F.lag("kind").over(w) != F.col("kind")).cast("int"), F.lit(1))
    return rows.withColumn("new", new).groupBy("page").agg(F.sum("new").alias("runs"), F.count(F.when(F.col("kind"), 1)).alias("formula_chars"))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page by a key that weighs columns against lines (flow 0.5)."""
    b = F.col("b")
    key = (1 - 0.5) * b["x"] - (1 + 0.5) * (b["y"] + b["y2"])
    return layouts(spark, sf_dir).select("page", "layout_id", F.row_number().over(Window.partitionBy("page").orderBy(key, "layout_id")).alias("place"))


def line_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a page: bands of boxes that overlap in height by more than half, cut where the next box is over 3.5 heights away."""
    a = F.col("a")
    rows = chars(spark, sf_dir).select("page", "char_id", a["x"].alias("x"), a["x2"].alias("x2"), a["y"].alias("y"), a["y2"].alias("y2"))

    def cluster(page: pd.DataFrame) -> pd.DataFrame:
        bands: list[list[tuple]] = []
        for r in page.itertuples(index=False):
            for band in reversed(bands):
                y, y2 = band[0].y, band[0].y2
                if min(y2, r.y2) - max(y, r.y) > 0.5 * min(y2 - y, r.y2 - r.y):
                    band.append(r)
                    break
            else:
                bands.append([r])
        out, line = [], 0
        for band in bands:
            end = None
            for r in sorted(band, key=lambda r: (r.x, r.char_id)):
                if end is not None and r.x - end > 3.5 * (r.y2 - r.y):
                    line += 1
                out.append((r.page, r.char_id, line))
                end = r.x2 if end is None else max(end, r.x2)
            line += 1
        return pd.DataFrame(out, columns=["page", "char_id", "line"])

    return ordered_fold(rows, ["page"], ["y", "char_id"], cluster, "page long, char_id long, line int")


QUERIES = {f.__name__: f for f in (formula_runs, reading_order, line_clusters, domain_verdicts, curve_assignment, figure_curves, table_cells, column_pairs, overlap_resolution, base_style, scanned_vote, line_number_merge, paragraph_split, line_text, unicode_forms, model_names, placeholder_scan, formula_split, layout_union, font_lookup, formula_anchors, fallback_lines, split_report, part_renumber, reviews_by_job)}
_YOV = "greatest(least(a.y2, b.y2) - greatest(a.y, b.y), 0) / least(a.y2 - a.y, b.y2 - b.y)"
ORACLE_SQL = {
    "formula_runs": f"""WITH {_C}, t AS (SELECT page, char_id, char_id % 7 < 3 AS formula, (x2 - x) * (y2 - y) < 45 AS tiny FROM c),
        k AS (SELECT page, char_id, coalesce(last_value(CASE WHEN NOT tiny THEN formula END IGNORE NULLS) OVER (PARTITION BY page ORDER BY char_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), formula) AS kind FROM t),
        n AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY page ORDER BY char_id) IS DISTINCT FROM kind THEN 1 ELSE 0 END AS new FROM k)
        SELECT page, CAST(sum(new) AS BIGINT) AS runs, count(*) FILTER (kind) AS formula_chars FROM n GROUP BY page""",
    "reading_order": f"WITH {_L} SELECT page, layout_id, CAST(row_number() OVER (PARTITION BY page ORDER BY 0.5::DOUBLE * x - 1.5::DOUBLE * (y + y2), layout_id) AS INTEGER) AS place FROM l",
    "domain_verdicts": """WITH d AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'legal' ELSE 'hr' END AS a, CASE WHEN doc_id % 3 = 0 THEN 'legal' ELSE 'hr' END AS b, (doc_id % 10) / 10 AS c FROM documents)
        SELECT CASE WHEN a = b THEN 'ok' WHEN c < 0.7 THEN 'unsure' ELSE 'mismatch' END AS verdict, count(*) AS n FROM d GROUP BY 1""",
    "curve_assignment": f"""WITH {_C}, {_L}, p AS (SELECT a.char_id, b.layout_id, {_OV} / {_AR} >= 0.95 AS exact, sqrt(pow((a.x + a.x2) / 2 - (b.x + b.x2) / 2, 2) + pow((a.y + a.y2) / 2 - (b.y + b.y2) / 2, 2)) AS d
            FROM c a JOIN l b ON a.page = b.page AND b.class = 'formula' AND (a.char_id % 3 = 0 OR b.layout_id % 4 = 0 OR a.char_id % 2 = b.layout_id % 2) AND ({_OV} / {_AR} >= 0.95 OR (b.x <= a.x + 2 AND b.y <= a.y + 2 AND b.x2 >= a.x2 - 2 AND b.y2 >= a.y2 - 2))),
        s AS (SELECT *, CASE WHEN exact THEN 1.0::DOUBLE ELSE 0.5 + 0.4 * greatest(0, 1 - d / 100) END AS score FROM p)
        SELECT char_id, layout_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY char_id ORDER BY exact DESC, score DESC, layout_id) AS n FROM s) WHERE n = 1""",
    "figure_curves": f"WITH {_C}, {_L} SELECT DISTINCT a.char_id FROM c a JOIN l b ON a.page = b.page AND b.class = 'figure' AND {_OV} / {_AR} > 0.3",
    "table_cells": f"WITH {_C}, {_L}, f AS (SELECT page, char_id, x, 800 - y2 AS y, x2, 800 - y AS y2 FROM c) SELECT b.layout_id, count(DISTINCT a.char_id) AS n FROM f a JOIN l b ON a.page = b.page AND b.class = 'text' AND {_OV} / {_AR} > 0.5 GROUP BY b.layout_id",
    "column_pairs": f"""WITH RECURSIVE {_L}, r AS (SELECT page, layout_id, y2, row_number() OVER (PARTITION BY page ORDER BY layout_id) AS n FROM l WHERE class IN ('text', 'title')),
        f AS (SELECT page, layout_id, y2, n, false AS taken FROM r WHERE n = 1
              UNION ALL SELECT r.page, r.layout_id, r.y2, r.n, NOT f.taken AND r.y2 - f.y2 > 20 FROM f JOIN r ON r.page = f.page AND r.n = f.n + 1)
        SELECT b.page, a.layout_id AS first, b.layout_id AS second FROM f b JOIN f a ON a.page = b.page AND a.n = b.n - 1 WHERE b.taken""",
    "base_style": """WITH u AS (SELECT p_brand, substr(p_type, 1, 5) AS font, p_size % 3 AS size, count(*) AS n FROM part GROUP BY ALL)
        SELECT p_brand, font, size, k = 1 AS agreed FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, font, size) AS r, count(*) OVER (PARTITION BY p_brand) AS k FROM u) WHERE r = 1""",
    "scanned_vote": r"""WITH d AS (SELECT string_split(text, chr(10)) AS ls FROM documents)
        SELECT len(list_filter(ls, lambda x: NOT regexp_matches(x, '\p{L}'))) / len(ls) > 0.8 AS scanned, count(*) AS n FROM d GROUP BY 1""",
    "line_number_merge": """WITH i AS (SELECT l_orderkey, l_partkey % 3 = 0 AS number, lag(l_partkey % 3 = 0) OVER w AS before, coalesce(max(CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE 1 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
            FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity)),
        j AS (SELECT *, NOT number AND coalesce(before, false) AND seen = 1 AS joins FROM i)
        SELECT l_orderkey, count(*) FILTER (NOT number AND NOT joins) AS paragraphs, count(*) FILTER (joins) AS joined FROM j GROUP BY l_orderkey""",
    "paragraph_split": r"""WITH l AS (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
        m AS (SELECT doc_id, quantile_cont(length(t), 0.5) AS median FROM l GROUP BY doc_id), b AS (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM l JOIN m USING (doc_id))
        SELECT doc_id, count(*) FILTER (before IS NULL OR regexp_matches(before, '\.{20,}') OR length(before) < 0.8::DOUBLE * median OR regexp_matches(t, '^[-*•]')) AS paragraphs FROM b GROUP BY doc_id""",
    "line_text": f"""WITH {_C}, g AS (SELECT page, x, char_id, chr(CAST(char_id % 26 + 65 AS INTEGER)) AS c, lead(x) OVER (PARTITION BY page ORDER BY x, char_id) - x2 AS gap, avg(x2 - x) OVER (PARTITION BY page) AS mean FROM c)
        SELECT page, string_agg(CASE WHEN gap > 1.5::DOUBLE * mean THEN c || ' ' ELSE c END, '' ORDER BY x, char_id) AS line FROM g GROUP BY page""",
    "model_names": """WITH m AS (SELECT DISTINCT 'vendor/' || lower(p_brand) || '-' || p_size || '-x' AS model FROM part), v AS (SELECT model, regexp_replace(model, '^[^/]*/', '') AS version FROM m)
        SELECT model, version, array_to_string(list_transform(string_split(regexp_replace(version, '^([^-]*)-', '\\1 '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS display FROM v""",
    "placeholder_scan": r"""WITH t AS (SELECT conv_id, turn, '<b1> ' || text || '<b' || turn || '>' AS given, string_split(text, ' ') AS ws FROM conversations),
        o AS (SELECT conv_id, turn, given, array_to_string(list_transform(ws, lambda w, i: CASE WHEN (i - 1) % 3 = 0 THEN w || '<b' || ((i - 1) % 5 + turn % 2) || '>' WHEN (i - 1) % 7 = 1 THEN w || '<b>< b1>' ELSE w END), ' ') AS out FROM t),
        b AS (SELECT *, regexp_extract_all(out, '<b\d+>') AS ms, list_distinct(list_filter(regexp_extract_all(out, '<b\d+>'), lambda m: NOT list_contains(regexp_extract_all(given, '<b\d+>'), m))) AS bad FROM o)
        SELECT conv_id, turn, CAST(len(ms) AS BIGINT) AS n, CAST(len(bad) AS BIGINT) AS invented, sha256(list_reduce(list_prepend(out, bad), lambda x, y: replace(x, y, ''))) AS clean_sha256 FROM b""",
    "formula_split": """WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'f(' || p_size || ',2), g[1,(3,4)], ' || p_partkey WHEN 1 THEN p_size || ', 1.5'
            WHEN 2 THEN '{a,[b,(c,d)],e},' || repeat('(', p_size % 5) || 'x,y' || repeat(')', p_size % 5) || repeat(',z', p_size % 5) ELSE ',' || replace(p_name, ' ', ',') || '[,]' END AS text FROM part),
        c AS (SELECT p_partkey, text, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM t),
        d AS (SELECT *, sum(CASE WHEN ch IN ('(', '[', '{') THEN 1 WHEN ch IN (')', ']', '}') THEN -1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY i) AS depth FROM c)
        SELECT p_partkey, CAST(1 + count(*) FILTER (ch = ',' AND depth = 0) AS INTEGER) AS pieces, regexp_full_match(any_value(text), '[0-9, .]+') AS numeric FROM d GROUP BY p_partkey""",
    "layout_union": f"""WITH {_C}, {_L} SELECT b.layout_id, least(min(a.x), min(b.x)) AS x, least(min(a.y), min(b.y)) AS y, greatest(max(a.x2), max(b.x2)) AS x2, greatest(max(a.y2), max(b.y2)) AS y2
        FROM c a JOIN l b ON a.page = b.page AND {_OV} / {_AR} > 0.5 GROUP BY b.layout_id""",
    "font_lookup": f"SELECT p_partkey, coalesce(CASE WHEN page % 3 = 0 THEN max(p_size) OVER (PARTITION BY page, p_brand) END, CASE WHEN page % 4 <> 0 THEN min(p_size) OVER (PARTITION BY page) END, -1) AS font FROM (SELECT *, p_partkey // {PAGE} AS page FROM part)",
    "formula_anchors": f"""WITH {_C}, {_L}, p AS (SELECT b.layout_id, a.char_id, a.x - b.x2 AS dx FROM l b JOIN c a ON a.page = b.page AND b.class = 'formula' AND {_YOV} > 0.6),
        r AS (SELECT *, row_number() OVER (PARTITION BY layout_id ORDER BY abs(dx), char_id) AS n FROM p)
        SELECT layout_id, char_id, CASE WHEN abs(dx) < 0.1 OR NOT dx BETWEEN -5 AND 10 THEN 0.0::DOUBLE ELSE dx END AS "offset" FROM r WHERE n = 1""",
    "fallback_lines": f"""WITH {_C}, {_L}, n AS (SELECT DISTINCT page, floor(y / 100) AS line FROM c), t AS (SELECT page, max(layout_id) AS top FROM l GROUP BY page),
        a AS (SELECT page, top + row_number() OVER (PARTITION BY page ORDER BY line) AS layout_id, 'fallback_line' AS class FROM n JOIN t USING (page)),
        u AS (SELECT page, layout_id, class FROM l UNION ALL SELECT page, layout_id, class FROM a) SELECT page, class, count(*) AS n, max(layout_id) AS last FROM u GROUP BY ALL""",
    "split_report": """WITH p AS (SELECT CAST(greatest(ceil(n_chars / 100), 1) AS BIGINT) AS pages FROM documents), c AS (SELECT pages, CAST(ceil(pages / 20) AS BIGINT) AS parts FROM p)
        SELECT CAST(sum(parts) AS BIGINT) AS parts, CAST(sum(pages + 2 * (parts - 1)) AS BIGINT) AS parsed, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(pages + 2 * (parts - 1)) * 300 AS BIGINT) AS tokens FROM c""",
    "part_renumber": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index FROM conversations",
    "reviews_by_job": "SELECT event_id, event_type, CAST(row_number() OVER (ORDER BY ts DESC, event_id) AS INTEGER) AS newest, CAST(1048576 - floor(value) AS BIGINT) AS priority FROM events WHERE user_id = 7",
}
