"""Characters to paragraphs and formulas: the rules as operators with parameters, and queries over the made-up boxes.

Operators take frames of boxes with the columns that they name; a rule that
depends on what came before runs as one pass over a key's rows in order.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.operators import spatial as S
from scriptorium.operators.folds import ordered_fold, running_rows
from scriptorium.plans.layout import _AR, _C, _L, _OV, chars, layouts

#: Classes of layouts that hold text.
TEXT_LAYOUTS = (
    "plain text", "tiny text", "title", "abandon", "figure_caption", "table_caption", "table_text", "table_footnote", "paragraph_title", "abstract", "content",
    "figure_title", "table_title", "doc_title", "footnote", "header", "footer", "seal", "text", "chart_title", "paragraph", "table_cell", "figure_text", "list_item",
    "caption", "page_header", "page_footer", "wired_table_cell", "wireless_table_cell", "paragraph_hybrid", "table_cell_hybrid", "caption_hybrid", "unknown_hybrid",
    "figure_text_hybrid", "list_item_hybrid", "title_hybrid", "fallback_line", "author_info_hybrid", "page_header_hybrid", "page_footer_hybrid", "footnote_hybrid",
)
#: A character is small below this share of the page's median area; sizes, against the character before, of marks that begin and that go on.
SMALL, BEGINS, GOES_ON = 0.05, 0.79, 1.1
#: Least common height with an anchor, offsets that count as none, and the range that an offset to the left may have.
ANCHOR, TINY, NEAREST, FARTHEST = 0.6, 0.1, -5.0, 10.0
#: Shares of a box in a formula, over a paragraph, and of a visual box in the plain one below which the plain one counts.
IN_FORMULA, OVER_PARAGRAPH, VISUAL = 0.4, 0.2, 0.2
#: Fixed value: height of a step of the histogram of lines.
STEP = 0.25
#: Fixed values of lines: share of a character's height that a band has to cover, reach in mean widths, heights from which a line is split, and its reach in heights.
BAND, REACH, TALL, SPLIT = 0.5, 3.5, 1.5, 0.5
#: Fixed values of merges: share of a line inside another, common share of both heights of neighbours, and the gap between them in mean widths.
INSIDE, LEVEL, BESIDE = 0.6, 0.7, 1.5


def is_text_layout(layout: Column) -> Column:
    return F.coalesce(layout.isin(*TEXT_LAYOUTS), F.lit(False))


def paragraphs(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``paragraph`` of each character, from 0 in each key; null for those outside text.

    Columns: layout, xobj, text (it stands in a text layout and is no isolated
    formula), space, small, flat (its height says nothing). A new paragraph
    begins where the layout changes, but for spaces, or the object does; small
    characters of the same layout and flat ones never begin one.
    """

    def step(state, layout, xobj, text, space, small, flat):
        if not text:
            return state, (None,)
        if state is None:
            return (0, layout, xobj), (0,)
        n, own, last = state
        stays = (small and layout == own) or flat
        if not stays and ((layout != own and not space) or xobj != last):
            return (n + 1, layout, xobj), (n + 1,)
        return (n, own, xobj), (n,)

    return running_rows(rows, [key], [order], ["layout", "xobj", "text", "space", "small", "flat"], step, "paragraph int")


def formula_tags(rows: DataFrame, key: str, order: str, begins: float = BEGINS, goes_on: float = GOES_ON) -> DataFrame:
    """``formula``, ``mark`` (it is set higher or lower) and ``run`` of each character of a line.

    Columns: fixed (a formula by its layout, font, direction or box), starts and
    continues (what the character is outside and inside a formula; null if it
    has no code, which goes with what came before), size, space, blank (the
    plain space), bullet. A mark is smaller than the character before by the
    factor ``begins``, or ``goes_on`` behind another mark; a first one is
    compared with the next. Spaces, what follows them, and lines that begin with
    a bullet have none.
    """
    rows = rows.withColumn("_next", F.lead("size").over(Window.partitionBy(key).orderBy(order)))

    def step(state, fixed, starts, continues, size, space, blank, bullet, after):
        first = state is None
        inside, marked, before, after_space, bulleted, run = state or (False, False, None, False, bullet, -1)
        if starts is None or continues is None:
            formula = inside
        else:
            formula = continues if inside else starts
        formula = formula or fixed
        if space or after_space or bulleted:
            mark = False
        elif before is not None:
            mark = size < before * (goes_on if marked else begins)
        else:
            mark = after is not None and not marked and size < after * begins
        formula = inside if blank else formula or mark
        run = run + 1 if first or formula != inside else run
        return (formula, mark, size, space, bulleted, run), (formula, mark, run)

    return running_rows(rows, [key], [order], ["fixed", "starts", "continues", "size", "space", "blank", "bullet", "_next"], step, "formula boolean, mark boolean, run int").drop("_next")


def formula_box(box: Column, visual: Column) -> Column:
    """The visual box, or the plain one where these hardly overlap."""
    return F.when(S.covered(visual, box) < VISUAL, box).otherwise(visual)


def anchors(formulas: DataFrame, letters: DataFrame, keys: list[str], band: float = 50.0) -> DataFrame:
    """x_offset and y_offset of each formula (f_id, f) from its anchors among characters (c_id, a) of the keys.

    An anchor is the nearest character to the left, or right, with more than
    ``ANCHOR`` of the lower height in common; of two, the one with more counts,
    and both if equal. Rows meet in bands of a height.
    """
    strip = lambda c: F.explode(F.sequence(F.floor(c["y"] / band), F.floor(c["y2"] / band)))
    f, a = F.col("f"), F.col("a")
    pairs = formulas.withColumn("_s", strip(f)).join(letters.withColumn("_s", strip(a)), [*keys, "_s"]).withColumn("_share", S.y_overlap(f, a)).filter(F.col("_share") > ANCHOR)
    left, right = a["x2"] <= f["x"], a["x"] >= f["x2"]
    nearest = lambda cond, gap: F.min(F.when(cond, F.struct(gap.alias("gap"), "c_id", F.col("_share").alias("share"), a.alias("a"))))
    both = pairs.groupBy(*keys, "f_id").agg(nearest(left, f["x"] - a["x2"]).alias("l"), nearest(right, a["x"] - f["x2"]).alias("r"))
    both = formulas.join(both, [*keys, "f_id"], "left")
    has_l = F.col("l").isNotNull() & (F.col("r").isNull() | (F.col("l.share") >= F.col("r.share")))
    has_r = F.col("r").isNotNull() & (F.col("l").isNull() | (F.col("r.share") >= F.col("l.share")))
    x = f["x"] - F.col("l.a.x2")
    y = F.when(has_l, f["y"] - F.col("l.a.y")).when(has_r, f["y"] - F.col("r.a.y")).otherwise(0.0)
    x = F.when(~has_l | (F.abs(x) < TINY) | (x > FARTHEST) | (x < NEAREST), 0.0).otherwise(x)
    return both.select(*keys, "f_id", x.alias("x_offset"), F.when(F.abs(y) < TINY, 0.0).otherwise(y).alias("y_offset"))


def histogram_gaps(boxes: DataFrame, keys: list[str], lo: Column, hi: Column, step: float = STEP) -> DataFrame:
    """Runs of steps, from the top of each key's boxes down, that no box touches (first, last): the gaps between its lines."""
    rows = boxes.select(*keys, lo.alias("_lo"), hi.alias("_hi")).withColumn("_top", F.max("_hi").over(Window.partitionBy(*keys)))
    first, end = F.floor((F.col("_top") - F.col("_hi")) / step), F.floor((F.col("_top") - F.col("_lo")) / step) + 1
    return S.coverage_gaps(rows, keys, first, end).select(*keys, F.col("lo").alias("first"), (F.col("hi") - 1).alias("last"))


def neighbours(lines: DataFrame, keys: list[str], ratio: float, cell: float = 50.0) -> DataFrame:
    """(keys, i, j) of each line (id, b) and the others close to it: within ``ratio`` of its height above or below, as high up to that, and with left edge, right edge or middle that far apart at most."""
    b, own = F.col("b"), F.col("own")
    d = (own["y2"] - own["y"]) * ratio
    me = lines.select(*keys, F.col("id").alias("i"), b.alias("own"))
    grown = me.withColumn("a", S.box(own["x"], own["y"] - d, own["x2"], own["y2"] + d))
    pairs = S.overlap_join(grown, lines.select(*keys, F.col("id").alias("j"), "b"), keys, cell).filter("i <> j")
    close = lambda x, y: F.abs(x - y) <= d
    aligned = close(own["x"], b["x"]) | close(own["x2"], b["x2"]) | close((own["x"] + own["x2"]) / 2, (b["x"] + b["x2"]) / 2)
    return pairs.filter(aligned & close(own["y2"] - own["y"], b["y2"] - b["y"])).select(*keys, "i", "j")


def shared_style(rows: DataFrame, key: str, order: str, slack: float = 0.02) -> DataFrame:
    """font and size that all of a key's characters agree on, sizes up to ``slack``; where they don't, the most frequent one, the first seen of equals.

    The agreement is taken in order: once sizes disagree, it starts anew with
    the next character.
    """

    def step(state, font, size):
        if state is None or state[1] is None:
            state = (font, size)
        elif size is not None:
            state = (state[0] if state[0] == font else None, state[1] if abs(state[1] - size) < slack else None)
        return state, state

    last = running_rows(rows, [key], [order], ["font", "size"], step, "own_font string, own_size double").groupBy(key).agg(F.max_by(F.struct("own_font", "own_size"), order).alias("s"))
    out = last.select(key, F.col("s.own_font").alias("font"), F.col("s.own_size").alias("size"))
    for c in ("font", "size"):
        used = rows.filter(F.col(c).isNotNull()).groupBy(key, c).agg(F.count("*").alias("n"), F.min(order).alias("first"))
        mode = used.groupBy(key).agg(F.max_by(c, F.struct("n", -F.col("first"))).alias("_mode"))
        out = out.join(mode, key, "left").withColumn(c, F.coalesce(c, "_mode")).drop("_mode")
    return out


def reading_groups(boxes: DataFrame, keys: list[str], flow: float = 0.5) -> DataFrame:
    """``place`` of each box (id, b) of a page in reading order, from 0.

    The two boxes or groups whose common box wastes the least area join first;
    those with others between them wait until no free pair is left. Then each
    group's members stand by a key that weighs columns (flow -1) against lines
    (flow 1), and their own members inside it. A page's boxes have to fit one
    task; ties go to what was there first.
    """

    def order(page: pd.DataFrame) -> pd.DataFrame:
        boxes = [tuple(r) for r in page[["x", "y", "x2", "y2"]].itertuples(index=False)]
        inner: dict[int, tuple[int, int]] = {}
        live = dict.fromkeys(range(len(boxes)))
        joint = lambda i, j: (min(boxes[i][0], boxes[j][0]), min(boxes[i][1], boxes[j][1]), max(boxes[i][2], boxes[j][2]), max(boxes[i][3], boxes[j][3]))
        area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
        waste = lambda i, j: area(joint(i, j)) - area(boxes[i]) - area(boxes[j])
        waiting = [(False, waste(i, j), i, j) for i in live for j in range(i)]
        heapify(waiting)
        while waiting:
            late, lost, i, j = heappop(waiting)
            if i not in live or j not in live:
                continue
            both = joint(i, j)
            if not late and any(k not in (i, j) and boxes[k][0] < both[2] and both[0] < boxes[k][2] and boxes[k][1] < both[3] and both[1] < boxes[k][3] for k in live):
                heappush(waiting, (True, lost, i, j))
                continue
            del live[i], live[j]
            n = len(boxes)
            boxes.append(both)
            inner[n] = (i, j)
            for k in live:
                heappush(waiting, (False, waste(n, k), n, k))
            live[n] = None
        rank = lambda i: ((1 - flow) * boxes[i][0] - (1 + flow) * (boxes[i][1] + boxes[i][3]), i)
        out, stack = [], sorted(live, key=rank, reverse=True)
        while stack:
            i = stack.pop()
            if i in inner:
                stack += sorted(inner[i], key=rank, reverse=True)
            else:
                out.append(i)
        place = {i: n for n, i in enumerate(out)}
        return page[[*keys, "id"]].assign(place=[place[i] for i in range(len(page))])

    rows = boxes.select(*keys, "id", *[F.col("b")[c].alias(c) for c in ("x", "y", "x2", "y2")])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in (*keys, "id"))
    return ordered_fold(rows, keys, ["id"], order, f"{kinds}, place int")


def _near(points: list[tuple[float, ...]], reach: float) -> list[list[int]]:
    """Groups of points that steps of ``reach`` at most, summed over the axes, lead through."""
    left, out = set(range(len(points))), []
    while left:
        group = [left.pop()]
        for i in group:
            close = [j for j in left if sum(abs(a - b) for a, b in zip(points[i], points[j], strict=True)) <= reach]
            left.difference_update(close)
            group += close
        out.append(sorted(group))
    return out


def lines_of(boxes: list[tuple[float, float, float, float]]) -> list[list[int]]:
    """The lines of a page's boxes, as lists of their numbers by left edge, from the least top on.

    Bands grow by the boxes that they cover by more than ``BAND`` of their
    height; inside a band, boxes within reach of each other are a line; a line
    much higher than its boxes is split by height; lines that lie in one another
    or level side by side are joined, until none is left to join.
    """
    if not boxes:
        return []
    bands: list[list] = []
    for i in sorted(range(len(boxes)), key=lambda i: (boxes[i][1], i)):
        _, top, _, bottom = boxes[i]
        covers = [(min(bottom, b[1]) - max(top, b[0])) / (bottom - top) if bottom > top else 0.0 for b in bands]
        best = max(range(len(bands)), key=lambda k: (covers[k], k), default=None)
        if best is None or covers[best] <= BAND:
            bands.append([top, bottom, [i]])
            continue
        band = bands.pop(best)  # the band used last comes last, and first among equals
        bands.append([min(band[0], top), max(band[1], bottom), [*band[2], i]])
    middle = lambda i: ((boxes[i][0] + boxes[i][2]) / 2, (boxes[i][1] + boxes[i][3]) / 2)
    width, height = (lambda i: boxes[i][2] - boxes[i][0]), (lambda i: boxes[i][3] - boxes[i][1])
    lines: list[list[int]] = []
    for _, _, members in bands:
        widths = [width(i) for i in members if width(i) > 0]
        for group in _near([middle(i) for i in members], REACH * (sum(widths) / len(widths) if widths else 10.0)):
            line = [members[k] for k in group]
            most = max(map(height, line))
            if len(line) > 1 and max(boxes[i][3] for i in line) - min(boxes[i][1] for i in line) > TALL * most > 0:
                lines += [[line[k] for k in part] for part in _near([(middle(i)[1],) for i in line], SPLIT * most)]
            else:
                lines.append(line)

    def outline(line: list[int]) -> tuple[float, ...]:
        return min(boxes[i][0] for i in line), min(boxes[i][1] for i in line), max(boxes[i][2] for i in line), max(boxes[i][3] for i in line)

    def joins(a: list[int], b: list[int]) -> bool:
        (x, y, x2, y2), (u, v, u2, v2) = outline(a), outline(b)
        across, down = min(x2, u2) - max(x, u), min(y2, v2) - max(y, v)
        if down <= 0:
            return False
        if across > 0:
            return across * down > INSIDE * min((x2 - x) * (y2 - y), (u2 - u) * (v2 - v))
        both = [width(i) for i in a + b]
        return down > LEVEL * max(y2 - y, v2 - v) and -across <= BESIDE * sum(both) / len(both)

    merged = True
    while merged:
        merged = False
        for i, a in enumerate(lines):
            for j in range(i + 1, len(lines)):
                if joins(a, lines[j]):
                    a += lines.pop(j)
                    merged = True
                    break
            if merged:
                break
    lines = [sorted(line, key=lambda i: (boxes[i][0], i)) for line in lines]
    return sorted(lines, key=lambda line: (min(boxes[i][1] for i in line), boxes[line[0]][0], line[0]))


def text_lines(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """``line`` and ``place`` in it of each box (id, b) of a page, from 0; a page's boxes have to fit one task."""

    def number(page: pd.DataFrame) -> pd.DataFrame:
        at = {i: (n, k) for n, line in enumerate(lines_of([tuple(r) for r in page[["x", "y", "x2", "y2"]].itertuples(index=False)])) for k, i in enumerate(line)}
        return page[[*keys, "id"]].assign(line=[at[i][0] for i in range(len(page))], place=[at[i][1] for i in range(len(page))])

    rows = boxes.select(*keys, "id", *[F.col("b")[c].alias(c) for c in ("x", "y", "x2", "y2")])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in (*keys, "id"))
    return ordered_fold(rows, keys, ["id"], number, f"{kinds}, line int, place int")


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters with flags, and the layout with the least id that holds most of them."""
    c = F.col("char_id")
    rows = chars(spark, sf_dir)
    inside = S.overlap_join(rows.select("page", "char_id", "a"), layouts(spark, sf_dir), ["page"], 50.0).filter(S.covered(F.col("a"), F.col("b")) > 0.5)
    best = inside.groupBy("char_id").agg(F.min(F.struct("layout_id", "class")).alias("l"))
    return rows.join(best, "char_id", "left").select(
        "page", "char_id", F.col("l.layout_id").alias("layout"), (c % 17 == 0).cast("int").alias("xobj"), is_text_layout(F.col("l.class")).alias("text"),
        (c % 11 == 0).alias("space"), (S.area(F.col("a")) < 45).alias("small"), (c % 19 == 0).alias("flat"),
    )


def char_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraphs(_letters(spark, sf_dir), "page", "char_id").filter("paragraph is not null")
    return found.groupBy("page", "paragraph").agg(F.count("*").alias("n"), F.min("char_id").alias("first"), F.max("char_id").alias("last"))


def char_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("char_id")
    code = lambda x: F.when(c % 23 != 0, x)
    rows = chars(spark, sf_dir).select(
        F.expr("char_id div 25").alias("line"), "char_id", (c % 13 == 0).alias("fixed"), code(c % 7 == 0).alias("starts"), code(c % 7 < 3).alias("continues"),
        F.col("p_size").cast("double").alias("size"), (c % 11 == 0).alias("space"), (c % 22 == 0).alias("blank"), (c % 100 == 50).alias("bullet"),
    )
    return formula_tags(rows, "line", "char_id").select("line", "char_id", "formula", "mark", "run")


def formula_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    formulas = layouts(spark, sf_dir).filter("class = 'formula'").select("page", F.col("layout_id").alias("f_id"), F.col("b").alias("f"))
    letters = chars(spark, sf_dir).select("page", F.col("char_id").alias("c_id"), "a")
    return anchors(formulas, letters, ["page"]).select("f_id", F.round("x_offset", 6).alias("x_offset"), F.round("y_offset", 6).alias("y_offset"))


def formula_visual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters in formulas by their visual boxes, a fifth of which lie apart from the plain ones."""
    a, far = F.col("a"), F.when(F.col("char_id") % 5 == 0, 40).when(F.col("char_id") % 5 == 1, 3).otherwise(0)
    rows = chars(spark, sf_dir).withColumn("a", formula_box(a, S.box(a["x"] + far, a["y"], a["x2"] + far, a["y2"])))
    pairs = S.overlap_join(rows, layouts(spark, sf_dir).filter("class = 'formula'"), ["page"], 50.0)
    return pairs.filter(S.covered(F.col("a"), F.col("b")) > IN_FORMULA).groupBy("char_id").agg(F.min("layout_id").alias("layout_id"))


def paragraph_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small boxes with more than 0.2 of their area over a text layout."""
    texts = layouts(spark, sf_dir).filter(is_text_layout(F.col("class")))
    return S.overlap_join(chars(spark, sf_dir), texts, ["page"], 50.0).filter(S.covered(F.col("a"), F.col("b")) > OVER_PARAGRAPH).select("char_id").distinct()


def line_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    return histogram_gaps(chars(spark, sf_dir), ["page"], a["y"], a["y2"])


def nearest_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far down a layout may grow: the highest upper edge of those below it that share columns with it; null if none."""
    all_ = layouts(spark, sf_dir)
    me = all_.select("page", F.col("layout_id").alias("i"), F.col("b").alias("a"))
    strip = lambda c: F.explode(F.sequence(F.floor(F.col(c)["x"] / 50), F.floor(F.col(c)["x2"] / 50)))
    pairs = me.withColumn("s", strip("a")).join(all_.withColumn("s", strip("b")), ["page", "s"])
    a, b = F.col("a"), F.col("b")
    below = (F.least(a["x2"], b["x2"]) > F.greatest(a["x"], b["x"])) & (b["y2"] < a["y"])
    return me.join(pairs.filter(below).groupBy("i").agg(F.max(b["y2"]).alias("floor")), "i", "left").select("i", "floor")


def line_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = layouts(spark, sf_dir).select("page", F.col("layout_id").alias("id"), "b")
    return neighbours(lines, ["page"], 0.5).groupBy("i").agg(F.count("*").alias("n"), F.min("j").alias("first"))


def paragraph_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of a page's rows of ten, by size and font."""
    c = F.col("char_id")
    rows = chars(spark, sf_dir).select(F.expr("char_id div 10").alias("row"), "char_id", F.when(c % 40 < 20, "a").when(c % 7 == 0, "b").otherwise("c").alias("font"), (F.lit(10.0) + (F.col("p_size") % 4) * F.when(c % 30 < 15, 0.005).otherwise(0.5)).alias("size"))
    found = shared_style(rows, "row", "char_id")
    return found.select("row", "font", F.round("size", 6).alias("size"))


def reading_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_groups(layouts(spark, sf_dir).select("page", F.col("layout_id").alias("id"), "b"), ["page"])


def char_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(chars(spark, sf_dir).select("page", F.col("char_id").alias("id"), F.col("a").alias("b")), ["page"])


QUERIES = {f.__name__: f for f in (char_paragraphs, char_formulas, formula_offsets, formula_visual, paragraph_curves, line_histogram, nearest_floor, line_alignments, paragraph_styles, reading_places, char_lines)}
_YS = "greatest(least(f.y2, a.y2) - greatest(f.y, a.y), 0) / least(f.y2 - f.y, a.y2 - a.y)"
ORACLE_SQL = {
    "char_paragraphs": f"""WITH RECURSIVE {_C}, {_L}, i AS (SELECT a.char_id, min((b.layout_id, b.class)) AS m FROM c a JOIN l b ON a.page = b.page AND {_OV} / {_AR} > 0.5 GROUP BY a.char_id),
        r AS MATERIALIZED (SELECT c.page, c.char_id, CAST(m[1] AS BIGINT) AS layout, c.char_id % 17 = 0 AS xobj, c.char_id % 11 = 0 AS space, (x2 - x) * (y2 - y) < 45 AS small, c.char_id % 19 = 0 AS flat,
            row_number() OVER (PARTITION BY c.page ORDER BY c.char_id) AS n FROM c JOIN i USING (char_id) WHERE m[2] IN ('title', 'text')),
        f AS (SELECT page, char_id, n, layout AS own, xobj, 0 AS paragraph FROM r WHERE n = 1
              UNION ALL SELECT r.page, r.char_id, r.n, CASE WHEN new THEN r.layout ELSE own END, r.xobj, paragraph + CASE WHEN new THEN 1 ELSE 0 END
              FROM (SELECT r.*, f.own, f.paragraph, NOT ((r.small AND r.layout = f.own) OR r.flat) AND ((r.layout <> f.own AND NOT r.space) OR r.xobj <> f.xobj) AS new FROM f JOIN r ON r.page = f.page AND r.n = f.n + 1) r)
        SELECT page, paragraph, count(*) AS n, min(char_id) AS first, max(char_id) AS last FROM f GROUP BY ALL""",
    "char_formulas": f"""WITH RECURSIVE {_C}, r AS MATERIALIZED (SELECT char_id // 25 AS line, char_id, char_id % 13 = 0 AS fixed, char_id % 23 = 0 AS bare, char_id % 7 = 0 AS starts, char_id % 7 < 3 AS goes, p_size::DOUBLE AS size,
            char_id % 11 = 0 AS space, char_id % 22 = 0 AS blank, char_id % 100 = 50 AS bullet, row_number() OVER w AS n, lead(p_size::DOUBLE) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY char_id // 25 ORDER BY char_id)),
        t AS (SELECT line, 0::BIGINT AS n, 0::BIGINT AS char_id, false AS formula, false AS mark, -1 AS run, NULL::DOUBLE AS size, false AS space, bullet FROM r WHERE n = 1
              UNION ALL SELECT line, n, char_id, g, m, run + CASE WHEN n = 1 OR g <> inside THEN 1 ELSE 0 END, size, space, bulleted
              FROM (SELECT *, CASE WHEN blank THEN inside ELSE (CASE WHEN bare THEN inside WHEN inside THEN goes ELSE starts END) OR fixed OR m END AS g
                    FROM (SELECT r.*, t.formula AS inside, t.run AS run, t.bullet AS bulleted,
                            CASE WHEN r.space OR t.space OR t.bullet THEN false WHEN t.size IS NOT NULL THEN r.size < t.size * (CASE WHEN t.mark THEN 1.1::DOUBLE ELSE 0.79 END) ELSE coalesce(r.size < r.nxt * 0.79::DOUBLE, false) END AS m
                          FROM t JOIN r ON r.line = t.line AND r.n = t.n + 1)))
        SELECT line, char_id, formula, mark, run FROM t WHERE n > 0""",
    "formula_offsets": f"""WITH {_C}, {_L}, p AS (SELECT f.layout_id, f.x, f.y, a.char_id, a.x AS ax, a.x2 AS ax2, a.y AS ay, a.x2 <= f.x AS left_, a.x >= f.x2 AS right_, f.x - a.x2 AS lg, a.x - f.x2 AS rg, {_YS} AS s
            FROM l f JOIN c a ON a.page = f.page AND f.class = 'formula' AND {_YS} > 0.6),
        b AS (SELECT layout_id, arg_min(s, (lg, char_id)) FILTER (left_) AS ls, arg_min(ax2, (lg, char_id)) FILTER (left_) AS lx, arg_min(ay, (lg, char_id)) FILTER (left_) AS ly,
            arg_min(s, (rg, char_id)) FILTER (right_) AS rs, arg_min(ay, (rg, char_id)) FILTER (right_) AS ry FROM p GROUP BY layout_id),
        o AS (SELECT l.layout_id, l.x - lx AS dx, ls IS NOT NULL AND (rs IS NULL OR ls >= rs) AS hl, CASE WHEN ls IS NOT NULL AND (rs IS NULL OR ls >= rs) THEN l.y - ly WHEN rs IS NOT NULL AND (ls IS NULL OR rs >= ls) THEN l.y - ry ELSE 0 END AS dy
            FROM l LEFT JOIN b USING (layout_id) WHERE class = 'formula')
        SELECT layout_id AS f_id, round(CASE WHEN NOT hl OR abs(dx) < 0.1 OR dx > 10 OR dx < -5 THEN 0 ELSE dx END, 6)::DOUBLE AS x_offset, round(CASE WHEN abs(dy) < 0.1 THEN 0 ELSE dy END, 6)::DOUBLE AS y_offset FROM o""",
    "formula_visual": f"""WITH {_C}, {_L}, v AS (SELECT *, CASE char_id % 5 WHEN 0 THEN 40 WHEN 1 THEN 3 ELSE 0 END AS far FROM c),
        a AS (SELECT page, char_id, y, y2, CASE WHEN greatest(x2 - x - far, 0) / (x2 - x) < 0.2::DOUBLE THEN x ELSE x + far END AS x, CASE WHEN greatest(x2 - x - far, 0) / (x2 - x) < 0.2::DOUBLE THEN x2 ELSE x2 + far END AS x2 FROM v)
        SELECT a.char_id, min(b.layout_id) AS layout_id FROM a JOIN l b ON a.page = b.page AND b.class = 'formula' AND {_OV} / {_AR} > 0.4 GROUP BY a.char_id""",
    "paragraph_curves": f"WITH {_C}, {_L} SELECT DISTINCT a.char_id FROM c a JOIN l b ON a.page = b.page AND b.class IN ('title', 'text') AND {_OV} / {_AR} > 0.2",
    "line_histogram": f"""WITH {_C}, t AS (SELECT page, max(y2) AS top FROM c GROUP BY page), e AS (SELECT page, unnest(range(CAST(floor((top - y2) / 0.25) AS BIGINT), CAST(floor((top - y) / 0.25) AS BIGINT) + 1)) AS i FROM c JOIN t USING (page)),
        d AS (SELECT DISTINCT page, i FROM e), g AS (SELECT page, i, lead(i) OVER (PARTITION BY page ORDER BY i) AS j FROM d) SELECT page, i + 1 AS first, j - 1 AS last FROM g WHERE j > i + 1""",
    "nearest_floor": f"""WITH {_L} SELECT a.layout_id AS i, max(b.y2) AS floor FROM l a LEFT JOIN l b ON a.page = b.page AND least(a.x2, b.x2) > greatest(a.x, b.x) AND b.y2 < a.y GROUP BY a.layout_id""",
    "line_alignments": f"""WITH {_L}, p AS (SELECT a.layout_id AS i, b.layout_id AS j FROM (SELECT *, (y2 - y) * 0.5::DOUBLE AS d FROM l) a JOIN l b ON a.page = b.page AND a.layout_id <> b.layout_id
            AND least(a.x2, b.x2) > greatest(a.x, b.x) AND least(a.y2 + d, b.y2) > greatest(a.y - d, b.y) AND abs(a.y2 - a.y - (b.y2 - b.y)) <= d
            AND (abs(a.x - b.x) <= d OR abs(a.x2 - b.x2) <= d OR abs((a.x + a.x2) / 2 - (b.x + b.x2) / 2) <= d))
        SELECT i, count(*) AS n, min(j) AS first FROM p GROUP BY i""",
    "paragraph_styles": f"""WITH RECURSIVE {_C}, r AS MATERIALIZED (SELECT char_id // 10 AS row, char_id, CASE WHEN char_id % 40 < 20 THEN 'a' WHEN char_id % 7 = 0 THEN 'b' ELSE 'c' END AS font,
            10 + (p_size % 4) * (CASE WHEN char_id % 30 < 15 THEN 0.005::DOUBLE ELSE 0.5 END) AS size, row_number() OVER (PARTITION BY char_id // 10 ORDER BY char_id) AS n FROM c),
        f AS (SELECT row, n, font, size FROM r WHERE n = 1
              UNION ALL SELECT r.row, r.n, CASE WHEN f.size IS NULL OR f.font = r.font THEN r.font END, CASE WHEN f.size IS NULL THEN r.size WHEN abs(f.size - r.size) < 0.02::DOUBLE THEN f.size END FROM f JOIN r ON r.row = f.row AND r.n = f.n + 1),
        e AS (SELECT row, arg_max(struct_pack(font := font, size := size), n) AS s FROM f GROUP BY row),
        mf AS (SELECT row, arg_max(font, (n, -first)) AS m FROM (SELECT row, font, count(*) AS n, min(char_id) AS first FROM r GROUP BY ALL) GROUP BY row),
        ms AS (SELECT row, arg_max(size, (n, -first)) AS m FROM (SELECT row, size, count(*) AS n, min(char_id) AS first FROM r GROUP BY ALL) GROUP BY row)
        SELECT row, coalesce(s.font, mf.m) AS font, round(coalesce(s.size, ms.m), 6) AS size FROM e JOIN mf USING (row) JOIN ms USING (row)""",
}
