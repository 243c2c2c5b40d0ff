"""Mixing to target weights by iterative proportional fitting, then calibrated sampling.

Token totals are aggregated into cells of source, language and topic. A cell's
documents are drawn with one probability, the product of one factor of its
source, one of its language and one of its topic, 1 at most. Raking sets the
factors of one dimension after the other, each so that the tokens drawn of its
value are the target's share of the budget, with cells at 1 taken as they are;
that is proportional fitting that holds capped cells fixed and gives what they
lack to the cells still open. Sweeps go on until all marginals are met to
``TOLERANCE`` of the budget, or ``MOST_SWEEPS`` are done, as where targets
contradict each other. ``marginals`` reports what was met.

Unless given, a target is the tempered share of the corpus, the share to the
power ``ALPHA``. A value can't give more than all its tokens: a target beyond
that at the budget is lowered to it, and the others share the rest in proportion.

Only the cell table is iterated over; it has as many rows as there are
combinations. Up to ``FEW_CELLS`` come to the driver; beyond, they stay a
DataFrame, cut in every sweep. Topics come from a column, or
else from marks in the text, a rule that tells forms of text apart and no model.

Defined results: null source, language or topic is a value of its own; null and
empty texts have no tokens and, by the marks, topic ``none``; a cell without
tokens is drawn at the budget's rate; values without a target are not drawn;
rows of one id are drawn or left together inside a cell; a null id's digest is
that of the empty text; columns of the input pass unchanged; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, spread, table

ALPHA = 0.7
#: Share of all tokens to draw.
BUDGET = 0.5
#: Share of the budget by which a marginal may miss its target, and sweeps after which raking stops anyhow.
TOLERANCE, MOST_SWEEPS = 1e-6, 60
DIMENSIONS = ("source", "lang", "topic")
#: Cells that are raked on the driver and broadcast to the documents; beyond, the same steps are taken over a table, and joins shuffle.
FEW_CELLS = 200_000
#: Topics by their marks, the first that fits: (name, pattern over the text).
TOPICS = (("license", r"(?i:licensed? under|all rights reserved)"), ("table", r"\|"), ("contact", r"@|\d{3}[- ]\d{4}"))


def tokens_of(text: Column) -> Column:
    """Words of a text, cut at the six ASCII white-space characters."""
    words = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.filter(words, lambda w: w != "")).cast("long")


def topic_of(text: Column) -> Column:
    out = F.when(F.coalesce(text, F.lit("")) == "", F.lit("none"))
    for name, pattern in TOPICS:
        out = out.when(text.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("prose"))


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None) -> list[Column]:
    """source, lang, topic (null as ``?``), tokens, and the document's uniform number ``u``."""
    text = docs[text_col].cast("string")
    value = lambda c: F.coalesce(docs[c].cast("string"), F.lit("?"))
    topic = value(topic_col) if topic_col else topic_of(text)
    return [value("source").alias("source"), value("lang").alias("lang"), topic.alias("topic"), tokens_of(text).alias("tokens"), uniform(docs[id_col]).alias("u")]


def cells_of(marks: DataFrame) -> DataFrame:
    """tokens and n_docs of each source, lang and topic."""
    return marks.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs"))


def tempered(cells: DataFrame, dimension: str, alpha: float = ALPHA) -> DataFrame:
    """Target share of each value of a dimension: its share of tokens to the power alpha, normalised."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").alias("n")).filter("n > 0").select(dimension, F.pow(F.col("n").cast("double"), alpha).alias("w"))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("w").alias("total")))).select(dimension, (F.col("w") / F.col("total")).alias("target"))


def _factor(weight: Column, cap: Column, goal: Column, keys: list[str], ties: tuple[str, ...]) -> Column:
    """The factor f of each group for which sum(least(cap, f * weight)) is its goal; that which caps all rows if there's none.

    With rows by the factor that caps them, those capped at the solution come
    first: the rows up to which the sum doesn't pass the goal.
    """
    at = cap / weight
    up = Window.partitionBy(*keys).orderBy(at, *ties)
    after = Window.partitionBy(*keys).orderBy(at.desc(), *[F.desc(t) for t in ties]).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(cap).over(up.rowsBetween(Window.unboundedPreceding, 0)) + at * F.coalesce(F.sum(weight).over(after), F.lit(0.0))
    return F.struct((total <= goal).alias("capped"), at.alias("at"))


def _fitted(rows: DataFrame, keys: list[str], goal: str, ties: tuple[str, ...]) -> DataFrame:
    """The rows with ``weight`` times its group's factor (cap in ``tokens``)."""
    rows = rows.withColumn("_f", _factor(F.col("weight"), F.col("tokens"), F.col(goal), keys, ties))
    group = Window.partitionBy(*keys)
    held = F.coalesce(F.sum(F.when(F.col("_f.capped"), F.col("tokens"))).over(group), F.lit(0.0))
    open_ = F.sum(F.when(~F.col("_f.capped"), F.col("weight"))).over(group)
    factor = F.coalesce((F.col(goal) - held) / open_, F.max("_f.at").over(group))
    return rows.withColumn("weight", F.col("weight") * factor).drop("_f")


def reachable(cells: DataFrame, target: DataFrame, dimension: str, budget: float = BUDGET) -> DataFrame:
    """The dimension's values with ``goal``: tokens to draw, the target's share of the budget or all that the value has."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("tokens"))
    rows = sums.join(target, dimension).filter("tokens > 0 and target > 0")
    everything = F.broadcast(cells.agg((F.sum("tokens") * F.lit(float(budget))).alias("all_goal")))
    rows = rows.crossJoin(everything).withColumn("one", F.lit(1)).withColumn("weight", F.col("target"))
    return _fitted(rows, ["one"], "all_goal", (dimension,)).select(dimension, F.least("tokens", "weight").alias("goal"))


def _fitted_array(weight: np.ndarray, cap: np.ndarray, goal: np.ndarray, group: np.ndarray) -> np.ndarray:
    """``_fitted`` over arrays; goals by number of group."""
    at = cap / weight
    order = np.lexsort((at, group))
    g, w, c, a = group[order], weight[order], cap[order], at[order]
    bounds = np.searchsorted(g, np.arange(len(goal) + 1))
    total = np.empty(len(g))
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        behind = np.append(np.cumsum(w[i:j][::-1])[::-1][1:], 0.0)
        total[i:j] = np.cumsum(c[i:j]) + a[i:j] * behind
    capped = total <= goal[g]
    held, open_ = np.bincount(g, c * capped, len(goal)), np.bincount(g, w * ~capped, len(goal))
    largest = np.zeros(len(goal))
    np.maximum.at(largest, g, a)
    return weight * np.where(open_ > 0, (goal - held) / np.where(open_ > 0, open_, 1.0), largest)[group]


def _raked_here(rows: DataFrame, dimensions: list[str], tolerance: float, most_sweeps: int) -> DataFrame:
    """``p`` of few cells, raked on the driver."""
    found = rows.collect()
    cap, weight = (np.array([r[c] for r in found]) for c in ("tokens", "weight"))
    groups, goals = {}, {}
    for d in dimensions:
        names, groups[d] = np.unique(np.array([r[d] for r in found], object), return_inverse=True)
        goals[d] = np.zeros(len(names))
        goals[d][groups[d]] = [r[f"goal_{d}"] for r in found]
    for _ in range(most_sweeps):
        for d in dimensions:
            weight = _fitted_array(weight, cap, goals[d], groups[d])
        taken = np.minimum(cap, weight)
        if max(abs(np.bincount(groups[d], taken, len(goals[d])) - goals[d]).max() for d in dimensions) <= tolerance:
            break
    p = np.minimum(cap, weight) / cap
    return rows.sparkSession.createDataFrame([(*(r[d] for d in DIMENSIONS), float(x)) for r, x in zip(found, p, strict=True)], "source string, lang string, topic string, p double")


def _raked_there(rows: DataFrame, dimensions: list[str], tolerance: float, most_sweeps: int) -> DataFrame:
    """``p`` of cells of any number, raked as a table."""
    taken = F.least("tokens", "weight")
    for _ in range(most_sweeps):
        for d in dimensions:
            rows = _fitted(rows, [d], f"goal_{d}", DIMENSIONS)
        rows = cut(rows)
        missed = [rows.groupBy(d).agg(F.abs(F.sum(taken) - F.first(f"goal_{d}")).alias("off")) for d in dimensions]
        if max(m.agg(F.max("off")).first()[0] for m in missed) <= tolerance:
            break
    return rows.select(*DIMENSIONS, (taken / F.col("tokens")).alias("p"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], budget: float = BUDGET, tolerance: float = TOLERANCE, most_sweeps: int = MOST_SWEEPS, few_cells: int = FEW_CELLS) -> DataFrame:
    """The cells with ``p``, the probability of their documents, and ``weight``, their share of the tokens drawn."""
    everything = cells.agg(F.sum("tokens")).first()[0] or 0
    rows = cells.filter("tokens > 0").withColumn("tokens", F.col("tokens").cast("double")).withColumn("weight", F.col("tokens") * F.lit(float(budget)))
    for dimension, target in targets.items():
        rows = rows.join(reachable(cells, target, dimension, budget).withColumnRenamed("goal", f"goal_{dimension}"), dimension)
    rows = cut(rows)
    n = rows.count()
    if n:
        drawn = (_raked_here if n <= few_cells else _raked_there)(rows, list(targets), tolerance * everything * budget, most_sweeps)
    else:
        drawn = rows.select(*DIMENSIONS, F.lit(0.0).alias("p"))
    cells = cells.join(drawn, list(DIMENSIONS), "left").withColumn("p", F.when(F.col("tokens") > 0, F.coalesce("p", F.lit(0.0))).otherwise(F.lit(float(budget))))
    total = F.broadcast(cells.agg(F.sum(F.col("p") * F.col("tokens")).alias("_all")))
    return cells.crossJoin(total).withColumn("weight", F.coalesce(F.try_divide(F.col("p") * F.col("tokens"), "_all"), F.lit(0.0))).drop("_all")


def marginals(raked: DataFrame, targets: dict[str, DataFrame], budget: float = BUDGET) -> DataFrame:
    """dimension, value, the target share, the share that can be reached at the budget, and the share drawn."""
    out = None
    for dimension, target in targets.items():
        goal = reachable(raked, target, dimension, budget)
        share = goal.crossJoin(F.broadcast(goal.agg(F.sum("goal").alias("all_goal")))).select(dimension, (F.col("goal") / F.col("all_goal")).alias("reachable"))
        rows = raked.groupBy(dimension).agg(F.sum("weight").alias("drawn")).join(target, dimension, "left").join(share, dimension, "left")
        rows = rows.select(F.lit(dimension).alias("dimension"), F.col(dimension).alias("value"), "target", "reachable", "drawn")
        out = rows if out is None else out.union(rows)
    return out


def uniform(id_col: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def _drawn_at(marks: DataFrame, cells: DataFrame) -> DataFrame:
    cells = cells.select(*DIMENSIONS, "weight", "p")
    return marks.join(F.broadcast(cells) if cells.count() <= FEW_CELLS else cells, list(DIMENSIONS))


def fitted_cells(marks: DataFrame, targets: dict[str, DataFrame] | None = None, alpha: float = ALPHA, budget: float = BUDGET) -> DataFrame:
    """The cells of the marked documents with ``weight`` and ``p``."""
    cells = cut(cells_of(marks))
    return cut(rake(cells, targets or {d: cut(tempered(cells, d, alpha)) for d in DIMENSIONS}, budget))


def chances(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None, **options) -> DataFrame:
    """Each document's id with its cell, the cell's ``weight`` and ``p``, and its uniform number ``u``; texts are read once."""
    marks = cut(docs.select(docs[id_col].alias("_id"), *placed(docs, id_col, text_col, topic_col)))
    return _drawn_at(marks, fitted_cells(marks, **options)).select(F.col("_id").alias(id_col), *DIMENSIONS, "tokens", "weight", "p", "u")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None, **options) -> DataFrame:
    """The documents drawn, with their own columns; options as for ``fitted_cells``.

    Texts are read twice, which costs less than writing all of them in between.
    """
    marks = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *placed(docs, id_col, text_col, topic_col))
    return _drawn_at(marks, fitted_cells(marks.drop("row"), **options)).filter("u < p").select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chances(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")))
    return found.select("doc_id", *DIMENSIONS, F.round("weight", 6).alias("weight"), F.round("p", 6).alias("p"), (F.col("u") < F.col("p")).alias("drawn"))


def _sql() -> str:
    """The same in SQL: one recursive step fits one dimension."""
    marks = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS)
    fit = """SELECT *, weight * coalesce((goal - coalesce(sum(CASE WHEN capped THEN tokens END) OVER g, 0)) / sum(CASE WHEN NOT capped THEN weight END) OVER g, max(edge) OVER g) AS fitted
        FROM (SELECT *, sum(tokens) OVER (PARTITION BY k ORDER BY edge, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + edge * coalesce(sum(weight) OVER (PARTITION BY k ORDER BY edge DESC, tie DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= goal AS capped
              FROM (SELECT *, tokens / weight AS edge FROM ({}))) WINDOW g AS (PARTITION BY k)"""
    steps = [
        f"""d AS MATERIALIZED (SELECT doc_id, coalesce(source, '?') AS source, coalesce(lang, '?') AS lang,
            CASE WHEN coalesce(text, '') = '' THEN 'none' {marks} ELSE 'prose' END AS topic,
            len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS t,
            CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM documents)""",
        "c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(t) AS DOUBLE) AS tokens FROM d GROUP BY ALL)",
        f"b AS MATERIALIZED (SELECT sum(tokens) * {BUDGET} AS goal FROM c)",
    ]
    for k in DIMENSIONS:
        inner = f"SELECT {k}, 1 AS k, {k} AS tie, tokens, w / sum(w) OVER () AS weight, (SELECT goal FROM b) AS goal FROM (SELECT {k}, sum(tokens) AS tokens, pow(sum(tokens), {ALPHA}) AS w FROM c GROUP BY {k} HAVING sum(tokens) > 0)"
        steps.append(f"g_{k} AS MATERIALIZED (SELECT {k}, least(tokens, fitted) AS goal_{k} FROM ({fit.format(inner)}))")
    off = ", ".join(f"abs(sum(least(tokens, weight)) OVER (PARTITION BY {k}) - goal_{k}) AS off_{k}" for k in DIMENSIONS)
    pick = lambda col: "CASE i % 3 " + " ".join(f"WHEN {n} THEN {col.format(k)}" for n, k in enumerate(DIMENSIONS)) + " END"
    columns = "source, lang, topic, tokens"
    goals = ", ".join(f"goal_{k}" for k in DIMENSIONS)
    todo = f"SELECT *, {pick('{}')} AS k, source || chr(1) || lang || chr(1) || topic AS tie, {pick('goal_{}')} AS goal FROM (SELECT *, max(greatest({', '.join(f'off_{k}' for k in DIMENSIONS)})) OVER () AS off FROM (SELECT *, {off} FROM r)) WHERE i < {3 * MOST_SWEEPS} AND (i = 0 OR i % 3 <> 0 OR off > {TOLERANCE} * (SELECT goal FROM b))"
    steps.append(f"""r AS (SELECT 0 AS i, {columns}, tokens * {BUDGET} AS weight, {goals} FROM c {' '.join(f'JOIN g_{k} USING ({k})' for k in DIMENSIONS)} WHERE tokens > 0
        UNION ALL SELECT i + 1, {columns}, fitted, {goals} FROM ({fit.format(todo)}))""")
    steps.append(f"p AS (SELECT {columns}, CASE WHEN c.tokens = 0 THEN {BUDGET} ELSE coalesce(least(c.tokens, r.weight) / c.tokens, 0) END AS p FROM c LEFT JOIN (SELECT source, lang, topic, weight FROM r WHERE i = (SELECT max(i) FROM r)) r USING (source, lang, topic))")
    steps.append("f AS (SELECT source, lang, topic, p, coalesce(p * tokens / nullif(sum(p * tokens) OVER (), 0), 0) AS weight FROM p)")
    return "WITH RECURSIVE " + ", ".join(steps) + " SELECT doc_id, source, lang, topic, round(weight, 6) AS weight, round(p, 6) AS p, u < p AS drawn FROM d JOIN f USING (source, lang, topic)"


QUERIES = {"op7_mixing": op7_mixing}
ORACLE_SQL = {"op7_mixing": _sql()}
