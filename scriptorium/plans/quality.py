"""Batches, heuristic judging, scores, sampling and the choice between attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import sentence_count, token_estimate
from scriptorium.operators import folds
from scriptorium.plans.text import _PAIRS_SQL, _pairs
from scriptorium.runtime import table

#: Weights of alignment, omission and hallucination; coverage under which a result falls back; reasons kept.
WEIGHTS, LEAST_COVERAGE, REASONS = (0.30, 0.35, 0.35), 0.5, 8
#: Bounds of an adaptive batch.
ADAPTIVE_LEAST, ADAPTIVE_MOST = 600, 2500


def heuristic(source: Column, target: Column) -> Column:
    """Share of sentences of the shorter side, each side having one at least."""
    a, b = F.greatest(sentence_count(source), F.lit(1)), F.greatest(sentence_count(target), F.lit(1))
    return F.least(a, b) / F.greatest(a, b)


def weighted_scores(rows: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """Weighted means of clamped alignment, omission and hallucination, and the final score made of the means."""
    clamp = lambda c: F.least(F.greatest(F.col(c).cast("double"), F.lit(0.0)), F.lit(1.0))
    names = ("alignment", "omission", "hallucination")
    means = rows.groupBy(*keys).agg(*[(F.sum(clamp(c) * weight) / F.sum(weight)).alias(c) for c in names])
    final = sum((F.col(c) * w for c, w in zip(names, WEIGHTS, strict=True)), F.lit(0.0))
    return means.select(*keys, *[F.round(c, 6).alias(c) for c in names], F.round(final, 6).alias("final"))


def best_attempt(attempts: DataFrame, key: str, early: float) -> DataFrame:
    """The best scored attempt among those up to the first that stops the chain (its score reaches ``early``); the earliest of ties; failed ones never win."""
    stop = F.min(F.when(F.col("score") >= early, F.col("attempt"))).over(Window.partitionBy(key))
    tried = attempts.withColumn("stop", stop).filter(F.col("stop").isNull() | (F.col("attempt") <= F.col("stop")))
    best = F.struct(F.col("score"), -F.col("attempt"))
    return tried.groupBy(key).agg(F.count("*").alias("tried"), F.max_by(F.when(F.col("score").isNotNull(), F.col("attempt")), F.when(F.col("score").isNotNull(), best)).alias("best"), F.max("score").alias("score"))


def stratified_sample(rows: DataFrame, key: str, pos: str, cap: int) -> DataFrame:
    """All rows of a key that has ``cap`` at most; else one from each of cap contiguous strata, by a hash."""
    of = Window.partitionBy(key)
    rows = rows.withColumn("_n", F.count("*").over(of)).withColumn("_i", F.row_number().over(of.orderBy(pos)) - 1)
    rows = rows.withColumn("_stratum", F.when(F.col("_n") <= cap, F.col("_i")).otherwise(F.floor(F.col("_i") * cap / F.col("_n"))))
    pick = F.row_number().over(Window.partitionBy(key, "_stratum").orderBy(F.xxhash64(key, pos), pos))
    return rows.withColumn("_pick", pick).filter("_pick = 1").drop("_n", "_i", "_pick").withColumnRenamed("_stratum", "stratum")


def hash_percent(key: Column) -> Column:
    """A number below 100 of the key's SHA-256."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % 100


def adaptive_cap(total: Column, base_tokens: int, base_items: int, workers: int, multiplier: float) -> tuple[Column, Column]:
    """Tokens and items of a batch so that all workers get one, within fixed bounds."""
    sized = F.least(F.greatest(F.ceil(total / workers), F.lit(ADAPTIVE_LEAST)), F.lit(ADAPTIVE_MOST))
    tokens = F.when(total <= 0, F.lit(base_tokens)).otherwise(F.least(sized, F.lit(base_tokens)))
    return F.greatest(F.lit(1), F.floor(tokens * F.lit(multiplier))).cast("long"), F.greatest(F.lit(1), F.floor(F.lit(base_items * multiplier))).cast("long")


def soft_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return folds.soft_batches(turns, ["conv_id"], ["turn"], token_estimate(F.col("text")), 60, 3).select("conv_id", "turn", "batch")


def judge_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return folds.hard_batches(turns, ["conv_id"], ["turn"], F.length("text"), 400).select("conv_id", "turn", "batch")


def judge_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heuristic scores of user turns against answers, weighted by source characters."""
    rows = _pairs(spark, sf_dir).withColumn("h", heuristic(F.col("source"), F.col("target")))
    rows = rows.select("conv_id", F.length("source").alias("w"), F.col("h").alias("alignment"), F.col("h").alias("omission"), F.lit(0.9).alias("hallucination"))
    return weighted_scores(rows, ["conv_id"], F.col("w"))


def judge_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("source", "n_chars", F.col("quality").alias("alignment"), (1 - F.col("toxic")).alias("omission"), F.lit(1.5).alias("hallucination"))
    return weighted_scores(rows, ["source"], F.col("n_chars"))


def judge_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of characters that labelled documents cover, whether that falls back, and the first reasons in order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    judged = F.col("quality").isNotNull()
    coverage = F.least(F.lit(1.0), F.sum(F.when(judged, F.col("n_chars")).otherwise(0)) / F.sum("n_chars"))
    reasons = F.transform(F.slice(F.sort_array(F.collect_list(F.when(judged, F.col("doc_id")))), 1, REASONS), lambda d: d.cast("string"))
    return docs.groupBy("source").agg(F.round(coverage, 6).alias("coverage"), (F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)) | (coverage < LEAST_COVERAGE)).alias("fallback"), F.array_join(reasons, ";").alias("reasons"))


def attempts_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as attempts of their order, discounts as scores; a flag R is a failure."""
    items = table(spark, sf_dir, "lineitem")
    attempts = items.groupBy(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("attempt")).agg(F.max(F.when(F.col("l_returnflag") != "R", F.round(F.col("l_discount") * 10, 3))).alias("score"))
    return best_attempt(attempts, "job", 0.8)


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = stratified_sample(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 12)
    return picked.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("stratum").alias("n_strata"))


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", hash_percent(F.col("doc_id")).alias("bucket")).filter("bucket < 30")


def adaptive_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    totals = docs.groupBy("source").agg(F.sum(token_estimate(F.col("text"))).alias("total"))
    tokens, items = adaptive_cap(F.col("total"), 40_000, 200, 12, 0.5)
    return totals.select("source", "total", tokens.alias("max_tokens"), items.alias("max_items"), F.ceil(F.ceil(F.col("total") / tokens) / 12).cast("long").alias("waves"))


QUERIES = {f.__name__: f for f in (soft_batches, judge_chunks, judge_heuristic, judge_score, judge_coverage, attempts_best, strata, hash_sample, adaptive_batches)}
_SENT = "greatest(1, len(list_filter(regexp_split_to_array({0}, '[.!?。！？]+'), lambda s: trim(s) <> '')))"
ORACLE_SQL = {
    "soft_batches": """
        WITH RECURSIVE u AS (SELECT conv_id, turn, greatest(1, length(text) // 4) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
        f AS (SELECT conv_id, turn, n, 0 AS batch, t > 60 OR 1 > 3 AS closed, t AS size, 1 AS items FROM u WHERE n = 1
              UNION ALL SELECT u.conv_id, u.turn, u.n, f.batch + CASE WHEN f.closed THEN 1 ELSE 0 END,
                CASE WHEN f.closed THEN u.t > 60 OR 1 > 3 ELSE f.size + u.t > 60 OR f.items + 1 > 3 END,
                CASE WHEN f.closed THEN u.t ELSE f.size + u.t END, CASE WHEN f.closed THEN 1 ELSE f.items + 1 END
              FROM f JOIN u ON u.conv_id = f.conv_id AND u.n = f.n + 1)
        SELECT conv_id, turn, batch FROM f""",
    "judge_chunks": """
        WITH RECURSIVE u AS (SELECT conv_id, turn, length(text) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
        f AS (SELECT conv_id, turn, n, 0 AS batch, t AS size FROM u WHERE n = 1
              UNION ALL SELECT u.conv_id, u.turn, u.n, f.batch + CASE WHEN f.size + u.t > 400 THEN 1 ELSE 0 END, CASE WHEN f.size + u.t > 400 THEN u.t ELSE f.size + u.t END
              FROM f JOIN u ON u.conv_id = f.conv_id AND u.n = f.n + 1)
        SELECT conv_id, turn, batch FROM f""",
    "judge_heuristic": "WITH " + _PAIRS_SQL + f""", c AS (SELECT conv_id, length(source) AS w, {_SENT.format('source')} AS a, {_SENT.format('target')} AS b FROM p),
        m AS (SELECT conv_id, sum(least(a, b) / greatest(a, b) * w) / sum(w) AS x, sum(0.9::DOUBLE * w) / sum(w) AS y FROM c GROUP BY conv_id)
        SELECT conv_id, round(x, 6) AS alignment, round(x, 6) AS omission, round(y, 6) AS hallucination, round(x * 0.3::DOUBLE + x * 0.35::DOUBLE + y * 0.35::DOUBLE, 6) AS final FROM m""",
    "judge_score": """
        WITH m AS (SELECT source, sum(quality::DOUBLE * n_chars) / sum(n_chars) AS a, sum((1 - toxic)::DOUBLE * n_chars) / sum(n_chars) AS o, sum(1.0::DOUBLE * n_chars) / sum(n_chars) AS h
                   FROM documents JOIN labels USING (doc_id) GROUP BY source)
        SELECT source, round(a, 6) AS alignment, round(o, 6) AS omission, round(h, 6) AS hallucination, round(a * 0.3::DOUBLE + o * 0.35::DOUBLE + h * 0.35::DOUBLE, 6) AS final FROM m""",
    "judge_coverage": """
        WITH d AS (SELECT source, doc_id, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
        r AS (SELECT source, string_agg(CAST(doc_id AS VARCHAR), ';' ORDER BY doc_id) AS reasons FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM d WHERE quality IS NOT NULL) WHERE n <= 8 GROUP BY source),
        c AS (SELECT source, least(1.0, coalesce(sum(n_chars) FILTER (quality IS NOT NULL), 0) / sum(n_chars)) AS cov, coalesce(bool_or(toxic = 1), false) AS bad FROM d GROUP BY source)
        SELECT source, round(cov, 6) AS coverage, bad OR cov < 0.5 AS fallback, coalesce(reasons, '') AS reasons FROM c LEFT JOIN r USING (source)""",
    "attempts_best": """
        WITH a AS (SELECT l_orderkey AS job, l_linenumber AS attempt, max(CASE WHEN l_returnflag <> 'R' THEN round(l_discount * 10, 3) END) AS score FROM lineitem GROUP BY ALL),
        s AS (SELECT *, min(CASE WHEN score >= 0.8 THEN attempt END) OVER (PARTITION BY job) AS stop FROM a),
        t AS (SELECT * FROM s WHERE stop IS NULL OR attempt <= stop),
        r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY score DESC NULLS LAST, attempt) AS n, count(*) OVER (PARTITION BY job) AS tried FROM t)
        SELECT job, tried, CASE WHEN score IS NOT NULL THEN attempt END AS best, score FROM r WHERE n = 1""",
    "strata": "SELECT source, least(12, count(*)) AS n, least(12, count(*)) AS n_strata FROM documents GROUP BY source",
    "hash_sample": """SELECT doc_id, CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS bucket FROM documents
        WHERE CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 30""",
    "adaptive_batches": """
        WITH t AS (SELECT source, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS total FROM documents GROUP BY source),
        c AS (SELECT source, total, CAST(greatest(1, floor(least(least(greatest(ceil(total / 12), 600), 2500), 40000) * 0.5)) AS BIGINT) AS max_tokens FROM t)
        SELECT source, total, max_tokens, CAST(100 AS BIGINT) AS max_items, CAST(ceil(ceil(total / max_tokens) / 12) AS BIGINT) AS waves FROM c""",
}
