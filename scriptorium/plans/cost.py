"""Prices of model calls: priority and tier lookups, formula, rollup, allocation, guardrail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.runtime import table

#: Fixed value: cost above which a job fails; exactly this much passes.
GUARDRAIL = 10.0

TIERS = "array<struct<max_input_tokens:bigint,input:double,output:double,cache_hit:double>>"
CATALOG = [
    (0, "vendor-a", "large", None, [(1000, 0.010, 0.030, 0.001), (None, 0.020, 0.060, 0.002)]),
    (1, "vendor-a", "large-x", "eu", [(None, 0.011, 0.033, 0.0)]),
    (2, "vendor-a", "large-x", None, [(500, 0.005, 0.010, 0.0), (2000, 0.006, 0.012, 0.0)]),
    (3, "vendor-b", "mini", None, [(None, 0.0001, 0.0004, 0.00005)]),
    (4, "vendor-b", "mini-v2", None, [(4000, 0.0002, 0.0008, 0.0001), (None, 0.0003, 0.0009, 0.0001)]),
]


def catalog(spark: SparkSession, rows=CATALOG) -> DataFrame:
    return spark.createDataFrame(rows, f"pos int, provider string, entry_model string, region string, tiers {TIERS}")


def resolve_entry(usage: DataFrame, entries: DataFrame) -> DataFrame:
    """Usage rows (provider, model, region) with their catalog entry, null where there's none.

    The exact model and region (or a region-free entry) wins, in catalog order;
    else the longest entry that the model starts with. Only the distinct calls
    are matched, by provider; usage rows then look theirs up.
    """
    entries = entries.withColumnRenamed("provider", "_p").withColumnRenamed("region", "_r")
    same = (F.col("provider") == F.col("_p")) & F.col("model").startswith(F.col("entry_model")) & (F.col("_r").isNull() | F.col("_r").eqNullSafe(F.col("region")))
    calls = usage.select("provider", "model", "region").distinct().join(F.broadcast(entries), same)
    best = Window.partitionBy("provider", "model", "region").orderBy(F.desc(F.length("entry_model")), "pos")
    found = calls.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(F.col("provider").alias("_p"), F.col("model").alias("_m"), F.col("region").alias("_r"), "pos", "entry_model", "tiers")
    on = (F.col("provider") == F.col("_p")) & (F.col("model") == F.col("_m")) & F.col("region").eqNullSafe(F.col("_r"))
    return usage.join(found, on, "left").drop("_p", "_m", "_r")


def tier_of(tiers: Column, tokens: Column) -> Column:
    """The smallest bounded tier that holds the tokens; else the unbounded one; else the last."""
    bounded = F.array_min(F.transform(F.filter(tiers, lambda t: t["max_input_tokens"] >= tokens), lambda t: F.struct(t["max_input_tokens"], t["input"], t["output"], t["cache_hit"])))
    free = F.get(F.filter(tiers, lambda t: t["max_input_tokens"].isNull()), F.lit(0))
    return F.coalesce(bounded, free, F.element_at(tiers, -1))


def price(tier: Column, tokens_in: Column, tokens_out: Column, cache_hit: Column) -> Column:
    paid = F.greatest(tokens_in - cache_hit, F.lit(0))
    return paid / 1000 * tier["input"] + tokens_out / 1000 * tier["output"] + cache_hit / 1000 * tier["cache_hit"]


def exact_price(tier: Column, paid: Column, tokens_out: Column, cache_hit: Column) -> Column:
    """The price as a decimal, of rates of up to nine places; a sum of these is the same in any order, and ties stay ties when rounded."""
    part = lambda tokens, rate: tokens.cast("decimal(18,0)") * (tier[rate] / 1000).cast("decimal(16,12)")
    return part(paid, "input") + part(tokens_out, "output") + part(cache_hit, "cache_hit")


def allocated(parts: DataFrame, key: str, order: str, weight: str, total: Column) -> DataFrame:
    """Parts with their share of an integer total: rounded half to even, the last part taking what is left."""
    of = Window.partitionBy(key)
    parts = parts.withColumn("_sum", F.sum(weight).over(of)).withColumn("_last", F.row_number().over(of.orderBy(F.desc(order))) == 1)
    share = F.when(F.col("_sum") == 0, F.lit(0.0)).otherwise(F.col(weight) / F.col("_sum"))
    parts = parts.withColumn("_rounded", F.bround(total * share).cast("long"))
    others = F.sum(F.when(~F.col("_last"), F.col("_rounded")).otherwise(0)).over(of)
    return parts.withColumn("allocated", F.when(F.col("_last"), total - others).otherwise(F.col("_rounded"))).drop("_sum", "_last", "_rounded")


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as model calls."""
    items = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey") % 5
    model = F.when(k == 0, "large").when(k == 1, "large-x").when(k == 2, "large-x-preview").when(k == 3, "mini-v2-beta").otherwise("mini")
    return items.select(
        F.col("l_orderkey").alias("job_id"),
        F.when(k < 3, "vendor-a").otherwise("vendor-b").alias("provider"),
        model.alias("model"),
        F.when(F.col("l_linestatus") == "O", "eu").alias("region"),
        F.floor(F.col("l_quantity") * 50).cast("long").alias("tokens_in"),
        F.floor(F.col("l_quantity") * 20).cast("long").alias("tokens_out"),
        F.floor(F.col("l_tax") * 1000).cast("long").alias("cache_hit"),
    )


def cost_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, tokens and cost by model and the entry that priced them."""
    usage = resolve_entry(_usage(spark, sf_dir), catalog(spark)).withColumn("tier", tier_of(F.col("tiers"), F.col("tokens_in")))
    paid = F.greatest(F.col("tokens_in") - F.col("cache_hit"), F.lit(0))
    by_tier = usage.groupBy("model", "region", "pos", "tier").agg(F.count("*").alias("n"), F.sum("tokens_in").alias("tokens_in"), F.sum(paid).alias("paid"), F.sum("tokens_out").alias("tokens_out"), F.sum("cache_hit").alias("cache_hit"))
    cost = exact_price(F.col("tier"), F.col("paid"), F.col("tokens_out"), F.col("cache_hit"))
    return by_tier.groupBy("model", "region", F.col("pos").alias("entry"), F.col("tier.input").alias("rate")).agg(F.sum("n").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.round(F.sum(cost), 4).cast("double").alias("cost"))


def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of each job, whether it is over the guardrail, and billable output."""
    usage = resolve_entry(_usage(spark, sf_dir), catalog(spark)).withColumn("tier", tier_of(F.col("tiers"), F.col("tokens_in")))
    cost = price(F.col("tier"), F.col("tokens_in"), F.col("tokens_out"), F.col("cache_hit"))
    out = usage.groupBy("job_id").agg(F.sum("tokens_in").alias("tokens_in"), F.sum(F.col("tokens_out") + F.col("cache_hit")).alias("billable_output"), F.sum(cost).alias("c"))
    return out.select("job_id", "tokens_in", "billable_output", F.bround("c", 8).alias("cost"), (F.bround("c", 8) > GUARDRAIL).alias("over"))


def cost_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's 10,007 tokens over its lines by quantity."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.floor("l_quantity").cast("long")).alias("q"))
    return allocated(lines, "l_orderkey", "l_linenumber", "q", F.lit(10_007).cast("long")).select("l_orderkey", "l_linenumber", "allocated")


def usage_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each stage as the difference of running totals of a user's events."""
    events = table(spark, sf_dir, "events").withColumn("tokens", F.floor("value").cast("long"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    running = events.withColumn("total", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    deltas = running.withColumn("delta", F.col("total") - F.coalesce(F.lag("total").over(w), F.lit(0)))
    return deltas.groupBy("event_type").agg(F.sum("delta").alias("tokens"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (cost_price, cost_rollup, cost_allocation, usage_delta)}

_N = lambda x: "NULL" if x is None else repr(x)
_TIERS_SQL = ", ".join(f"({p}, '{v}', '{m}', {_N(r)}, {i}, {_N(t[0])}::BIGINT, {t[1]}::DOUBLE, {t[2]}::DOUBLE, {t[3]}::DOUBLE)" for p, v, m, r, ts in CATALOG for i, t in enumerate(ts))
_PRICED = f"""
        WITH t(pos, provider, entry_model, region, i, bound, pin, pout, phit) AS (VALUES {_TIERS_SQL}),
        u AS (SELECT l_orderkey AS job_id, CASE WHEN l_orderkey % 5 < 3 THEN 'vendor-a' ELSE 'vendor-b' END AS provider,
              CASE l_orderkey % 5 WHEN 0 THEN 'large' WHEN 1 THEN 'large-x' WHEN 2 THEN 'large-x-preview' WHEN 3 THEN 'mini-v2-beta' ELSE 'mini' END AS model,
              CASE WHEN l_linestatus = 'O' THEN 'eu' END AS region, CAST(floor(l_quantity * 50) AS BIGINT) AS tokens_in, CAST(floor(l_quantity * 20) AS BIGINT) AS tokens_out, CAST(floor(l_tax * 1000) AS BIGINT) AS cache_hit FROM lineitem),
        k AS (SELECT DISTINCT provider, model, region FROM u),
        e AS (SELECT k.provider, k.model, k.region, t.pos, row_number() OVER (PARTITION BY k.provider, k.model, k.region ORDER BY length(t.entry_model) DESC, t.pos) AS n
              FROM k JOIN (SELECT DISTINCT pos, provider, entry_model, region FROM t) t ON t.provider = k.provider AND starts_with(k.model, t.entry_model) AND (t.region IS NULL OR t.region = k.region)),
        b AS (SELECT u.*, e.pos, max(t.i) AS last, min(t.bound) FILTER (t.bound >= u.tokens_in) AS fits, min(t.i) FILTER (t.bound IS NULL) AS free
              FROM (SELECT *, row_number() OVER () AS row FROM u) u JOIN e ON e.n = 1 AND e.provider = u.provider AND e.model = u.model AND e.region IS NOT DISTINCT FROM u.region JOIN t ON t.pos = e.pos GROUP BY ALL),
        x AS (SELECT b.*, t.pin, t.pout, t.phit, greatest(tokens_in - cache_hit, 0) / 1000 * t.pin + tokens_out / 1000 * t.pout + cache_hit / 1000 * t.phit AS cost
              FROM b JOIN t ON t.pos = b.pos AND CASE WHEN fits IS NOT NULL THEN t.bound = fits WHEN free IS NOT NULL THEN t.i = free ELSE t.i = last END)"""
ORACLE_SQL = {
    "cost_price": _PRICED + " SELECT model, region, CAST(pos AS INTEGER) AS entry, pin AS rate, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, round(sum(cost), 4) AS cost FROM x GROUP BY ALL",
    "cost_rollup": _PRICED + """ SELECT job_id, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out + cache_hit) AS BIGINT) AS billable_output,
        CAST(round_even(sum(cost), 8) AS DOUBLE) AS cost, round_even(sum(cost), 8) > 10 AS over FROM x GROUP BY job_id""",
    "cost_allocation": """
        WITH q AS (SELECT l_orderkey, l_linenumber, CAST(sum(floor(l_quantity)) AS BIGINT) AS q FROM lineitem GROUP BY ALL),
        r AS (SELECT *, CASE WHEN sum(q) OVER w = 0 THEN 0 ELSE CAST(round_even(10007 * CAST(q / sum(q) OVER w AS DOUBLE), 0) AS BIGINT) END AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS n FROM q WINDOW w AS (PARTITION BY l_orderkey))
        SELECT l_orderkey, l_linenumber, CAST(CASE WHEN n = 1 THEN 10007 - coalesce(sum(part) FILTER (n > 1) OVER (PARTITION BY l_orderkey), 0) ELSE part END AS BIGINT) AS allocated FROM r""",
    "usage_delta": "SELECT event_type, CAST(sum(floor(value)) AS BIGINT) AS tokens, count(*) AS n FROM events GROUP BY event_type",
}
