"""Analytics of service logs: calls, stages, jobs, percentiles, bins and throughput."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.runtime import table

#: Prompt tokens that every call has, and bounds of the payload's bins.
BOILERPLATE = 760
BINS = (0, 100, 500, 1000, 2000, 5000, 1_000_000_000)
#: What messages look like by kind, in the order in which they are tried; a service passes its own patterns.
#: Named groups are the fields: model, latency, tokens_in, tokens_out, thinking, stage, duration, units, job, final, reason, batches, used.
FORMATS = {
    "call": r"call done model=(?P<model>\S+).*? latency=(?P<latency>[\d.]+) in=(?P<tokens_in>\d+) out=(?P<tokens_out>\d+)(?: thinking=(?P<thinking>\d+))?",
    "stage": r"stage done name=(?P<stage>.+?) seconds=(?P<duration>[\d.]+) units=(?P<units>\d+)",
    "received": r"job received id=(?P<job>[0-9a-f-]+)",
    "finished": r"job finished id=(?P<job>[0-9a-f-]+)",
    "judge": r"judge done model=(?P<model>\S+) latency=(?P<latency>[\d.]+).*? final=(?P<final>[\d.]+)",
    "plan": r"plan stage=(?P<stage>\S+) batches=(?P<batches>\d+) used=(?P<used>[\d.]+)",
    "invalid": r"check failed \((?P<reason>\w+)\)",
}
_FIELDS = {"model": "string", "latency": "double", "tokens_in": "long", "tokens_out": "long", "thinking": "long", "stage": "string", "duration": "double", "units": "long", "job": "string", "final": "double", "reason": "string", "batches": "long", "used": "double"}


def _plain(pattern: str) -> str:
    """The pattern with its named groups as plain ones."""
    return re.sub(r"\(\?P<\w+>", "(", pattern)


def parsed(log: DataFrame, formats: dict[str, str] = FORMATS) -> DataFrame:
    """(time, pos, kind, and the fields of the first pattern that fits) of (time, pos, message)."""
    m = F.col("message")
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(formats.items()):
        kind = F.when(m.rlike(_plain(pattern)), name).otherwise(kind)

    def field(name: str, type_: str) -> Column:
        found = F.lit(None).cast("string")
        for k, pattern in formats.items():
            if name in (at := re.compile(pattern).groupindex):
                found = F.when(F.col("kind") == k, F.regexp_extract(m, _plain(pattern), at[name])).otherwise(found)
        return (found if type_ == "string" else found.try_cast(type_)).alias(name)

    return log.withColumn("kind", kind).filter("kind is not null").select("time", "pos", "kind", *[field(n, t) for n, t in _FIELDS.items()])


def index_percentiles(rows: DataFrame, keys: list[str], value: str, **places: float) -> DataFrame:
    """The keys, and for each named share f the value at place floor(n * f) of the sorted ones, the last at most.

    Values are counted first, so a key's window holds its distinct values only.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    counts = counts.withColumn("_upto", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    at = lambda f: F.least(F.floor(F.col("_n") * F.lit(f)), F.col("_n") - 1)
    return counts.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") > at(f), F.col(value))).alias(name) for name, f in places.items()])


def binned(value: Column) -> Column:
    """Lower bound of the value's bin; null outside."""
    out = F.lit(None).cast("long")
    for lo, hi in zip(BINS, BINS[1:], strict=False):
        out = F.when((value >= lo) & (value < hi), F.lit(lo).cast("long")).otherwise(out)
    return out


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log messages."""
    e = table(spark, sf_dir, "events")
    v, i = F.floor(F.col("value") * 10).cast("long"), F.col("event_id")
    s = lambda c: c.cast("string")
    call = F.concat(F.lit("call done model=m"), s(i % 3), F.lit(" x latency="), s(v % 50), F.lit(".5 in="), s(v), F.lit(" out="), s(v % 97), F.when(i % 2 == 0, F.concat(F.lit(" thinking="), s(i % 5))).otherwise(""))
    stage = F.concat(F.lit("stage done name=Stage "), s(i % 4), F.lit(" seconds="), s(v % 30), F.lit(".25 units="), s(v % 7))
    received = F.concat(F.lit("job received id="), s(F.col("user_id")))
    finished = F.concat(F.lit("job finished id="), s(F.col("user_id")))
    failed = F.concat(F.lit("a check failed ("), F.col("event_type"), F.lit("): x"))
    plan = F.concat(F.lit("plan stage=s"), s(i % 3), F.lit(" batches="), s(v % 40 + 1), F.lit(" used=0."), s(v % 90 + 10))
    k = i % 8
    message = F.when(k < 3, call).when(k == 3, stage).when(k == 4, received).when(k == 5, finished).when(k == 6, failed).when(i % 16 == 7, plan).otherwise("other text")
    return e.select(F.col("ts").alias("time"), i.alias("pos"), message.alias("message"))


def log_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed(_log(spark, sf_dir))
    return rows.groupBy("kind", "model", "reason").agg(F.count("*").alias("n"), F.sum("thinking").alias("thinking"))


def log_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration and share of each stage, longest first."""
    rows = parsed(_log(spark, sf_dir)).filter("kind = 'stage'")
    total = rows.agg(F.sum("duration").alias("total"))
    return rows.groupBy("stage").agg(F.sum("duration").alias("duration"), F.sum("units").alias("units")).crossJoin(F.broadcast(total)).select("stage", F.round("duration", 4).alias("duration"), "units", F.round(F.col("duration") / F.col("total"), 6).alias("share")).orderBy(F.desc("duration"), "stage")


def job_wall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds from a job's last receipt to its last end; the later line of a job wins."""
    rows = parsed(_log(spark, sf_dir)).filter("job is not null")
    at = F.struct("time", "pos")
    ends = rows.groupBy("job").agg(F.max_by("time", F.when(F.col("kind") == "received", at)).alias("start"), F.max_by("time", F.when(F.col("kind") == "finished", at)).alias("end"))
    return ends.filter("start is not null and end is not null").select("job", (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))).alias("wall_us"))


def percentile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = parsed(_log(spark, sf_dir)).filter("kind = 'call'")
    return calls.groupBy("model").agg(F.count("*").alias("n")).join(index_percentiles(calls, ["model"], "latency", p50=0.5, p90=0.9, p99=0.99), "model")


def latency_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = parsed(_log(spark, sf_dir)).filter("kind = 'call'")
    rows = calls.withColumn("bin", binned(F.greatest(F.col("tokens_in") - BOILERPLATE, F.lit(0))))
    each = rows.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.sum("tokens_out") / F.sum("latency"), 6).alias("tokens_per_s"))
    return each.join(index_percentiles(rows, ["bin"], "latency", median_latency=0.5), "bin")


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens a second, and mean concurrency: summed latency over the time from the first start to the last end."""
    calls = parsed(_log(spark, sf_dir)).filter("kind = 'call'").withColumn("end", F.unix_micros(F.col("time").cast("timestamp")) / 1e6)
    span = F.max("end") - F.min(F.col("end") - F.col("latency"))
    return calls.agg(F.count("*").alias("n"), F.round(F.sum("tokens_out") / F.sum("latency"), 6).alias("tokens_per_s"), F.round(F.sum("latency") / span, 6).alias("concurrency"))


def pool_use(spark: SparkSession, sf_dir: str, workers: int = 12) -> DataFrame:
    """Batch plans of each stage: batches, waves of a pool of ``workers``, the share of the pool that these waves use, and the share logged."""
    plans = parsed(_log(spark, sf_dir)).filter("kind = 'plan'").withColumn("waves", F.ceil(F.col("batches") / workers))
    return plans.groupBy("stage").agg(
        F.count("*").alias("n"),
        F.sum("batches").alias("batches"),
        F.sum("waves").alias("waves"),
        F.round(F.sum("batches") / (F.sum("waves") * workers), 6).alias("pool_share"),
        F.round(F.avg("used"), 6).alias("logged_share"),
    )


QUERIES = {f.__name__: f for f in (log_kinds, log_stages, job_wall, percentile_index, latency_bins, throughput, pool_use)}
_L = """e AS (SELECT *, CAST(floor(value * 10) AS BIGINT) AS v, event_id % 8 AS k FROM events),
        c AS (SELECT 'm' || (event_id % 3) AS model, v % 50 + 0.5::DOUBLE AS latency, v AS tokens_in, v % 97 AS tokens_out, CASE WHEN event_id % 2 = 0 THEN event_id % 5 END AS thinking, epoch_us(ts) / 1e6 AS t_end FROM e WHERE k < 3),
        s AS (SELECT 'Stage ' || (event_id % 4) AS stage, v % 30 + 0.25::DOUBLE AS duration, v % 7 AS units FROM e WHERE k = 3)"""
ORACLE_SQL = {
    "log_kinds": f"""WITH {_L}, r AS (SELECT 'call' AS kind, model, NULL::VARCHAR AS reason, thinking FROM c UNION ALL SELECT 'stage', NULL, NULL, NULL FROM s UNION ALL SELECT 'received', NULL, NULL, NULL FROM e WHERE k = 4
        UNION ALL SELECT 'finished', NULL, NULL, NULL FROM e WHERE k = 5 UNION ALL SELECT 'invalid', NULL, event_type, NULL FROM e WHERE k = 6 UNION ALL SELECT 'plan', NULL, NULL, NULL FROM e WHERE event_id % 16 = 7)
        SELECT kind, model, reason, count(*) AS n, CAST(sum(thinking) AS BIGINT) AS thinking FROM r GROUP BY ALL""",
    "log_stages": f"WITH {_L} SELECT stage, round(sum(duration), 4) AS duration, CAST(sum(units) AS BIGINT) AS units, round(sum(duration) / (SELECT sum(duration) FROM s), 6) AS share FROM s GROUP BY stage",
    "job_wall": f"""WITH {_L}, j AS (SELECT CAST(user_id AS VARCHAR) AS job, arg_max(epoch_us(ts), (ts, event_id)) FILTER (k = 4) AS a, arg_max(epoch_us(ts), (ts, event_id)) FILTER (k = 5) AS b FROM e GROUP BY user_id)
        SELECT job, b - a AS wall_us FROM j WHERE a IS NOT NULL AND b IS NOT NULL""",
    "percentile_index": f"""WITH {_L}, l AS (SELECT model, count(*) AS n, list_sort(list(latency)) AS x FROM c GROUP BY model)
        SELECT model, n, x[least(CAST(floor(n * 0.5::DOUBLE) AS BIGINT), n - 1) + 1] AS p50, x[least(CAST(floor(n * 0.9::DOUBLE) AS BIGINT), n - 1) + 1] AS p90, x[least(CAST(floor(n * 0.99::DOUBLE) AS BIGINT), n - 1) + 1] AS p99 FROM l""",
    "latency_bins": f"""WITH {_L}, p AS (SELECT *, greatest(tokens_in - 760, 0) AS q FROM c), b AS (SELECT *, CASE WHEN q < 100 THEN 0 WHEN q < 500 THEN 100 WHEN q < 1000 THEN 500 WHEN q < 2000 THEN 1000 WHEN q < 5000 THEN 2000 ELSE 5000 END AS bin FROM p),
        l AS (SELECT bin, count(*) AS n, list_sort(list(latency)) AS x, sum(tokens_out) / sum(latency) AS r FROM b GROUP BY bin)
        SELECT CAST(bin AS BIGINT) AS bin, n, x[least(n // 2, n - 1) + 1] AS median_latency, round(r, 6) AS tokens_per_s FROM l""",
    "throughput": f"WITH {_L} SELECT count(*) AS n, round(sum(tokens_out) / sum(latency), 6) AS tokens_per_s, round(sum(latency) / (max(t_end) - min(t_end - latency)), 6) AS concurrency FROM c",
    "pool_use": f"""WITH {_L}, p AS (SELECT 's' || (event_id % 3) AS stage, v % 40 + 1 AS b, ('0.' || (v % 90 + 10))::DOUBLE AS used FROM e WHERE event_id % 16 = 7)
        SELECT stage, count(*) AS n, CAST(sum(b) AS BIGINT) AS batches, CAST(sum(ceil(b / 12)) AS BIGINT) AS waves, round(sum(b) / (sum(ceil(b / 12)) * 12), 6) AS pool_share, round(avg(used), 6) AS logged_share FROM p GROUP BY stage""",
}
