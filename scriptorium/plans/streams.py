"""Queries that run a stream to its end and return what reached the sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.runtime import shared_folder, table
from scriptorium.streaming import events as S


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows of a stream over all input there is; state and progress go to the shared folder."""
    spark, name = stream.sparkSession, f"drained_{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{shared_folder(spark)}/{name}")
    if mode == "append":
        out = f"{shared_folder(spark)}/{name}-out"
        writer.format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    out = f"{shared_folder(spark)}/{name}-out"

    def replaced(rows: DataFrame, _batch: int) -> None:
        rows.write.mode("overwrite").parquet(out)  # each batch of a complete stream is the whole result

    writer.foreachBatch(replaced).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    # A glob, as the source takes folders or patterns, not a single file.
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drained(S.tumbling(_events(spark, sf_dir), late="400 days"), "complete")
    return rows.select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(S.sliding(_events(spark, sf_dir), late="400 days"), "complete").select(F.unix_micros("start").alias("start_us"), "n")


def stream_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drained(S.accepted_submissions(_events(spark, sf_dir), 3600, ttl=None))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("accepted").cast("long")).alias("accepted"))


def stream_status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "completed").otherwise(F.col("event_type"))
    rows = drained(S.status_changes(_events(spark, sf_dir).withColumn("status", status), ttl=None))
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def stream_task_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    rows = e.withColumn("status", F.when(F.col("event_id") % 11 == 0, "completed").otherwise("processing")).withColumn("owner", F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string")))
    return drained(S.task_decisions(rows, 86_400, ttl=None)).groupBy("decision").agg(F.count("*").alias("n"))


def stream_enqueued_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = _events(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return drained(S.enqueued_once(twice, "400 days")).groupBy("event_type").agg(F.count("*").alias("n"))


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, S.STAGE_WEIGHTS))
    stage = F.get(names, (F.col("event_id") % len(S.STAGE_WEIGHTS)).cast("int"))
    return drained(S.progress(_events(spark, sf_dir).withColumn("stage", stage).withColumn("fraction", F.col("value") / 100)))


def throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), F.col("event_id").alias("call_id"), (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)).cast("double").alias("at"))
    return S.throttled_starts(calls, 0.0005).groupBy("provider").agg(F.round(F.max(F.col("start") - F.col("at")), 3).alias("longest_wait"), F.count(F.when(F.col("start") > F.col("at"), 1)).alias("waited"))


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_duplicates, stream_status_changes, stream_task_decisions, stream_enqueued_once, stream_progress, throttled)}
_W = ", ".join(f"({i}, '{n}', {w}::DOUBLE)" for i, (n, w) in enumerate(S.STAGE_WEIGHTS.items()))
_N = len(S.STAGE_WEIGHTS)
ORACLE_SQL = {
    "stream_tumbling": "SELECT epoch_us(ts) // 3600000000 * 3600000000 AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sliding": "WITH w AS (SELECT epoch_us(ts) // 3600000000 * 3600000000 - unnest([0, 3600000000]) AS start_us FROM events) SELECT start_us, count(*) AS n FROM w GROUP BY start_us",
    "stream_duplicates": """
        WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
        f AS (SELECT user_id, event_type, n, us AS anchor, 1 AS ok FROM e WHERE n = 1
              UNION ALL SELECT e.user_id, e.event_type, e.n, CASE WHEN e.us - f.anchor > 3600000000 THEN e.us ELSE f.anchor END, CASE WHEN e.us - f.anchor > 3600000000 THEN 1 ELSE 0 END
              FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.n = f.n + 1)
        SELECT user_id, count(*) AS n, CAST(sum(ok) AS BIGINT) AS accepted FROM f GROUP BY user_id""",
    "stream_status_changes": """WITH w AS (SELECT CASE WHEN event_type = 'purchase' THEN 'completed' ELSE event_type END AS status, lag(event_type) OVER o AS before, event_type,
            coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended
            FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT status, count(*) AS n FROM w WHERE ended = 0 AND (before IS NULL OR before <> event_type) GROUP BY status""",
    "stream_enqueued_once": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "stream_progress": f"""WITH s(i, name, w) AS (VALUES {_W}), t AS (SELECT i, w / sum(w) OVER () AS own, coalesce(sum(w) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(w) OVER () AS before FROM s)
        SELECT user_id, event_id, round(before + own * least(greatest(value / 100, 0), 1), 6) AS progress FROM events JOIN t ON t.i = event_id % {_N}""",
    "throttled": """WITH c AS (SELECT event_type AS provider, event_id, CAST(epoch_us(ts) // 1000000 AS DOUBLE) AS t0 FROM events), n AS (SELECT *, (row_number() OVER w - 1) / 0.0005::DOUBLE AS i FROM c WINDOW w AS (PARTITION BY provider ORDER BY t0, event_id)),
        s AS (SELECT provider, t0, max(t0 - i) OVER (PARTITION BY provider ORDER BY t0, event_id ROWS UNBOUNDED PRECEDING) + i AS start FROM n)
        SELECT provider, round(max(start - t0), 3) AS longest_wait, count(*) FILTER (start > t0) AS waited FROM s GROUP BY provider""",
}
