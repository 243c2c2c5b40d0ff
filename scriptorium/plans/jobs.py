"""Job records: lookups, paging, status, duplicates, fan-out, upserts and change streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.operators import folds, upsert
from scriptorium.runtime import table

#: Progress of each state, states that end a job, and seconds in which a submission repeats another.
PROGRESS = {"queued": 0.0, "processing": 0.5, "completed": 1.0, "failed": 1.0, "cancelled": 1.0, "human_review_required": 1.0}
TERMINAL = ("completed", "failed", "cancelled", "human_review_required")
DUPLICATE_SECONDS = 30
IDENTIFIER = r"[A-Za-z0-9_.-]+"


def safe_name(name: str) -> str:
    """A table name that may go into SQL; anything else is refused."""
    import re

    if not re.fullmatch(IDENTIFIER, name):
        raise ValueError(f"not a table name: {name!r}")
    return name


def progress(status: Column) -> Column:
    states = F.create_map(*[F.lit(x) for pair in PROGRESS.items() for x in pair])
    return F.coalesce(states[status], F.lit(0.0))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "queued").otherwise("processing")
    return o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("user_id"), status.alias("status"), F.col("o_orderdate").alias("submitted_at"), F.col("o_totalprice").alias("price"))


def page(rows: DataFrame, limit: int, offset: int = 0, status: str | None = None, user: int | None = None, after: str | None = None) -> DataFrame:
    """Newest first; only given conditions apply; ties by id."""
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    if user is not None:
        rows = rows.filter(F.col("user_id") == user)
    if after is not None:
        rows = rows.filter(F.col("submitted_at") >= F.lit(after).cast("timestamp"))
    return rows.orderBy(F.desc("submitted_at"), "job_id").offset(offset).limit(limit)


def by_ids(rows: DataFrame, ids: list[int], key: str = "job_id") -> DataFrame:
    """Rows of the ids in the order asked for, null where an id is missing; every asked place has a row."""
    asked = rows.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, asked bigint") if ids else rows.sparkSession.createDataFrame([], "pos int, asked bigint")
    return F.broadcast(asked).join(rows, F.col("asked") == F.col(key), "left")


def job_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).filter("job_id = 7").select("job_id", "status", "user_id")


def recent_jobs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(jobs(spark, sf_dir), 25, 50, status="completed", after="1994-01-01").select("job_id", "user_id", "status")


def multi_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_ids(jobs(spark, sf_dir), [5, 3, 3, 999_999_999, 1])
    owned = rows.agg(F.bool_and(F.col("job_id").isNotNull()).alias("all_found"))
    return rows.crossJoin(F.broadcast(owned)).select("pos", "asked", F.coalesce("status", F.lit("missing")).alias("status"), progress(F.col("status")).alias("progress"), "all_found")


def json_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return events.filter("k < 10").groupBy("event_type", "k").agg(F.count("*").alias("n"))


def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row's message, else the one inside the result JSON."""
    from scriptorium.functions.text import coalesced_error

    events = table(spark, sf_dir, "events")
    row = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, "")
    result = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"error_message": "e'), (F.col("event_id") % 7).cast("string"), F.lit('"}'))).otherwise("not json")
    return events.select(F.coalesce(coalesced_error(row, result), F.lit("none")).alias("message")).groupBy("message").agg(F.count("*").alias("n"))


def priority_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)/?$", 1)).alias("suffix"))
    queue = F.when(F.col("suffix").isin("html", "pdf", "docx"), "high").otherwise("default")
    return pages.groupBy("suffix", queue.alias("queue")).agg(F.count("*").alias("n"))


def duplicate_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as submissions: accepted unless one of its user and type was accepted in the hour before."""
    events = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    found = folds.anchored_duplicates(events.withColumn("us", micros), ["user_id", "event_type"], ["us", "event_id"], F.col("us"), 3600 * 1_000_000)
    return found.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("accepted").cast("long")).alias("accepted"))


def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents times targets; pairs that exist already stand in for new ones; numbered in order of request."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    asked = docs.select("doc_id", "lang", F.posexplode(F.array(*map(F.lit, ("en", "de", "fr")))).alias("pos", "target")).filter("target <> lang")
    existing = docs.filter("doc_id % 4 = 0").select("doc_id", F.lit("de").alias("target"), (F.col("doc_id") + 1_000_000).alias("old"))
    numbered = asked.join(existing, ["doc_id", "target"], "left").withColumn("batch_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1)
    return numbered.select("doc_id", "target", "batch_index", F.coalesce("old", F.col("doc_id") * 10 + F.col("pos")).alias("job"))


def dedupe_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content prepared once per hash: the first document of it pays, others share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), "n_chars")
    once = docs.groupBy("hash").agg(F.min("doc_id").alias("owner"), F.count("*").alias("copies"))
    return docs.join(once, "hash").select("doc_id", "owner", "copies", F.when(F.col("doc_id") == F.col("owner"), F.col("n_chars")).otherwise(0).alias("paid"))


def job_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


def review_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers updated from customers of the same key: balances change, names don't."""
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return upsert.merged(old, new, ["id"], ["balance"])


def job_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event sets the columns of its parity; a given null overwrites."""
    log = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("kind"), F.round("value", 3).alias("value"))
    log = log.withColumn("given", F.when(F.col("event_id") % 2 == 0, F.array(F.lit("kind"))).otherwise(F.array(F.lit("kind"), F.lit("value"))))
    return upsert.patched(log, ["user_id"], ["ts", "event_id"], ["kind", "value"])


def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose type differs from the user's one before, up to the first ``purchase``."""
    events = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ended = F.coalesce(F.max((F.col("event_type") == "purchase").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = events.withColumn("before", F.lag("event_type").over(w)).withColumn("ended", ended)
    return seen.filter("ended = 0 and (before is null or before <> event_type)").groupBy("event_type").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (job_point, recent_jobs_page, multi_status, json_path_filter, error_messages, priority_routing, duplicate_submissions, fan_out, dedupe_by_hash, job_upsert, review_upsert, job_patch, status_changes)}
_JOBS = "j AS (SELECT o_orderkey AS job_id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'processing' END AS status, o_orderdate AS submitted_at FROM orders)"
ORACLE_SQL = {
    "job_point": f"WITH {_JOBS} SELECT job_id, status, user_id FROM j WHERE job_id = 7",
    "recent_jobs_page": f"WITH {_JOBS} SELECT job_id, user_id, status FROM j WHERE status = 'completed' AND submitted_at >= '1994-01-01' ORDER BY submitted_at DESC, job_id LIMIT 25 OFFSET 50",
    "multi_status": f"""WITH {_JOBS}, a(pos, asked) AS (VALUES (0, 5::BIGINT), (1, 3), (2, 3), (3, 999999999), (4, 1)), r AS (SELECT * FROM a LEFT JOIN j ON asked = job_id)
        SELECT pos, asked, coalesce(status, 'missing') AS status, CASE status WHEN 'completed' THEN 1.0::DOUBLE WHEN 'processing' THEN 0.5 ELSE 0.0 END AS progress, bool_and(job_id IS NOT NULL) OVER () AS all_found FROM r""",
    "json_path_filter": "SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) < 10 GROUP BY ALL",
    "error_messages": "SELECT CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 2 = 0 THEN 'e' || (event_id % 7) ELSE 'none' END AS message, count(*) AS n FROM events GROUP BY 1",
    "priority_routing": r"""WITH p AS (SELECT lower(regexp_extract(url, '\.([A-Za-z0-9]+)/?$', 1)) AS suffix FROM pages)
        SELECT suffix, CASE WHEN suffix IN ('html', 'pdf', 'docx') THEN 'high' ELSE 'default' END AS queue, count(*) AS n FROM p GROUP BY ALL""",
    "duplicate_submissions": """
        WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
        f AS (SELECT user_id, event_type, n, us AS anchor, 1 AS ok FROM e WHERE n = 1
              UNION ALL SELECT e.user_id, e.event_type, e.n, CASE WHEN e.us - f.anchor > 3600000000 THEN e.us ELSE f.anchor END, CASE WHEN e.us - f.anchor > 3600000000 THEN 1 ELSE 0 END
              FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.n = f.n + 1)
        SELECT user_id, count(*) AS n, CAST(sum(ok) AS BIGINT) AS accepted FROM f GROUP BY user_id""",
    "fan_out": """WITH t(pos, target) AS (VALUES (0, 'en'), (1, 'de'), (2, 'fr'))
        SELECT doc_id, target, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS batch_index,
               CASE WHEN doc_id % 4 = 0 AND target = 'de' THEN doc_id + 1000000 ELSE doc_id * 10 + pos END AS job FROM documents, t WHERE target <> lang""",
    "dedupe_by_hash": """WITH h AS (SELECT doc_id, sha256(text) AS h, n_chars FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS owner, count(*) OVER w AS copies, CASE WHEN doc_id = min(doc_id) OVER w THEN n_chars ELSE 0 END AS paid FROM h WINDOW w AS (PARTITION BY h)""",
    "job_upsert": "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "review_upsert": """SELECT coalesce(s_suppkey, c_custkey) AS id, coalesce(s_name, c_name) AS name, CASE WHEN c_custkey IS NOT NULL THEN c_acctbal ELSE s_acctbal END AS balance
        FROM supplier FULL JOIN customer c ON s_suppkey = c_custkey""",
    "job_patch": """WITH r AS (SELECT user_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS kind, round(value, 3) AS value, event_id % 2 = 1 AS sets,
            row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts DESC, event_id DESC) AS m FROM events)
        SELECT user_id, max(CASE WHEN n = 1 THEN kind END) AS kind, max(CASE WHEN sets AND m = 1 THEN value END) AS value FROM r GROUP BY user_id""",
    "status_changes": """WITH w AS (SELECT event_type, lag(event_type) OVER o AS before, coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended
            FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT event_type, count(*) AS n FROM w WHERE ended = 0 AND (before IS NULL OR before <> event_type) GROUP BY event_type""",
}
