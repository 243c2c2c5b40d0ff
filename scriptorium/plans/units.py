"""Units on their way through passes: each handled once, ordinals among non-blank ones, reports of progress and of splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators.folds import running_rows
from scriptorium.plans.chunks import page_chunks
from scriptorium.plans.text import _PAIRS_SQL, _pairs, pii_masked
from scriptorium.runtime import table
from scriptorium.streaming.events import STAGE_WEIGHTS, progress

#: Parts that a split report lists from the front; seconds between reports of progress; totals up to which all are sent.
LISTED, INTERVAL, SMALL_TOTAL = 15, 0.1, 3
#: Tokens of input or output from which a single unit's lengths are compared.
SINGLE_IN, SINGLE_OUT = 10, 64


def handled_once(passes: list[DataFrame], key: str) -> DataFrame:
    """Each key with the number of the first pass that has it; what a pass handled, later ones leave out."""
    rows = None
    for i, p in enumerate(passes):
        one = p.select(key, F.lit(i).alias("pass"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(key).agg(F.min("pass").alias("pass"))


def unit_order(units: DataFrame, key: str, order: list[str], text: str, all_units: bool = False) -> DataFrame:
    """Units that are not blank with ``chunk_index``: their place among those, or among all units."""
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    units = units.withColumn("_blank", blank)
    if not all_units:
        units = units.filter(~F.col("_blank"))
    placed = units.withColumn("chunk_index", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
    return placed.filter(~F.col("_blank")).drop("_blank")


def reports(events: DataFrame, key: str, order: list[str], at: str, total: str, interval: float = INTERVAL) -> DataFrame:
    """Events with ``sent``: the key's first one, one that comes ``interval`` after the last sent, or any if the total is small."""

    def step(last, at, total):
        sent = last is None or total <= SMALL_TOTAL or at - last >= interval
        return (at if sent else last), (sent,)

    return running_rows(events, [key], order, [at, total], step, "sent boolean")


def of_parts(done: Column, part: Column, parts: Column) -> Column:
    """Progress of a whole from that of one of its parts, the parts before being done."""
    return (part + done) / F.greatest(parts, F.lit(1))


def listed_parts(chunks: DataFrame, key: str, index: str, listed: int = LISTED) -> DataFrame:
    """The first parts of each key, and its last one."""
    of = Window.partitionBy(key)
    rows = chunks.withColumn("_n", F.row_number().over(of.orderBy(index))).withColumn("_all", F.count("*").over(of))
    return rows.filter((F.col("_n") <= listed) | (F.col("_n") == F.col("_all"))).drop("_n", "_all")


def passes_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    found = handled_once([docs.filter("doc_id % 6 = 0"), docs.filter("doc_id % 4 = 0"), docs], "doc_id")
    return found.groupBy("pass").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def non_blank_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "[\n.]")).alias("pos", "t"))
    own = unit_order(lines, "doc_id", ["pos"], "t").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("chunk_index") * F.col("pos")).alias("mark"))
    every = unit_order(lines, "doc_id", ["pos"], "t", all_units=True).groupBy("doc_id").agg(F.max("chunk_index").alias("last"))
    return own.join(every, "doc_id")


def progress_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of users' jobs in parts, in thousandths, and which reports are sent."""
    names = F.array(*map(F.lit, STAGE_WEIGHTS))
    e = table(spark, sf_dir, "events")
    stage = F.get(names, (F.col("event_id") % len(STAGE_WEIGHTS)).cast("int"))
    rows = progress(e.withColumn("stage", stage).withColumn("fraction", F.col("value") / 100)).join(e.select("event_id", (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)).cast("double").alias("at")), "event_id")
    parts = F.col("user_id") % 3 + 1
    rows = rows.withColumn("total", (F.col("user_id") % 6).cast("long")).withColumn("whole", F.floor(of_parts(F.col("progress"), F.col("event_id") % parts, parts) * 1000 + 1e-4))
    sent = reports(rows, "user_id", ["at", "event_id"], "at", "total", 3600.0).select("event_id", "sent")
    return rows.join(sent, "event_id").select("event_id", "whole", "sent")


def split_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listed_parts(page_chunks(spark, sf_dir), "doc_id", "start_page", 2)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("end_page").cast("long").alias("last"))


def single_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of outputs given one by one: lengths are compared only where there is enough of one."""
    pairs = _pairs(spark, sf_dir).withColumn("target", F.when(F.col("turn") % 4 == 0, F.substr("target", F.lit(1), F.lit(12))).otherwise(F.col("target"))).withColumn("source", F.when(F.col("turn") % 3 == 0, F.substr("source", F.lit(1), F.lit(30))).otherwise(F.col("source")))
    return pairs.select("conv_id", "turn", F.coalesce(T.output_fault(F.col("source"), F.col("target"), single=(SINGLE_IN, SINGLE_OUT)), F.lit("ok")).alias("verdict"))


def pii_job_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's mask rows read back, in order of chunk and token."""
    return pii_masked(spark, sf_dir).filter("job_id = 'src1'").orderBy("chunk_index", "token")


QUERIES = {f.__name__: f for f in (passes_once, non_blank_units, progress_reports, split_listing, single_validation, pii_job_tokens)}
_W = ", ".join(f"({i}, {w}::DOUBLE)" for i, w in enumerate(STAGE_WEIGHTS.values()))
ORACLE_SQL = {
    "passes_once": "WITH p AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 0 WHEN doc_id % 4 = 0 THEN 1 ELSE 2 END AS pass FROM documents) SELECT pass, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM p GROUP BY pass",
    "non_blank_units": r"""WITH l AS (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '[\n.]') AS ls FROM documents)),
        n AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM l WHERE trim(t) <> '')
        SELECT doc_id, count(*) AS n, CAST(sum(i * pos) AS BIGINT) AS mark, CAST(max(pos) AS INTEGER) AS last FROM n GROUP BY doc_id""",
    "progress_reports": f"""WITH RECURSIVE s(i, w) AS (VALUES {_W}), t AS (SELECT i, w / sum(w) OVER () AS own, coalesce(sum(w) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(w) OVER () AS before FROM s),
        e AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS t0, CAST(floor(((event_id % (user_id % 3 + 1)) + round(before + own * least(greatest(value / 100, 0), 1), 6)) / (user_id % 3 + 1) * 1000 + 0.0001::DOUBLE) AS BIGINT) AS whole,
            row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS n FROM events JOIN t ON t.i = event_id % {len(STAGE_WEIGHTS)}),
        f AS (SELECT event_id, user_id, n, whole, t0 AS last, true AS sent FROM e WHERE n = 1
              UNION ALL SELECT e.event_id, e.user_id, e.n, e.whole, CASE WHEN e.user_id % 6 <= 3 OR e.t0 - f.last >= 3600 THEN e.t0 ELSE f.last END, e.user_id % 6 <= 3 OR e.t0 - f.last >= 3600 FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
        SELECT event_id, whole, sent FROM f""",
    "split_listing": """WITH p AS (SELECT doc_id, CAST(greatest(ceil(n_chars / 100), 1) AS BIGINT) AS pages FROM documents), c AS (SELECT doc_id, pages, CAST(ceil(pages / 20) AS BIGINT) AS parts FROM p)
        SELECT doc_id, least(parts, 3) AS n, pages - 1 AS last FROM c""",
    "single_validation": "WITH " + _PAIRS_SQL + r""", q AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN source[1:30] ELSE source END AS source, CASE WHEN turn % 4 = 0 THEN target[1:12] ELSE target END AS target FROM p),
        t AS (SELECT *, regexp_replace(source, '[. 。…，]{20,}', '.', 'g') AS trimmed FROM q), k AS (SELECT *, greatest(1, length(trimmed) // 4) AS a, greatest(1, length(target) // 4) AS b FROM t)
        SELECT conv_id, turn, CASE WHEN coalesce(trim(target), '') = '' THEN 'empty' WHEN trimmed = target AND a > 10 THEN 'same_text'
          WHEN (a >= 10 OR b >= 64) AND NOT (b / a > 0.3::DOUBLE AND b / a < 3) THEN 'length_ratio' WHEN a > 20 AND levenshtein(source, target) <= 4 THEN 'edit_distance' ELSE 'ok' END AS verdict FROM k""",
}
