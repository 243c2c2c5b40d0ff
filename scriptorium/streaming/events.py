"""Streams over events: progress, duplicates, job states, status changes, windows.

Each function takes a streaming (or batch) DataFrame and returns one; sinks and
triggers are the caller's. Windowed aggregates, watermarks and late data go
beyond what the described service does itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scriptorium.plans.jobs import TERMINAL

#: Fixed value: seconds that cached state is kept without use.
STATE_TTL = 7 * 86_400
#: Relative weights of the stages of a job's progress.
STAGE_WEIGHTS = {"translate": 46.96, "terms": 30.0, "parse": 14.12, "layout": 14.03, "save": 6.34, "paragraphs": 6.26, "typeset": 4.71}


def read_events(spark, path: str, schema) -> DataFrame:
    """A stream over parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums by type and window; rows later than the watermark are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return s.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def enqueued_once(tasks: DataFrame, late: str = "1 day") -> DataFrame:
    """Each task id once within the watermark: a repeated submission is the same task."""
    return tasks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _fold(events: DataFrame, keys: list[str], step, state_schema: str, out_schema: str, ttl: int | None) -> DataFrame:
    """step(state tuple or None, sorted rows) -> (rows out, state), over each key's rows of a batch in time order.

    The state of a key without rows for ``ttl`` seconds is dropped; without
    ``ttl`` it stays, as a run to the end of its input needs, for such state
    keeps a stream waking up.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
        out, now = step(key, state.get if state.exists else None, rows)
        state.update(now)
        if ttl:
            state.setTimeoutDuration(ttl * 1000)
        yield out

    return events.groupBy(*keys).applyInPandasWithState(run, out_schema, state_schema, "append", GroupStateTimeout.ProcessingTimeTimeout if ttl else GroupStateTimeout.NoTimeout)


def accepted_submissions(events: DataFrame, seconds: int, ttl: int | None = STATE_TTL) -> DataFrame:
    """Submissions, accepted unless one of their user and type was accepted within ``seconds`` before."""

    def step(key, anchor, rows):
        last, flags = (anchor[0] if anchor else None), []
        for t in rows["ts"].astype("datetime64[us]").astype("int64"):
            ok = last is None or t - last > seconds * 1_000_000
            last = t if ok else last
            flags.append(ok)
        return pd.DataFrame({"user_id": key[0], "event_type": key[1], "event_id": rows["event_id"], "accepted": flags}), (int(last),)

    return _fold(events, ["user_id", "event_type"], step, "anchor long", "user_id long, event_type string, event_id long, accepted boolean", ttl)


def status_changes(events: DataFrame, ttl: int | None = STATE_TTL) -> DataFrame:
    """Rows whose status differs from the user's one before, until a terminal one."""

    def step(key, state, rows):
        last, ended = state or ("", False)
        out = []
        for e, s in zip(rows["event_id"], rows["status"], strict=True):
            if ended or s == last:
                continue
            out.append((key[0], int(e), s))
            last, ended = s, s in TERMINAL
        return pd.DataFrame(out, columns=["user_id", "event_id", "status"]), (last, ended)

    return _fold(events, ["user_id"], step, "last string, ended boolean", "user_id long, event_id long, status string", ttl)


def task_decisions(events: DataFrame, lease: int = 300, ttl: int | None = STATE_TTL) -> DataFrame:
    """What an at-least-once delivery leads to: run, retry after a crash, defer under another owner's lease, or nothing when done.

    ``status`` is what the delivery reports, ``owner`` who got it; a lease holds
    ``lease`` seconds and only its owner's reports refresh or end it.
    """

    def step(key, state, rows):
        status, owner, until = state or ("queued", "", 0)
        out = []
        for e, t, s, o in zip(rows["event_id"], rows["ts"].astype("datetime64[us]").astype("int64") // 1_000_000, rows["status"], rows["owner"], strict=True):
            if status in TERMINAL:
                decision = "noop"
            elif owner and owner != o and t < until:
                decision = "defer"
            else:
                decision = "retry" if status == "processing" and owner != o else "run"
                status, owner, until = s, o, int(t) + lease
                if s in TERMINAL:
                    owner, until = "", 0
            out.append((key[0], int(e), decision))
        return pd.DataFrame(out, columns=["user_id", "event_id", "decision"]), (status, owner, int(until))

    return _fold(events, ["user_id"], step, "status string, owner string, until long", "user_id long, event_id long, decision string", ttl)


def progress(events: DataFrame) -> DataFrame:
    """Overall progress of each user's job: weights of stages begun before, and the current one's share."""
    names = list(STAGE_WEIGHTS)
    total = sum(STAGE_WEIGHTS.values())
    before = {n: sum(STAGE_WEIGHTS[m] for m in names[:i]) / total for i, n in enumerate(names)}
    start = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("stage")]
    own = F.create_map(*[F.lit(x) for n, w in STAGE_WEIGHTS.items() for x in (n, w / total)])[F.col("stage")]
    return events.select("user_id", "event_id", F.round(F.coalesce(start + own * F.least(F.greatest("fraction", F.lit(0.0)), F.lit(1.0)), F.lit(0.0)), 6).alias("progress"))


def throttled_starts(calls: DataFrame, qps: float) -> DataFrame:
    """When each call of a provider may start: not before it came, nor within 1/qps of the one before.

    With calls numbered by arrival, that is the greatest of arrival - i/qps so far, plus i/qps.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("provider").orderBy("at", "call_id")
    i = (F.row_number().over(w) - 1) / qps
    return calls.withColumn("_i", i).withColumn("start", F.max(F.col("at") - F.col("_i")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_i")).drop("_i")
