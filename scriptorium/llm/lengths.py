"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by encoded length. Suffix sums over the histogram then
answer, for every context limit, how many documents and tokens reach it, what
truncating at it keeps, and which quantile it is. The sums are taken in two
levels, inside ranges of lengths and over the ranges, so no task holds more than
one range or one row of each.

Defined results: null and empty texts have length 0; repeated rows each count;
very long texts are encoded whole; only the named column is read; an empty table
gives an empty histogram.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, spread, table
from scriptorium.llm.pieces import MODEL, ChunkTable, _groups, without_gc

#: Lengths of a range; a range's window holds so many rows at most.
RANGE = 256


def encoded_lengths(docs: DataFrame, text_col: str = "text", model_file: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns and ``length``: the number of ids of each text."""
    path = model_file or public_tokenizers.path(MODEL)
    kinds = ", ".join([f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + ["length long"])

    def counted(batches):
        coder = ChunkTable(path)
        for batch in batches:
            texts = batch.column(len(keep))
            groups = _groups(pc.fill_null(pc.utf8_length(texts), 0).to_pylist())
            sizes = [n for i, j in groups for n in coder.lengths([t or "" for t in texts.slice(i, j - i).to_pylist()])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int64())], [*(f"k{i}" for i in range(len(keep))), "length"])

    def run(batches):
        with without_gc():
            yield from counted(batches)

    inner = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs[text_col].cast("string").alias("text"))
    return inner.mapInArrow(run, kinds).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "length")


def histogram(lengths: DataFrame) -> DataFrame:
    """length and n_docs."""
    return lengths.groupBy("length").agg(F.count("*").alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """For each length taken as context limit: documents and tokens of at least that length, what truncation keeps and drops, and the share of documents not longer.

    Between two lengths nothing changes but the truncated total, which grows by
    ``docs_over`` with each token of the limit; so these rows answer every limit.
    """
    hist = cut(hist)  # it's used three times, and texts are encoded once
    hist = hist.withColumn("range", F.floor(F.col("length") / RANGE)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    ranges = hist.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    behind = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("d").over(behind), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(behind), F.lit(0)).alias("t_after"))
    total = hist.agg(F.sum("n_docs").alias("all_docs"), F.sum("tokens").alias("all_tokens"))
    inside = Window.partitionBy("range").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    over = hist.join(ranges, "range").crossJoin(F.broadcast(total)).select(
        "length",
        "n_docs",
        (F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("d_after")).alias("docs_over"),
        (F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("t_after")).alias("tokens_over"),
        "all_docs",
        "all_tokens",
    )
    return over.select(
        F.col("length").alias("context_limit"),
        "n_docs",
        "docs_over",
        (F.col("tokens_over") + F.col("length") * F.col("n_docs")).alias("tokens_reaching"),
        (F.col("all_tokens") - F.col("tokens_over") + F.col("length") * F.col("docs_over")).alias("truncated_tokens"),
        (F.col("tokens_over") - F.col("length") * F.col("docs_over")).alias("dropped_tokens"),
        F.round((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs"), 9).alias("quantile"),
    )


def truncated_total(at: DataFrame, limit: int) -> DataFrame:
    """One row: the tokens that are left when every text is truncated at any ``limit``."""
    below = at.filter(F.col("context_limit") <= limit).orderBy(F.desc("context_limit")).limit(1)
    return below.select((F.col("truncated_tokens") + (F.lit(limit) - F.col("context_limit")) * F.col("docs_over")).alias("tokens"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits(histogram(encoded_lengths(spread(table(spark, sf_dir, "documents").select("text")))))


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLE_SQL: dict[str, str] = {}
