"""From raw documents to token ids: language, near-duplicates, secrets, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept. All but the last return the columns of ``documents``, and any others that
come with them. An empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import langid, minhash, mixing, pieces, secrets
from scriptorium.runtime import cut, spread, table

#: Ids or spans that may be broadcast to the documents; beyond, the same join shuffles.
FEW = 1_000_000
#: Bits a byte that a text takes without any model; one that no language shortens is no language.
UNIFORM_BITS = 8.0


def _sent(rows: DataFrame, most: int = FEW) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= most else rows


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, with that language in ``lang``.

    Null, empty and letterless texts go, and texts that no language shortens.
    Null ids and repeated rows pass like any others; without a labelled row
    nothing is learned and nothing passes.
    """
    known = langid.identify(docs, langid.fit(docs))
    kept = known.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("bits_per_byte") < UNIFORM_BITS))
    return kept.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near-duplicates.

    Documents without words and those without an id are in no group and stay.
    Rows of one id stay or go together, but of rows of equal id and text one stays.
    """
    found = minhash.cut(minhash.near_duplicates(docs))
    by_id = found.filter("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("_kept"), F.count("*").alias("_n"))
    by_id = minhash.cut(by_id.filter("not _kept or _n > 1"))
    kept = docs.join(_sent(by_id.filter("not _kept").select("doc_id")), "doc_id", "left_anti")
    repeated = by_id.filter("_kept").select("doc_id")
    if repeated.limit(1).count():
        repeated = _sent(repeated)
        kept = kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(kept.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"]))
    return kept.select(docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with base findings and owner-specific credentials masked and ``n_chars`` counted anew; other copied examples stay.

    Null and empty texts stay as they are. Rows are told apart by id and text,
    so null ids and repeated rows are masked as their texts ask for.
    """
    keys = (F.coalesce(docs["doc_id"], F.lit(-1)).alias("id"), F.xxhash64(docs["text"]).alias("mark"))
    found = secrets.scan(docs.select(*keys, "doc_id", "text", "source"), keep=("id", "mark")).withColumn("spans", F.filter("spans", lambda s: s["rank"] <= 3))
    found = secrets.cut(found.filter(F.size("spans") > 0).dropDuplicates(["id", "mark"]))
    rows = docs.select(*keys, F.struct(*[docs[c] for c in docs.columns]).alias("row")).join(_sent(found, 100_000), ["id", "mark"], "left")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(secrets.redact(F.col("row.text"), F.col("spans")))
    fresh = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return rows.select(*[fresh.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics meet their target weights.

    Null source and language are values of their own; rows of one id are drawn
    or left together inside a cell.
    """
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and the text that they decode to; none and the empty text for null and empty texts."""
    return pieces.encode_decode(docs)


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("secret_scans", secret_scans),
    ("mixing", mixture),
    ("sentencepiece", encoding),
]
#: The stages' learned language model and near-duplicate groups are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what one keeps is written for the next, so no stage runs again for a later one."""
    docs = spread(table(spark, sf_dir, "documents"))
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
