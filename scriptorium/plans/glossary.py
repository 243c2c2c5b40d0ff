"""Glossaries: matching, votes, deduplication, bucket scopes, JSON and new-term joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.operators.matching import first_by_key, normalized_key, term_hits
from scriptorium.plans.language import normalized
from scriptorium.runtime import table

#: Longest source of a term, share of dropped candidates that raises an alert.
LONGEST_TERM, ALERT = 100, 0.5
#: Terms that one glossary JSON holds about; a language of more is dealt into several by the terms' hash.
JSON_TERMS = 10_000
TERMS = ("license", "Rights Reserved", "the", "public", "der", "ción", "token", "and the", "zz-none")


def _terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TERMS], "term string")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each document as term candidates: (doc_id, pos, src, tgt, src_lang)."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.col("lang").alias("src_lang"), F.posexplode(F.split("text", "[ \n\t]+")).alias("pos", "src"))
    return words.filter("src <> ''").withColumn("tgt", F.concat(F.substring("src", 1, 2), F.lit("-"), (F.col("doc_id") % 3).cast("string")))


def glossary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = term_hits(table(spark, sf_dir, "documents"), _terms(spark), "doc_id", "text", "term")
    return hits.groupBy("term").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def contamination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages that stand in documents."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("term"))
    hits = term_hits(table(spark, sf_dir, "documents"), items, "doc_id", "text", "term")
    return hits.join(items, "term").select("item_id", "doc_id").distinct()


def term_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent target of each source, the one seen first of equals."""
    votes = _candidates(spark, sf_dir).groupBy("src", "tgt").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
    w = Window.partitionBy("src").orderBy(F.desc("n"), "first")
    return votes.withColumn("r", F.row_number().over(w)).filter("r = 1").select("src", "tgt", "n")


def term_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).withColumn("key", normalized_key(F.col("src")))
    return first_by_key(rows.select("key", "src", "doc_id", "pos"), ["key"], ["doc_id", "pos"]).select("key", "src", "doc_id")


def term_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).select("src_lang", F.lower(F.trim("src")).alias("src"), F.trim("tgt").alias("tgt")).distinct()
    return rows.groupBy("src_lang").agg(F.count("*").alias("n_triples"))


def term_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why candidates are dropped, and whether so many are that it's worth an alert."""
    rows = _candidates(spark, sf_dir)
    src, tgt = F.trim("src"), F.when(F.col("pos") % 4 == 0, F.trim("src")).otherwise(F.trim("tgt"))
    reason = F.when((src == "") | (tgt == ""), "blank").when(F.length(src) >= LONGEST_TERM, "long").when((src == tgt) & (F.length(src) < 3), "same").when(~F.col("src_lang").isin("en", "de"), "language").otherwise("kept")
    out = rows.groupBy("src_lang").agg(F.count("*").alias("n"), *[F.count(F.when(reason == r, 1)).alias(f"n_{r}") for r in ("same", "language", "kept")])
    return out.withColumn("alert", (F.col("n") > F.col("n_kept")) & ((F.col("n") - F.col("n_kept")) / F.col("n") >= ALERT))


def new_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms not yet in the store (the even documents' terms), the first writer of each winning."""
    rows = _candidates(spark, sf_dir).withColumn("key", F.lower(F.trim("src")))
    store = rows.filter("doc_id % 2 = 0").select("src_lang", "key").distinct()
    fresh = rows.filter("doc_id % 2 = 1").groupBy("src_lang", "key").agg(F.min("doc_id").alias("doc_id")).join(store, ["src_lang", "key"], "left_anti")
    return fresh.groupBy("src_lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def bucket_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the buckets in scope; a bucket that is no known language counts only without a scope."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "klingon").otherwise(F.upper("lang")).alias("bucket"))
    scope = spark.createDataFrame([("English",), ("fre",)], "lang string").select(normalized(F.col("lang")).alias("code"))
    rows = docs.withColumn("code", normalized(F.col("bucket"))).join(F.broadcast(scope), "code", "left_semi")
    return rows.groupBy("code").agg(F.count("*").alias("n"))


def glossary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to glossary JSON and back; a target is found by its exact key, else by the first alike."""
    words = _candidates(spark, sf_dir)
    groups = words.agg(F.approx_count_distinct("src").alias("n")).first().n // JSON_TERMS + 1
    rows = first_by_key(words, ["src_lang", "src"], ["doc_id", "pos"]).withColumn("slice", F.pmod(F.xxhash64("src"), F.lit(groups)))
    term = F.struct(F.col("src").alias("source_term"), F.create_map(F.when(F.col("doc_id") % 2 == 0, "DE").otherwise("de"), F.col("tgt")).alias("translations"))
    packed = rows.groupBy("src_lang", "slice").agg(F.to_json(F.struct(F.collect_list(term).alias("terms"))).alias("json"))
    back = packed.select("src_lang", F.explode(F.from_json("json", "terms array<struct<source_term:string,translations:map<string,string>>>")["terms"]).alias("t"))
    alike = F.get(F.filter(F.map_entries("t.translations"), lambda e: F.lower(e["key"]) == "de"), F.lit(0))["value"]
    return back.select("src_lang", F.col("t.source_term").alias("src"), F.coalesce(F.element_at("t.translations", "de"), alike).alias("tgt"))


QUERIES = {f.__name__: f for f in (glossary_hits, contamination_join, term_vote, term_dedupe, term_triples, term_validity, new_terms, bucket_scope, glossary_json)}
_W = r"""w AS (SELECT doc_id, src_lang, pos, src, src[1:2] || '-' || (doc_id % 3) AS tgt FROM (
        SELECT doc_id, lang AS src_lang, unnest(s) AS src, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT doc_id, lang, regexp_split_to_array(text, '[ \n\t]+') AS s FROM documents)) WHERE src <> '')"""
_FLAT = r"regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r\f\v]+', ' ', 'g')"
ORACLE_SQL = {
    "glossary_hits": f"""WITH t(term) AS (VALUES {', '.join(f"('{t}')" for t in TERMS)}), d AS MATERIALIZED (SELECT doc_id, {_FLAT} AS x FROM documents)
        SELECT term, count(*) AS n_docs, min(doc_id) AS first_doc FROM d JOIN t ON contains(x, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) GROUP BY term""",
    "contamination_join": rf"""WITH d AS MATERIALIZED (SELECT doc_id, {_FLAT} AS x FROM documents), i AS MATERIALIZED (SELECT item_id, trim({_FLAT}) AS t FROM benchmark)
        SELECT DISTINCT item_id, doc_id FROM d JOIN i ON contains(x, t) WHERE t <> ''""",
    "term_vote": f"WITH {_W}, v AS (SELECT src, tgt, count(*) AS n, min((doc_id, pos)) AS f FROM w GROUP BY ALL) SELECT src, tgt, n FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, f) AS r FROM v) WHERE r = 1",
    "term_dedupe": rf"WITH {_W}, k AS (SELECT *, trim(regexp_replace(lower(src), '[ \t\n\r\f\v]+', ' ', 'g')) AS key FROM w) SELECT key, src, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS r FROM k) WHERE r = 1",
    "term_triples": f"WITH {_W} SELECT src_lang, count(*) AS n_triples FROM (SELECT DISTINCT src_lang, lower(trim(src)) AS s, trim(tgt) AS t FROM w) GROUP BY src_lang",
    "term_validity": f"""WITH {_W}, x AS (SELECT src_lang, trim(src) AS s, CASE WHEN pos % 4 = 0 THEN trim(src) ELSE trim(tgt) END AS t FROM w),
        r AS (SELECT src_lang, CASE WHEN s = '' OR t = '' THEN 'blank' WHEN length(s) >= 100 THEN 'long' WHEN s = t AND length(s) < 3 THEN 'same' WHEN src_lang NOT IN ('en', 'de') THEN 'language' ELSE 'kept' END AS reason FROM x),
        c AS (SELECT src_lang, count(*) AS n, count(*) FILTER (reason = 'same') AS n_same, count(*) FILTER (reason = 'language') AS n_language, count(*) FILTER (reason = 'kept') AS n_kept FROM r GROUP BY src_lang)
        SELECT *, n > n_kept AND (n - n_kept) / n >= 0.5 AS alert FROM c""",
    "new_terms": f"""WITH {_W}, k AS (SELECT *, lower(trim(src)) AS key FROM w), o AS (SELECT * FROM k WHERE doc_id % 2 = 1 AND (src_lang, key) NOT IN (SELECT (src_lang, key) FROM k WHERE doc_id % 2 = 0)),
        f AS (SELECT src_lang, key, min(doc_id) AS d FROM o GROUP BY ALL) SELECT src_lang, count(*) AS n, min(d) AS first_doc FROM f GROUP BY src_lang""",
    "bucket_scope": "SELECT lang AS code, count(*) AS n FROM documents WHERE doc_id % 7 <> 0 AND lang IN ('en', 'fr') GROUP BY lang",
    "glossary_json": f"WITH {_W} SELECT src_lang, src, tgt FROM (SELECT *, row_number() OVER (PARTITION BY src_lang, src ORDER BY doc_id, pos) AS r FROM w) WHERE r = 1",
}
