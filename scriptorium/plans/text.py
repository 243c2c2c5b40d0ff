"""Queries over texts: skipping, protected tokens, masking, validation and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import masking
from scriptorium.runtime import spread, table


#: Patterns that engines without lookaround, or with boundaries of ASCII letters only, read alike.
SIMPLE = [p for p in masking.PATTERNS if "(?!" not in p[1] and p[0] != "SWIFT_CODE"]


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn as source with the next assistant turn as target."""
    turns = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = turns.withColumn("target", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w))
    return turns.filter("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("source"), "target")


_PAIRS_SQL = """n AS (SELECT conv_id, turn, role, text AS source, lead(text) OVER w AS target, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        p AS (SELECT conv_id, turn, source, target FROM n WHERE role = 'user' AND next_role = 'assistant')"""


def skip_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.coalesce(T.skip_reason(F.col("text"), 30), F.lit("translate")).alias("reason"))


def skip_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    reason = T.skip_reason(F.col("text"), 5, F.col("lang"), "en", ("en", "de", "fr"))
    return docs.select(F.coalesce(reason, F.lit("translate")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def skip_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as paragraphs: strictly numeric, mostly ``(cid:`` escapes, or short ones are passed over."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    escapes = F.regexp_count("t", F.lit(r"\(cid:\d+\)")) * 8
    reason = F.when(F.trim("t") == "", "empty").when(escapes > 0.8 * F.length("t"), "cid").when(F.col("t").rlike(r"^-?\d+(\.\d+)?$"), "numeric").when(F.length("t") < 10, "short").otherwise("translate")
    return docs.groupBy("doc_id").agg(*[F.count(F.when(reason == r, 1)).alias(f"n_{r}") for r in ("empty", "cid", "numeric", "short", "translate")])


def protected_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    checked = lambda c: F.size(T.protected(F.col("source"), c)).cast("long").alias(f"{c}_checked")
    lost = lambda c: F.size(T.missing(F.col("source"), F.col("target"), c)).cast("long").alias(f"{c}_missing")
    return pairs.select("conv_id", "turn", *[f(c) for c in ("url", "email", "ticket_id") for f in (checked, lost)])


def protected_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven categories of each document against the next one's text; lookarounds need the JVM's patterns."""
    docs = table(spark, sf_dir, "documents")
    joined = docs.select("doc_id", "text").join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("target")), "doc_id")
    return joined.select("doc_id", *[F.size(T.missing(F.col("text"), F.col("target"), c)).alias(c) for c in T.PROTECTED])


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = masking.counts(F.col("text"), SIMPLE)
    return spread(table(spark, sf_dir, "documents").select("text")).agg(*[F.sum(c).cast("long").alias(k.lower()) for k, c in each.items()])


def pii_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select(F.col("source").alias("job_id"), F.col("doc_id").alias("chunk_index"), "text"))
    done = masking.masked(docs, "job_id", "chunk_index", "text")
    return done.select("job_id", "chunk_index", F.explode("rows").alias("r")).select("job_id", "chunk_index", "r.token", F.sha2("r.original", 256).alias("original_sha256"), "r.kind")


def pii_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked and unmasked again, every text is the same."""
    docs = spread(table(spark, sf_dir, "documents").select(F.col("source").alias("job_id"), F.col("doc_id").alias("chunk_index"), "text"))
    done = masking.masked(docs, "job_id", "chunk_index", "text")
    rows = done.select("job_id", "chunk_index", F.posexplode("rows").alias("pos", "r")).select("job_id", "chunk_index", "pos", "r.token", "r.original")
    back = masking.unmasked(done.select("job_id", "chunk_index", F.col("masked").alias("text")), rows, ["job_id", "chunk_index"], "text", "pos")
    return back.select(F.col("chunk_index").alias("doc_id"), F.sha2("text", 256).alias("text_sha256"))


def mask_token_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens left in texts taken out; those of too few digits or open ends are none."""
    token = lambda n, width: F.concat(F.lit("__DLP_TOKEN_"), F.lpad(n.cast("string"), width, "0"), F.lit("__"))
    put = F.transform(F.split("text", " "), lambda w, i: F.when(i % 4 == 1, F.concat(w, token(i, 4))).when(i % 4 == 2, F.concat(token(i, 3), w)).when(i % 9 == 0, F.concat(w, F.lit("__DLP_TOKEN_"), token(i, 6))).otherwise(w))
    turns = table(spark, sf_dir, "conversations").withColumn("t", F.array_join(put, " "))
    return turns.select("conv_id", "turn", F.regexp_count("t", F.lit(T.MASK_TOKEN)).cast("long").alias("leaked"), F.sha2(F.regexp_replace("t", T.MASK_TOKEN, ""), 256).alias("clean_sha256"))


def output_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    return pairs.select("conv_id", "turn", F.coalesce(T.output_fault(F.col("source"), F.col("target")), F.lit("ok")).alias("verdict"))


def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    domain = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("source"))
    return docs.select("doc_id", T.cache_key(F.col("text"), "vendor", "model-1", F.col("lang"), "en", domain).alias("key"))


def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and misses against a cache of every third document's key; the hit rate is rounded to 4 places."""
    keys = cache_key(spark, sf_dir)
    cached = keys.filter("doc_id % 3 = 1").select("key").distinct().withColumn("hit", F.lit(1))
    split = keys.join(cached, "key", "left").agg(F.count("hit").alias("hits"), (F.count("*") - F.count("hit")).alias("misses"))
    return split.withColumn("hit_rate", F.coalesce(F.bround(F.try_divide("hits", F.col("hits") + F.col("misses")), 4), F.lit(0.0)))


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2("text", 256).alias("content_hash"), T.token_estimate(F.col("text")).cast("long").alias("tokens"), F.sha2(T.squeezed(F.col("text")), 256).alias("squeezed_sha256"), T.sentence_count(F.col("text")).cast("long").alias("n_sentences"))


def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at sentence ends, packed to 120 estimated tokens; only longer sentences are cut at words."""
    import pandas as pd

    def cut(text: str, most: int) -> list[str]:
        import re

        size = lambda t: max(1, len(t) // 4)

        def packed(parts: list[str]) -> list[str]:
            out: list[str] = []
            for part in parts:
                if out and size(f"{out[-1]} {part}".strip()) <= most:
                    out[-1] = f"{out[-1]} {part}".strip()
                else:
                    out.append(part)
            return out

        chunks = packed([s for s in re.split(r"(?<=[.!?。！？])\s+", text) if s])
        return [p for c in chunks for p in (packed(c.split(" ")) if size(c) > most else [c])] or [text]

    def run(batches):
        for rows in batches:
            found = [cut(t or "", 120) for t in rows["text"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "n_chunks": [len(f) for f in found], "longest": [max(map(len, f)) for f in found]})

    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).mapInPandas(run, "doc_id long, n_chunks long, longest long")


def json_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of model answers whatever their wrapping; those of truncated arrays are salvaged."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    item = F.concat(F.lit('{"id": '), F.col("turn").cast("string"), F.lit(', "output": "t'), F.col("conv_id").cast("string"), F.lit('"}'))
    whole = F.concat(F.lit("["), item, F.lit("]"))
    raw = F.when(F.col("turn") % 4 == 0, whole).when(F.col("turn") % 4 == 1, F.concat(F.lit('```json{"items": '), whole, F.lit("}```"))).when(F.col("turn") % 4 == 2, item).otherwise(F.concat(F.lit("["), item, F.lit(', {"id": 9, "outp')))
    plain = T.stripped_fences(raw)
    items = F.coalesce(T.normalized_items(plain, "array<struct<id:long,output:string>>"), T.salvaged_items(plain))
    salvaged = F.when(F.col("turn") % 4 == 3, T.salvaged_items(plain)).otherwise(items)
    return turns.select("conv_id", "turn", F.explode(salvaged).alias("i")).select("conv_id", "turn", F.col("i.id").alias("id"), F.col("i.output").alias("output"))


QUERIES = {f.__name__: f for f in (skip_reason, skip_language, skip_paragraph, protected_tokens, protected_all, pii_counts, pii_masked, pii_round_trip, mask_token_strip, output_validation, cache_key, cache_split, text_keys, sentence_chunks, json_items)}

_WHITE = r"[ \t\n\r\f\v]"
_COUNTS: dict[str, list[str]] = {}
for _name, _pattern in SIMPLE:
    _COUNTS.setdefault(_name.lower(), []).append(f"len(regexp_extract_all(text, '{_pattern}'))")
_KEY = "sha256(concat_ws('|', 'v4', 'vendor', 'model-1', lang, 'en', CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END, text))"
ORACLE_SQL = {
    "skip_reason": r"""SELECT conv_id, turn, CASE WHEN coalesce(trim(text), '') = '' THEN 'empty' WHEN length(trim(text)) < 30 THEN 'short'
        WHEN regexp_full_match(trim(text), '[-+]?[\d\s.,:%/()\[\]-]+') THEN 'numeric'
        WHEN regexp_full_match(trim(text), '(?:\s|[<{\[(]/?[a-zA-Z0-9_.-]*[>}\])]|__DLP_TOKEN_\d+__|%[sd]|[^\w\s])+') THEN 'placeholder' ELSE 'translate' END AS reason FROM conversations""",
    "skip_language": r"""WITH d AS (SELECT trim(text) AS t, lang, length(text) >= 20 AND length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 5 AS asked FROM documents)
        SELECT CASE WHEN coalesce(t, '') = '' THEN 'empty' WHEN length(t) < 5 THEN 'short' WHEN regexp_full_match(t, '[-+]?[\d\s.,:%/()\[\]-]+') THEN 'numeric'
        WHEN regexp_full_match(t, '(?:\s|[<{\[(]/?[a-zA-Z0-9_.-]*[>}\])]|__DLP_TOKEN_\d+__|%[sd]|[^\w\s])+') THEN 'placeholder'
        WHEN asked AND lang = 'en' THEN 'target_language' WHEN asked AND lang NOT IN ('en', 'de', 'fr') THEN 'unsupported' ELSE 'translate' END AS reason, count(*) AS n FROM d GROUP BY 1""",
    "skip_paragraph": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents),
        r AS (SELECT doc_id, CASE WHEN trim(t) = '' THEN 'empty' WHEN len(regexp_extract_all(t, '\(cid:\d+\)')) * 8 > 0.8 * length(t) THEN 'cid'
              WHEN regexp_matches(t, '^-?\d+(\.\d+)?$') THEN 'numeric' WHEN length(t) < 10 THEN 'short' ELSE 'translate' END AS reason FROM l)
        SELECT doc_id, count(*) FILTER (reason = 'empty') AS n_empty, count(*) FILTER (reason = 'cid') AS n_cid, count(*) FILTER (reason = 'numeric') AS n_numeric,
               count(*) FILTER (reason = 'short') AS n_short, count(*) FILTER (reason = 'translate') AS n_translate FROM r GROUP BY doc_id""",
    "protected_tokens": "WITH " + _PAIRS_SQL + ", x AS (SELECT conv_id, turn, source, target, " + ", ".join(
        f"list_distinct(regexp_extract_all(source, '{T.PROTECTED[c].replace(chr(39), chr(39) * 2)}')) AS {c}" for c in ("url", "email", "ticket_id")
    ) + " FROM p) SELECT conv_id, turn, " + ", ".join(
        f"CAST(len({c}) AS BIGINT) AS {c}_checked, CASE WHEN source = '' OR target = '' THEN 0 ELSE CAST(len(list_filter({c}, lambda k: NOT contains(target, k))) AS BIGINT) END AS {c}_missing" for c in ("url", "email", "ticket_id")
    ) + " FROM x",
    "pii_counts": "SELECT " + ", ".join(f"CAST(sum({' + '.join(v)}) AS BIGINT) AS {k}" for k, v in _COUNTS.items()) + " FROM documents",
    "pii_round_trip": "SELECT doc_id, sha256(text) AS text_sha256 FROM documents",
    "mask_token_strip": r"""WITH t AS (SELECT conv_id, turn, array_to_string(list_transform(string_split(text, ' '), lambda w, i: CASE WHEN (i - 1) % 4 = 1 THEN w || '__DLP_TOKEN_' || lpad(CAST(i - 1 AS VARCHAR), 4, '0') || '__'
            WHEN (i - 1) % 4 = 2 THEN '__DLP_TOKEN_' || lpad(CAST(i - 1 AS VARCHAR), 3, '0') || '__' || w WHEN (i - 1) % 9 = 0 THEN w || '__DLP_TOKEN___DLP_TOKEN_' || lpad(CAST(i - 1 AS VARCHAR), 6, '0') || '__' ELSE w END), ' ') AS t FROM conversations)
        SELECT conv_id, turn, CAST(len(regexp_extract_all(t, '__DLP_TOKEN_\d{4,}__')) AS BIGINT) AS leaked, sha256(regexp_replace(t, '__DLP_TOKEN_\d{4,}__', '', 'g')) AS clean_sha256 FROM t""",
    "output_validation": "WITH " + _PAIRS_SQL + r""", t AS (SELECT *, regexp_replace(source, '[. 。…，]{20,}', '.', 'g') AS trimmed FROM p),
        k AS (SELECT *, greatest(1, length(trimmed) // 4) AS a, greatest(1, length(target) // 4) AS b FROM t)
        SELECT conv_id, turn, CASE WHEN coalesce(trim(target), '') = '' THEN 'empty'
          WHEN len(list_filter([""" + ", ".join(f"'{m}'" for m in T.LEAK_MARKERS) + r"""], lambda m: contains(lower(target), m))) > 0 THEN 'prompt_leak'
          WHEN trimmed = target AND a > 10 THEN 'same_text' WHEN NOT (b / a > 0.3 AND b / a < 3) THEN 'length_ratio'
          WHEN a > 20 AND levenshtein(source, target) < 5 THEN 'edit_distance' ELSE 'ok' END AS verdict FROM k""",
    "cache_key": f"SELECT doc_id, {_KEY} AS key FROM documents",
    "cache_split": f"""WITH k AS (SELECT doc_id, {_KEY} AS key FROM documents), c AS (SELECT DISTINCT key, 1 AS hit FROM k WHERE doc_id % 3 = 1)
        SELECT count(hit) AS hits, count(*) - count(hit) AS misses, coalesce(round_even(CAST(count(hit) AS DOUBLE) / count(*), 4), 0.0) AS hit_rate FROM k LEFT JOIN c USING (key)""",
    "text_keys": f"""SELECT doc_id, sha256(text) AS content_hash, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens, sha256(trim(regexp_replace(text, '{_WHITE}+', ' ', 'g'))) AS squeezed_sha256,
        CAST(len(list_filter(regexp_split_to_array(text, '[.!?。！？]+'), lambda s: trim(s) <> '')) AS BIGINT) AS n_sentences FROM documents""",
    "json_items": "SELECT conv_id, turn, turn AS id, 't' || conv_id AS output FROM conversations",
}
