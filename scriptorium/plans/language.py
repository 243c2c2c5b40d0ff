"""Language profiles of documents: histogram, budget, shares, gates and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import is_detectable, letters
from scriptorium.runtime import table

#: Languages the service takes, and the aliases of each.
SUPPORTED = ("en", "es", "fr", "de", "it", "ja", "zh")
ALIASES = {
    "en": "en", "eng": "en", "english": "en", "en-us": "en", "en-gb": "en",
    "es": "es", "spa": "es", "spanish": "es",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr",
    "de": "de", "deu": "de", "ger": "de", "german": "de",
    "it": "it", "ita": "it", "italian": "it",
    "ja": "ja", "jpn": "ja", "japanese": "ja",
    "zh": "zh", "zho": "zh", "chi": "zh", "zh-cn": "zh", "zh-tw": "zh", "chinese": "zh",
}
#: Noise floor of a share, coverage that supported languages need, confidence below which a domain isn't gated.
NOISE_FLOOR, COVERAGE, DOMAIN_CONFIDENCE = 0.05, 0.90, 0.70


def normalized(lang: Column) -> Column:
    """The code of an alias; anything else lower-cased and trimmed."""
    low = F.lower(F.trim(lang))
    codes = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(codes[low], low)


def histogram(docs: DataFrame, keys: list[str], lang: str = "lang", text: str = "text") -> DataFrame:
    """Characters of each language below the keys, over detectable texts."""
    return docs.filter(is_detectable(F.col(text))).groupBy(*keys, lang).agg(F.sum(F.length(text)).cast("long").alias("chars"))


def within_budget(units: DataFrame, keys: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """The units before whose start less than ``budget`` has been taken."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return units.withColumn("_before", F.coalesce(F.sum(size).over(before), F.lit(0))).filter(F.col("_before") < budget).drop("_before")


def within_page_budget(units: DataFrame, keys: list[str], page: str, size: Column, budget: int) -> DataFrame:
    """The units of the pages before whose start less than ``budget`` has been taken; only page totals are ordered."""
    totals = units.groupBy(*keys, page).agg(F.sum(size).alias("_size"))
    pages = within_budget(totals, keys, [page], F.col("_size"), budget).drop("_size")
    return units.join(pages, [*keys, page], "left_semi")


def gate(hist: DataFrame, key: str, declared: str) -> DataFrame:
    """Verdict of each key: enough characters in supported languages, and the declared language dominant above the noise floor.

    ``hist`` has key, lang, chars, with the declared language in ``declared``.
    Where no language passes the floor, all count.
    """
    of = Window.partitionBy(key)
    shares = hist.withColumn("total", F.sum("chars").over(of)).withColumn("share", F.col("chars") / F.col("total"))
    shares = shares.withColumn("big", F.max((F.col("share") >= NOISE_FLOOR).cast("int")).over(of))
    significant = (F.col("big") == 0) | (F.col("share") >= NOISE_FLOOR)
    shares = shares.withColumn("rank", F.row_number().over(of.orderBy(F.desc("chars"), "lang")))
    out = shares.groupBy(key, declared).agg(
        F.sum(F.when(F.col("lang").isin(*SUPPORTED), F.col("chars")).otherwise(0)).alias("supported"),
        F.first("total").alias("total"),
        F.count(F.when(significant, 1)).alias("n_significant"),
        F.max(F.when(F.col("rank") == 1, F.col("lang"))).alias("dominant"),
    )
    coverage = F.col("supported") / F.col("total")
    verdict = F.when(coverage < COVERAGE, "unsupported").when(F.col("dominant") != F.col(declared), "mismatch").otherwise("ok")
    return out.select(key, declared, "dominant", "n_significant", F.round(coverage, 6).alias("coverage"), verdict.alias("verdict"))


def domain_gate(declared: Column, found: Column, confidence: Column) -> Column:
    """Whether a document may go on under its declared domain."""
    return F.when(declared == found, "ok").when(confidence < DOMAIN_CONFIDENCE, "unsure").otherwise("mismatch")


def top_and_other(counts: DataFrame, n: int) -> DataFrame:
    """The n largest languages with their shares, the rest as one row ``other``; (lang, chars) in, ties by name."""
    total = counts.agg(F.sum("chars").alias("total"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("chars"), "lang")))
    named = ranked.select(F.when(F.col("rank") <= n, F.col("lang")).otherwise(F.lit("other")).alias("lang"), "chars")
    return named.groupBy("lang").agg(F.sum("chars").alias("chars"), F.count("*").alias("n_langs")).crossJoin(F.broadcast(total)).select("lang", "chars", "n_langs", F.round(F.col("chars") / F.col("total"), 6).alias("share"))


def language_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = histogram(table(spark, sf_dir, "documents"), [])
    return chars.crossJoin(F.broadcast(chars.agg(F.sum("chars").alias("total")))).select("lang", "chars", F.round(F.col("chars") / F.col("total"), 6).alias("share"))


def language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = histogram(table(spark, sf_dir, "documents"), ["source"])
    # Even-numbered sources declare English, odd ones German.
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    return gate(hist.withColumn("declared", F.when(number % 2 == 0, "en").otherwise("de")), "source", "declared")


def language_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominant language of each source; of equal ones the one seen first."""
    docs = table(spark, sf_dir, "documents")
    each = docs.groupBy("source", "lang").agg(F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first"))
    return each.groupBy("source").agg(F.max_by("lang", F.struct("chars", -F.col("first"))).alias("dominant"), F.max("chars").alias("chars"))


def detectable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "conversations")
    return docs.select("conv_id", "turn", letters(F.col("text")).cast("long").alias("n_letters"), is_detectable(F.col("text")).alias("detectable"))


def language_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of each source's first units; sizes alone are ordered, not texts."""
    units = table(spark, sf_dir, "documents").filter(is_detectable(F.col("text"))).select("source", "lang", "doc_id", F.length("text").alias("chars"))
    kept = within_budget(units, ["source"], ["doc_id"], F.col("chars"), 20_000)
    return kept.groupBy("source", "lang").agg(F.sum("chars").cast("long").alias("chars"), F.count("*").alias("n_docs"))


def language_page_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with pages of ten units: a page that was begun within the budget counts whole."""
    units = table(spark, sf_dir, "documents").filter(is_detectable(F.col("text"))).select("source", "lang", F.expr("doc_id div 10").alias("page"), F.length("text").alias("chars"))
    kept = within_page_budget(units, ["source"], "page", F.col("chars"), 20_000)
    return kept.groupBy("source", "lang").agg(F.sum("chars").cast("long").alias("chars"), F.count("*").alias("n_docs"))


def top_languages_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = docs.groupBy(F.col("source").alias("lang")).agg(F.sum("n_chars").alias("chars"))
    return top_and_other(counts, 5)


def intent_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model chain of each document: the first route of its three keys, models by priority, two at most; else a default."""
    routes = spark.createDataFrame(ROUTES, "pos int, lang_in string, lang_out string, domain string, model string, priority int")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.upper("lang").alias("raw"), F.when(F.col("doc_id") % 2 == 0, "legal").otherwise("finance").alias("domain"))
    docs = docs.withColumn("lang_in", normalized(F.col("raw"))).withColumn("lang_out", F.when(F.col("lang_in") == "en", "de").otherwise("en"))
    joined = docs.join(F.broadcast(routes), ["lang_in", "lang_out", "domain"], "left")
    # Entry order decides between routes, then priority (999 if none) between models.
    chains = joined.groupBy("doc_id", "lang_in", "lang_out", "domain").agg(F.sort_array(F.collect_list(F.when(F.col("model").isNotNull(), F.struct("pos", F.coalesce("priority", F.lit(999)).alias("priority"), "model")))).alias("all"))
    first = F.filter("all", lambda x: x["pos"] == F.element_at("all", 1)["pos"])
    models = F.when(F.size("all") == 0, F.array(F.lit("default-model"))).otherwise(F.slice(F.transform(first, lambda x: x["model"]), 1, 2))
    intent = F.concat(F.lit("Translate-"), F.initcap("domain"), F.lit("-"), F.upper("lang_in"), F.lit("-"), F.upper("lang_out"))
    return chains.select("doc_id", intent.alias("intent"), F.array_join(models, ",").alias("models"))


ROUTES = [
    (1, "en", "de", "legal", "alpha-pro", 2),
    (1, "en", "de", "legal", "beta-lite", 1),
    (1, "en", "de", "legal", "gamma", None),
    (2, "en", "de", "legal", "never-reached", 1),
    (3, "de", "en", "finance", "beta-lite", 1),
    (4, "fr", "en", "legal", "alpha-pro", None),
]
_ROUTES_SQL = ", ".join(f"({p}, '{a}', '{b}', '{d}', '{m}', {'NULL' if r is None else r})" for p, a, b, d, m, r in ROUTES)
_DETECTABLE = r"length(text) >= 20 AND length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 5"

QUERIES = {f.__name__: f for f in (language_distribution, language_gate, language_mode, detectable_text, language_budget, language_page_budget, top_languages_other, intent_routing)}
ORACLE_SQL = {
    "language_distribution": f"""
        WITH c AS (SELECT lang, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE {_DETECTABLE} GROUP BY lang)
        SELECT lang, chars, round(chars / (SELECT sum(chars) FROM c), 6) AS share FROM c""",
    "language_gate": rf"""
        WITH h AS (SELECT source, lang, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE {_DETECTABLE} GROUP BY ALL),
        s AS (SELECT *, sum(chars) OVER w AS total, chars / sum(chars) OVER w AS share, row_number() OVER (PARTITION BY source ORDER BY chars DESC, lang) AS rank FROM h WINDOW w AS (PARTITION BY source)),
        b AS (SELECT *, max(CASE WHEN share >= 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY source) AS big,
              CASE WHEN CAST(regexp_extract(source, '(\d+)', 1) AS INTEGER) % 2 = 0 THEN 'en' ELSE 'de' END AS declared FROM s),
        g AS (SELECT source, declared, max(CASE WHEN rank = 1 THEN lang END) AS dominant,
              count(CASE WHEN big = 0 OR share >= 0.05 THEN 1 END) AS n_significant,
              sum(CASE WHEN lang IN {SUPPORTED} THEN chars ELSE 0 END) / max(total) AS cov FROM b GROUP BY source, declared)
        SELECT source, declared, dominant, n_significant, round(cov, 6) AS coverage,
               CASE WHEN cov < 0.90 THEN 'unsupported' WHEN dominant <> declared THEN 'mismatch' ELSE 'ok' END AS verdict FROM g""",
    "language_mode": """
        WITH e AS (SELECT source, lang, CAST(sum(n_chars) AS BIGINT) AS chars, min(doc_id) AS f FROM documents GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY chars DESC, f) AS n FROM e)
        SELECT source, lang AS dominant, chars FROM r WHERE n = 1""",
    "detectable_text": rf"""SELECT conv_id, turn, CAST(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS BIGINT) AS n_letters,
        coalesce({_DETECTABLE}, false) AS detectable FROM conversations""",
    "language_budget": f"""
        WITH u AS (SELECT source, lang, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
                   FROM documents WHERE {_DETECTABLE})
        SELECT source, lang, CAST(sum(n) AS BIGINT) AS chars, count(*) AS n_docs FROM u WHERE before < 20000 GROUP BY ALL""",
    "language_page_budget": f"""
        WITH u AS (SELECT source, lang, doc_id // 10 AS page, length(text) AS n FROM documents WHERE {_DETECTABLE}), t AS (SELECT source, page, sum(n) AS n FROM u GROUP BY ALL),
        b AS (SELECT source, page, coalesce(sum(n) OVER (PARTITION BY source ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
        SELECT source, lang, CAST(sum(n) AS BIGINT) AS chars, count(*) AS n_docs FROM u JOIN b USING (source, page) WHERE before < 20000 GROUP BY ALL""",
    "top_languages_other": """
        WITH c AS (SELECT source AS lang, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (ORDER BY chars DESC, lang) AS n FROM c)
        SELECT CASE WHEN n <= 5 THEN lang ELSE 'other' END AS lang, CAST(sum(chars) AS BIGINT) AS chars, count(*) AS n_langs,
               round(sum(chars) / (SELECT sum(chars) FROM c), 6) AS share FROM r GROUP BY 1""",
    "intent_routing": f"""
        WITH routes(pos, lang_in, lang_out, domain, model, priority) AS (VALUES {_ROUTES_SQL}),
        d AS (SELECT doc_id, lower(upper(lang)) AS lang_in, CASE WHEN lang = 'en' THEN 'de' ELSE 'en' END AS lang_out, CASE WHEN doc_id % 2 = 0 THEN 'legal' ELSE 'finance' END AS domain FROM documents),
        f AS (SELECT lang_in, lang_out, domain, min(pos) AS pos FROM routes GROUP BY ALL),
        m AS (SELECT r.lang_in, r.lang_out, r.domain, r.model, row_number() OVER (PARTITION BY r.lang_in, r.lang_out, r.domain ORDER BY coalesce(r.priority, 999), r.model) AS n
              FROM routes r JOIN f USING (lang_in, lang_out, domain, pos)),
        c AS (SELECT lang_in, lang_out, domain, string_agg(model, ',' ORDER BY n) AS models FROM m WHERE n <= 2 GROUP BY ALL)
        SELECT doc_id, 'Translate-' || upper(domain[1]) || domain[2:] || '-' || upper(lang_in) || '-' || upper(lang_out) AS intent,
               coalesce(models, 'default-model') AS models FROM d LEFT JOIN c USING (lang_in, lang_out, domain)""",
}
