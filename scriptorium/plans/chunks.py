"""Splitting documents into page ranges and sections, overlaps, excerpts and rejoining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.operators import folds, spatial
from scriptorium.runtime import table

#: Characters a page, pages a chunk, pages repeated, tokens a page, most tokens of a chunk, section bounds, excerpt bounds, pages sampled.
PAGE_CHARS, CHUNK_PAGES, OVERLAP, PAGE_TOKENS, MOST_TOKENS = 1800, 20, 2, 300, 8000
SECTION_LEAST, SECTION_MOST = 10, 25
EXCERPT_BLOCKS, SAMPLE_PAGES = 64, 40


def page_ranges(spec: str) -> list[tuple[int, int]]:
    """Ranges of "1-,2,-3,4": first and last page, -1 for an open end."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        lo, dash, hi = part.partition("-")
        out.append((int(lo or 1), int(hi or -1) if dash else int(lo)))
    return out


def in_ranges(page: Column, spec: str | None) -> Column:
    """Whether a page is asked for: all without a spec, none with an empty one."""
    if spec is None:
        return F.lit(True)
    out = F.lit(False)
    for lo, hi in page_ranges(spec):
        out = out | ((page >= lo) & (F.lit(True) if hi == -1 else page <= hi))
    return out


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.ceil(F.col("n_chars") / 100), F.lit(1)).cast("int").alias("pages"))


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 20 pages; those after the first reach 2 pages back; oversize ones are flagged."""
    chunks = _pages(spark, sf_dir).select("doc_id", "pages", F.posexplode(F.sequence(F.lit(0), F.col("pages") - 1, F.lit(CHUNK_PAGES))).alias("chunk_index", "start"))
    end = F.least(F.col("start") + CHUNK_PAGES, "pages") - 1
    first = F.greatest(F.col("start") - F.when(F.col("chunk_index") > 0, OVERLAP).otherwise(0), F.lit(0))
    tokens = (end - first + 1) * PAGE_TOKENS
    return chunks.select("doc_id", "chunk_index", first.cast("int").alias("start_page"), end.cast("int").alias("end_page"), tokens.cast("int").alias("token_count"), F.when(tokens <= 0, "missing").when(tokens > MOST_TOKENS, "exceeds").otherwise("ok").alias("check"))


def overlap_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks joined again: the repeated pages go, every page of a document comes once, in order."""
    chunks = page_chunks(spark, sf_dir)
    pages = chunks.select("doc_id", "chunk_index", F.posexplode(F.sequence("start_page", "end_page")).alias("pos", "page"))
    kept = pages.filter((F.col("chunk_index") == 0) | (F.col("pos") >= OVERLAP))
    return kept.groupBy("doc_id").agg(F.count("*").alias("pages"), F.countDistinct("page").alias("distinct_pages"), F.max("page").cast("long").alias("last"))


def page_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(1), "pages")).alias("page"))
    return pages.filter(in_ranges(F.col("page"), "-2,5,9-")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("page").alias("total"))


def outline(entries: DataFrame, pages: str) -> DataFrame:
    """Sections of outline entries (doc_id, level, page, title, pos): level 1, or else 2; one a page; a section from page 0 first; ends before the next."""
    best = entries.withColumn("_top", F.min(F.when(F.col("level") <= 2, F.col("level"))).over(Window.partitionBy("doc_id"))).filter("level = _top")
    best = best.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("pos"))).filter("_n = 1")
    zero = best.groupBy("doc_id").agg(F.min("page").alias("m"), F.first(pages).alias(pages)).filter("m > 0").select("doc_id", F.lit(0).alias("page"), F.lit("").alias("title"), pages)
    rows = best.select("doc_id", F.col("page").cast("int").alias("page"), "title", pages).union(zero)
    after = F.lead("page").over(Window.partitionBy("doc_id").orderBy("page"))
    return rows.select("doc_id", F.col("page").alias("start"), (F.coalesce(after, F.col(pages)) - 1).cast("int").alias("end"), "title").filter("end >= start")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).filter("pages >= 10").select("doc_id", "pages", F.posexplode(F.expr("transform(sequence(1, cast(pages div 4 as int)), i -> (i * (doc_id % 5 + 2)) % pages)")).alias("pos", "page"))
    return rows.withColumn("level", F.when(F.col("doc_id") % 3 == 0, F.col("pos") % 2 + 2).otherwise(F.col("pos") % 2 + 1)).withColumn("title", F.concat(F.lit("s"), F.col("pos").cast("string")))


def outline_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline(_entries(spark, sf_dir), "pages")


def section_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small sections merged, with the first title of each."""
    sections = outline_sections(spark, sf_dir)
    numbered = folds.coalesced_sections(sections.withColumn("len", F.col("end") - F.col("start") + 1), ["doc_id"], ["start", "title", "len"], F.col("len"), SECTION_LEAST, SECTION_MOST)
    return numbered.groupBy("doc_id", "batch").agg(F.min("start").alias("start"), F.sum("len").alias("pages"), F.min_by("title", "start").alias("title"))


def spread_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly spaced lines of a document, 64 at most, and every k-th page of about 40."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("ls")).withColumn("n", F.size("ls"))
    b = F.least("n", F.lit(EXCERPT_BLOCKS))
    at = F.transform(F.sequence(F.lit(0), b - 1), lambda i: F.floor(i * F.col("n") / b).cast("int"))
    picked = F.transform(at, lambda i: F.get("ls", i))
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / SAMPLE_PAGES).cast("int"))
    return lines.select("doc_id", F.size(picked).alias("blocks"), F.sha2(F.array_join(picked, "\n"), 256).alias("excerpt_sha256"), F.ceil(F.col("n") / stride).cast("int").alias("sampled"))


def boundary_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that end without terminal punctuation before a further turn of the conversation."""
    turns = table(spark, sf_dir, "conversations")
    after = turns.withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("next is not null")
    return after.groupBy("role").agg(F.count("*").alias("n"), F.count(F.when(~F.col("text").rlike(r"[.!?。！？][\"')\]]*\s*\z"), 1)).alias("open_ended"))


def split_rejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation flattened in order, by groups of ten, and joined again."""
    turns = table(spark, sf_dir, "conversations")
    numbered = turns.withColumn("group", F.floor((F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1) / 2))
    groups = numbered.groupBy("conv_id", "group").agg(F.sort_array(F.collect_list(F.struct("turn", F.trim("text").alias("t")))).alias("ts"))
    whole = F.transform(F.flatten(F.array_sort(F.collect_list("ts"))), lambda x: x["t"])
    return groups.groupBy("conv_id").agg(F.count("*").alias("groups"), F.sha2(F.array_join(whole, " "), 256).alias("joined_sha256"))


def page_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events placed into user-independent ranges of values by a range join."""
    ranges = spark.createDataFrame([(0, 10, "low"), (10, 50, "mid"), (50, 100_000, "high"), (90, 95, "peak")], "lo int, hi int, name string").withColumn("k", F.lit(1))
    events = table(spark, sf_dir, "events").select("event_id", F.floor("value").cast("int").alias("v")).withColumn("k", F.lit(1))
    return spatial.interval_join(events, F.broadcast(ranges), ["k"], "v", "lo", "hi", 1000).groupBy("name").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (page_chunks, overlap_drop, page_filter, outline_sections, section_coalesce, spread_excerpt, boundary_continuity, split_rejoin, page_tier)}
_P = "p AS (SELECT doc_id, CAST(greatest(ceil(n_chars / 100), 1) AS INTEGER) AS pages FROM documents)"
_E = """e AS (SELECT doc_id, pages, i - 1 AS pos, (i * (doc_id % 5 + 2)) % pages AS page, CASE WHEN doc_id % 3 = 0 THEN (i - 1) % 2 + 2 ELSE (i - 1) % 2 + 1 END AS level, 's' || (i - 1) AS title
        FROM p, unnest(range(1, pages // 4 + 1)) AS u(i) WHERE pages >= 10),
        t AS (SELECT *, min(level) FILTER (level <= 2) OVER (PARTITION BY doc_id) AS top FROM e),
        b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS n FROM t WHERE level = top),
        s0 AS (SELECT doc_id, page, title, pages FROM b WHERE n = 1 UNION ALL SELECT doc_id, 0, '', any_value(pages) FROM b WHERE n = 1 GROUP BY doc_id HAVING min(page) > 0),
        s1 AS (SELECT doc_id, CAST(page AS INTEGER) AS start, CAST(coalesce(lead(page) OVER (PARTITION BY doc_id ORDER BY page), pages) - 1 AS INTEGER) AS "end", title FROM s0),
        s AS (SELECT * FROM s1 WHERE "end" >= start)"""
ORACLE_SQL = {
    "page_chunks": f"""WITH {_P}, c AS (SELECT doc_id, pages, CAST(unnest(range(0, pages, 20)) AS INTEGER) AS start FROM p),
        x AS (SELECT doc_id, CAST(start // 20 AS INTEGER) AS chunk_index, CAST(greatest(start - CASE WHEN start > 0 THEN 2 ELSE 0 END, 0) AS INTEGER) AS start_page, CAST(least(start + 20, pages) - 1 AS INTEGER) AS end_page FROM c)
        SELECT *, CAST((end_page - start_page + 1) * 300 AS INTEGER) AS token_count, CASE WHEN (end_page - start_page + 1) * 300 > 8000 THEN 'exceeds' ELSE 'ok' END AS "check" FROM x""",
    "overlap_drop": f"WITH {_P} SELECT doc_id, CAST(pages AS BIGINT) AS pages, CAST(pages AS BIGINT) AS distinct_pages, CAST(pages - 1 AS BIGINT) AS last FROM p",
    "page_filter": f"WITH {_P}, q AS (SELECT doc_id, unnest(range(1, pages + 1)) AS page FROM p) SELECT doc_id, count(*) AS n, CAST(sum(page) AS BIGINT) AS total FROM q WHERE page <= 2 OR page = 5 OR page >= 9 GROUP BY doc_id",
    "outline_sections": f"WITH {_P}, {_E} SELECT * FROM s",
    "section_coalesce": f"""WITH RECURSIVE {_P}, {_E}, u AS (SELECT doc_id, start, "end" - start + 1 AS len, title, row_number() OVER (PARTITION BY doc_id ORDER BY start, title) AS n FROM s),
        f AS (SELECT doc_id, n, start, len, title, 0 AS batch, len AS size FROM u WHERE n = 1
              UNION ALL SELECT u.doc_id, u.n, u.start, u.len, u.title, CASE WHEN f.size < 10 AND f.size + u.len <= 25 THEN f.batch ELSE f.batch + 1 END, CASE WHEN f.size < 10 AND f.size + u.len <= 25 THEN f.size + u.len ELSE u.len END
              FROM f JOIN u ON u.doc_id = f.doc_id AND u.n = f.n + 1)
        SELECT doc_id, batch, min(start) AS start, CAST(sum(len) AS BIGINT) AS pages, arg_min(title, start) AS title FROM f GROUP BY doc_id, batch""",
    "spread_excerpt": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), n AS (SELECT *, len(ls) AS n, least(len(ls), 64) AS b FROM l),
        x AS (SELECT doc_id, n, list_transform(range(0, b), lambda i: ls[CAST(floor(i * n / b) AS BIGINT) + 1]) AS k FROM n)
        SELECT doc_id, CAST(len(k) AS INTEGER) AS blocks, sha256(array_to_string(k, chr(10))) AS excerpt_sha256, CAST(ceil(n / greatest(1, n // 40)) AS INTEGER) AS sampled FROM x""",
    "boundary_continuity": r"""WITH a AS (SELECT role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)
        SELECT role, count(*) AS n, count(*) FILTER (NOT regexp_matches(text, '[.!?。！？]["'')\]]*\s*$')) AS open_ended FROM a WHERE nxt IS NOT NULL GROUP BY role""",
    "split_rejoin": "SELECT conv_id, CAST(ceil(count(*) / 2) AS BIGINT) AS groups, sha256(string_agg(trim(text), ' ' ORDER BY turn)) AS joined_sha256 FROM conversations GROUP BY conv_id",
    "page_tier": "WITH r(lo, hi, name) AS (VALUES (0, 10, 'low'), (10, 50, 'mid'), (50, 100000, 'high'), (90, 95, 'peak')) SELECT name, count(*) AS n FROM events JOIN r ON floor(value) BETWEEN lo AND hi GROUP BY name",
}
