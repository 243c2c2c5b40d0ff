"""Model answers and attempts: match-back, shapes, the early-stop chain, retries, excerpts with quotas, priced chunks.

The rules are functions over columns or frames with parameters; the queries
call them over rows made of the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.plans import cost
from scriptorium.runtime import cut, table

#: Blocks of an excerpt, characters that each has at least, pages that a sample strides over.
EXCERPT_BLOCKS, EXCERPT_CHARS, SAMPLED_PAGES = 64, 250, 40
#: HTTP states and phrases of faults that pass.
RETRY_STATES = (408, 409, 429, 500, 502, 503, 504)
RETRY_PHRASES = ("rate limit", "too many requests", "temporarily unavailable", "service unavailable", "timeout", "deadline exceeded", "connection reset")
RETRY_TYPES = ("ConnectionError", "TimeoutError", "OSError")
STOPS = ("pass", "early_accept", "inconclusive_accept")


def decision(judged: Column, inconclusive: Column, passed: Column, score: Column, early: float) -> Column:
    """What a scored attempt leads to: pass, early_accept (0 < early <= score), inconclusive_accept (no judge, or one without an opinion), or continue."""
    return (
        F.when(~F.coalesce(judged, F.lit(False)) | F.coalesce(inconclusive, F.lit(False)), "inconclusive_accept")
        .when(F.coalesce(passed, F.lit(False)), "pass")
        .when((F.lit(early) > 0) & (score >= early), "early_accept")
        .otherwise("continue")
    )


def chain(attempts: DataFrame, key: str, order: str, ran: str = "ran", verdict: str = "decision", score: str = "score") -> DataFrame:
    """Each key's attempts up to the first that stops the chain: how many, the decision at its end, and the attempt taken.

    Attempts that failed never stop the chain and are never taken. The one that
    stops it is taken; else the best score, the earliest of ties.
    """
    stops = F.when(F.col(ran) & F.col(verdict).isin(*STOPS), F.col(order))
    first = attempts.withColumn("_stop", F.min(stops).over(Window.partitionBy(key)))
    tried = first.filter(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop")))
    best = F.max_by(order, F.when(F.col(ran), F.struct(F.coalesce(score, F.lit(-1.0)), -F.col(order))))
    ends = tried.groupBy(key).agg(F.count("*").alias("tried"), F.max(F.when(F.col(order) == F.col("_stop"), F.col(verdict))).alias("_end"), F.max("_stop").alias("_stop"), best.alias("_best"))
    return ends.select(key, "tried", F.coalesce("_end", F.lit("exhausted")).alias("end"), F.coalesce("_stop", "_best").alias("taken"))


def matched_back(units: DataFrame, answers: DataFrame, keys: list[str], source: str, output: str) -> DataFrame:
    """Units with their answer and ``state``: ok, missing, or why the answer isn't taken; the units not ok are the fallback set.

    Answers of unknown keys are left out; of several for a key one counts, the
    first in order of ``pos``.
    """
    first = answers.groupBy(*keys).agg(F.min_by(output, "pos").alias(output))
    joined = units.join(first, keys, "left")
    fault = F.when(F.col(output).isNull(), "missing").otherwise(T.output_fault(F.col(source), F.col(output)))
    return joined.withColumn("state", F.coalesce(fault, F.lit("ok")))


def outputs_of(answer: Column, n: Column, keys: tuple[str, ...] = ("translations", "results", "items", "data", "outputs")) -> Column:
    """The outputs of an answer to ``n`` units, whatever its shape; null if it has none of these.

    An array of strings is taken as it is; of an object, the first array below
    one of the keys; an object without one is a single output, and so is a
    single string, if one unit was asked for.
    """
    plain = T.stripped_fences(answer)
    tries = [F.when(plain.startswith("["), F.from_json(plain, "array<string>"))]
    tries += [F.when(plain.startswith("{") & F.get_json_object(plain, f"$.{k}").startswith("["), F.from_json(F.get_json_object(plain, f"$.{k}"), "array<string>")) for k in keys]
    tries.append(F.when(plain.startswith("{") & F.get_json_object(plain, "$").isNotNull(), F.array(plain)))
    tries.append(F.when((n == 1) & plain.startswith('"'), F.array(F.get_json_object(F.concat(F.lit('{"o":'), plain, F.lit("}")), "$.o"))))
    return F.filter(F.coalesce(*tries), lambda x: x.isNotNull())


def retryable(kind: Column, status: Column, message: Column) -> Column:
    """A fault that passes, by its type, HTTP state or message."""
    low = F.lower(F.coalesce(message, F.lit("")))
    phrase = F.lit(False)
    for p in RETRY_PHRASES:
        phrase = phrase | low.contains(p)
    return F.coalesce(kind.isin(*RETRY_TYPES), F.lit(False)) | F.coalesce(status.isin(*RETRY_STATES), F.lit(False)) | phrase


def excerpt(blocks: Column, budget: int, most_blocks: int = EXCERPT_BLOCKS, least_chars: int = EXCERPT_CHARS) -> Column:
    """At most ``budget`` characters of a document: all blocks if they fit, else evenly spaced ones, each cut to its share of what is left."""
    texts = F.filter(F.transform(blocks, T.squeezed), lambda t: t != "")

    def chosen(texts: Column) -> Column:
        n = F.size(texts)
        total = F.aggregate(texts, F.lit(0), lambda s, t: s + F.length(t))
        count = F.least(F.lit(most_blocks), n, F.lit(max(1, budget // least_chars)))
        start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"))

        def take(s: Column, i: Column) -> Column:
            left = F.lit(budget) - s["used"]
            quota = F.least(left, F.greatest(F.lit(1), F.floor(left / (count - i)).cast("int")))
            text = F.substr(F.get(texts, F.floor(i * n / count).cast("int")), F.lit(1), quota)
            return F.when(left <= 0, s).otherwise(F.struct((s["used"] + F.length(text)).alias("used"), F.concat(s["out"], F.array(text)).alias("out")))

        some = F.aggregate(F.sequence(F.lit(0), count - 1), start, take, lambda s: F.array_join(s["out"], "\n"))
        return F.when(n == 0, F.lit("")).when(total <= budget, F.array_join(texts, "\n")).otherwise(some)

    return F.transform(F.array(texts), chosen)[0]


def base58(number: Column, digits: int, alphabet: str = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz") -> Column:
    """A non-negative number in so many digits of base 58, the highest first; ids made of a hash stay the same in every run."""
    return F.concat(*[F.substr(F.lit(alphabet), (F.pmod(F.floor(number / F.lit(58**k)), F.lit(58)) + 1).cast("int"), F.lit(1)) for k in reversed(range(digits))])


def is_cjk(*languages: Column) -> Column:
    """Any of the languages is Chinese, Japanese or Korean, which take more tokens a character."""
    out = F.lit(False)
    for lang in languages:
        low = F.lower(F.coalesce(lang, F.lit("")))
        out = out | low.startswith("zh") | low.startswith("ja") | low.startswith("ko")
    return out


def priced_parts(parts: DataFrame, key: str, order: str, tiers: Column, total_cost: str) -> DataFrame:
    """Parts (tokens_in, tokens_out) with ``cost`` by each part's own tier, the last one taking what is missing from the key's total unless that is 0."""
    of = Window.partitionBy(key)
    own = F.bround(cost.price(cost.tier_of(tiers, F.col("tokens_in")), F.col("tokens_in"), F.col("tokens_out"), F.lit(0)), 8)
    rows = parts.withColumn("cost", own).withColumn("_last", F.row_number().over(of.orderBy(F.desc(order))) == 1)
    drift = F.bround(F.col(total_cost) - F.sum("cost").over(of), 8)
    return rows.withColumn("cost", F.when(F.col("_last") & (F.col(total_cost) != 0), F.bround(F.col("cost") + drift, 8)).otherwise(F.col("cost"))).drop("_last")


def once_for_attempts(units: DataFrame, attempts: DataFrame, key: str, made) -> DataFrame:
    """What ``made`` makes of the units, written once and joined to every attempt of theirs."""
    return attempts.join(cut(made(units)), key)


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as attempts of their order: discount as score, flags as failures and opinions."""
    items = table(spark, sf_dir, "lineitem")
    score = F.round(F.max("l_discount") * 10, 3)
    rows = items.groupBy(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("attempt")).agg(score.alias("score"), (F.max("l_returnflag") != "R").alias("ran"), (F.max("l_quantity") % 9 == 0).alias("inconclusive"))
    return rows.withColumn("decision", decision(F.col("job") % 13 != 0, F.col("inconclusive"), F.col("score") >= 0.9, F.col("score"), 0.7))


def attempt_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain(_attempts(spark, sf_dir), "job", "attempt")


def attempt_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of a job in order, from 0, with the letter of their variant."""
    n = F.row_number().over(Window.partitionBy("job").orderBy("attempt"))
    return _attempts(spark, sf_dir).select("job", "attempt", (n - 1).alias("attempt_index"), F.chr((n + 64).cast("long")).alias("variant"))


def answers_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns matched with the items of one answer a conversation, which lacks some, has some blank and some of unknown turns, and is cut short now and then."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    given = F.when(F.col("turn") % 7 == 2, F.lit(" ")).when(F.col("turn") % 3 == 1, F.concat(F.lit('say "'), "text", F.lit('"\n'))).otherwise(F.col("text"))
    shown = F.when(F.col("turn") % 6 == 5, F.col("turn") + 10**15).otherwise(F.col("turn"))  # no conversation has that many turns
    items = turns.filter("turn % 5 <> 3").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(shown.cast("long").alias("id"), given.alias("output")))).alias("items"))
    whole = F.to_json("items")
    raw = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit('```json{"items": '), whole, F.lit("}```"))).when(F.col("conv_id") % 3 == 1, whole).otherwise(F.concat(F.substr(whole, F.lit(1), F.length(whole) - 1), F.lit(', {"id": 0, "outp')))
    plain = T.stripped_fences(raw)
    found = F.when(F.col("conv_id") % 3 == 2, T.salvaged_items(plain)).otherwise(T.normalized_items(plain, "array<struct<id:long,output:string>>"))
    answers = items.select("conv_id", F.posexplode(found).alias("pos", "i")).select("conv_id", F.col("i.id").alias("turn"), "pos", F.col("i.output").alias("output"))
    back = matched_back(turns, answers, ["conv_id", "turn"], "text", "output")
    return back.select("conv_id", "turn", "state", F.sha2("output", 256).alias("output_sha256"))


def answer_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of answers of many shapes, the number of units that was asked for beside them."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.col("text").alias("o"))).alias("o"))
    quoted = F.substr("o", F.lit(6), F.length("o") - 6)
    k = F.col("turn") % 8
    array = F.concat(F.lit("["), quoted, F.lit(', "b"]'))
    raw = (
        F.when(k == 0, array)
        .when(k == 1, F.concat(F.lit('{"x": 1, "results": '), array, F.lit("}")))
        .when(k == 2, F.col("o"))
        .when(k.isin(3, 4), quoted)
        .when(k == 5, F.concat(F.lit('{"data": "no array", "outputs": '), array, F.lit("}")))
        .when(k == 6, F.concat(F.lit("```json"), array, F.lit("```")))
        .otherwise(F.lit("no JSON at all"))
    )
    outs = outputs_of(raw, F.when(k == 4, 2).otherwise(1))
    return turns.select("conv_id", "turn", F.size(outs).alias("n"), F.coalesce(outs.isNull(), F.lit(True)).alias("fault"), F.sha2(F.get(outs, F.lit(0)), 256).alias("first_sha256"))


def fault_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as faults: of a type, a state or a message; how many of each pass."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 5 == 0, "TimeoutError").when(F.col("event_id") % 5 == 1, "ValueError")
    status = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 7 + 498).cast("int"))
    message = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("Service Unavailable for "), F.col("event_type"))).otherwise(F.col("event_type"))
    return e.groupBy("event_type").agg(F.count(F.when(retryable(kind, status, message), 1)).alias("again"), F.count("*").alias("n"))


def excerpt_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = excerpt(F.split("text", "[.\n]"), 600, least_chars=100)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(found).alias("n_chars"), F.sha2(found, 256).alias("excerpt_sha256"))


def page_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every k-th page of a document, for about 40 of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.ceil(F.col("n_chars") / 100), F.lit(1)).cast("int").alias("pages"))
    k = F.greatest(F.lit(1), F.expr(f"pages div {SAMPLED_PAGES}")).cast("int")
    return docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("pages") - 1, k)).alias("page")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("page").alias("last"))


def short_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 7), 16, 10).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", base58(number, 5).alias("id"))


def cost_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders priced as one call, their tokens dealt to lines by quantity, and each line priced by its own tier."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.floor("l_quantity").cast("long")).alias("q"))
    of = Window.partitionBy("l_orderkey")
    (entry,) = [e for e in cost.CATALOG if e[2] == "mini-v2"]
    names = ("max_input_tokens", "input", "output", "cache_hit")
    tiers = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, tier, strict=True)]) for tier in entry[4]]).cast(cost.TIERS)
    rows = lines.withColumn("all_in", F.sum("q").over(of) * 50 + 7).withColumn("all_out", F.sum("q").over(of) * 20 + 3)
    rows = cost.allocated(rows, "l_orderkey", "l_linenumber", "q", F.col("all_in")).withColumnRenamed("allocated", "tokens_in")
    rows = cost.allocated(rows, "l_orderkey", "l_linenumber", "q", F.col("all_out")).withColumnRenamed("allocated", "tokens_out")
    rows = rows.withColumn("total_cost", F.bround(cost.price(cost.tier_of(tiers, F.col("all_in")), F.col("all_in"), F.col("all_out"), F.lit(0)), 8))
    return priced_parts(rows, "l_orderkey", "l_linenumber", tiers, "total_cost").select("l_orderkey", "l_linenumber", "tokens_in", F.round("cost", 7).alias("cost"))


def attempt_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of documents made once and used by three attempts each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    attempts = docs.select("doc_id", F.explode(F.array(*map(F.lit, range(3)))).alias("attempt"))
    return once_for_attempts(docs, attempts, "doc_id", lambda d: d.select("doc_id", F.sha2("text", 256).alias("key"))).select("doc_id", "attempt", "key")


def cjk_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("out", F.when(F.col("doc_id") % 4 == 0, "zh-TW").when(F.col("doc_id") % 4 == 1, "JA").when(F.col("doc_id") % 4 == 2, "en"))
    return docs.groupBy("lang").agg(F.count(F.when(is_cjk(F.col("lang"), F.col("out")), 1)).alias("n_cjk"))


QUERIES = {f.__name__: f for f in (attempt_chain, attempt_ordinals, answers_back, answer_shapes, fault_retries, excerpt_quotas, page_stride, short_ids, cost_chunks, attempt_reuse, cjk_share)}
_A = """a AS (SELECT l_orderkey AS job, l_linenumber AS attempt, round(max(l_discount) * 10, 3) AS score, max(l_returnflag) <> 'R' AS ran, max(l_quantity) % 9 = 0 AS inc FROM lineitem GROUP BY ALL),
        d AS (SELECT *, CASE WHEN job % 13 = 0 OR inc THEN 'inconclusive_accept' WHEN score >= 0.9::DOUBLE THEN 'pass' WHEN score >= 0.7::DOUBLE THEN 'early_accept' ELSE 'continue' END AS decision FROM a)"""
_ID = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
ORACLE_SQL = {
    "attempt_chain": f"""WITH {_A}, s AS (SELECT *, min(attempt) FILTER (ran AND decision <> 'continue') OVER (PARTITION BY job) AS stop FROM d), t AS (SELECT * FROM s WHERE stop IS NULL OR attempt <= stop)
        SELECT job, count(*) AS tried, coalesce(max(decision) FILTER (attempt = stop), 'exhausted') AS "end", coalesce(max(stop), arg_max(attempt, (score, -attempt)) FILTER (ran)) AS taken FROM t GROUP BY job""",
    "attempt_ordinals": f"WITH {_A} SELECT job, attempt, CAST(row_number() OVER w - 1 AS INTEGER) AS attempt_index, chr(CAST(64 + row_number() OVER w AS INTEGER)) AS variant FROM d WINDOW w AS (PARTITION BY job ORDER BY attempt)",
    "answers_back": """WITH t AS (SELECT conv_id, turn, text, CASE WHEN turn % 7 = 2 THEN ' ' WHEN turn % 3 = 1 THEN 'say "' || text || '"' || chr(10) ELSE text END AS o FROM conversations),
        g AS (SELECT *, CASE WHEN turn % 5 = 3 OR turn % 6 = 5 THEN NULL ELSE o END AS output FROM t),
        n AS (SELECT *, greatest(1, length(regexp_replace(text, '[. 。…，]{20,}', '.', 'g')) // 4) AS a, greatest(1, length(output) // 4) AS b FROM g)
        SELECT conv_id, turn, sha256(output) AS output_sha256, CASE WHEN output IS NULL THEN 'missing' WHEN trim(output) = '' THEN 'empty'
          WHEN regexp_replace(text, '[. 。…，]{20,}', '.', 'g') = output AND a > 10 THEN 'same_text' WHEN NOT (b / a > 0.3::DOUBLE AND b / a < 3) THEN 'length_ratio'
          WHEN a > 20 AND levenshtein(text, output) <= 4 THEN 'edit_distance' ELSE 'ok' END AS state FROM n""",
    "answer_shapes": """WITH t AS (SELECT conv_id, turn, turn % 8 AS k, text FROM conversations)
        SELECT conv_id, turn, CASE WHEN k IN (0, 1, 5, 6) THEN 2 WHEN k IN (2, 3) THEN 1 END AS n, k IN (4, 7) AS fault,
          CASE WHEN k IN (0, 1, 3, 5, 6) THEN sha256(text) WHEN k = 2 THEN sha256('{"o":' || CAST(to_json(text) AS VARCHAR) || '}') END AS first_sha256 FROM t""",
    "fault_retries": """WITH f AS (SELECT event_type, event_id % 5 = 0 OR (event_id % 3 = 0 AND event_id % 7 + 498 IN (408, 409, 429, 500, 502, 503, 504)) OR event_id % 11 = 0 AS again FROM events)
        SELECT event_type, count(*) FILTER (again) AS again, count(*) AS n FROM f GROUP BY event_type""",
    "excerpt_quotas": r"""WITH RECURSIVE b AS MATERIALIZED (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.\n]'), lambda t: trim(regexp_replace(t, '\s+', ' ', 'g'))), lambda t: t <> '') AS ts FROM documents),
        c AS MATERIALIZED (SELECT *, len(ts) AS n, least(64, len(ts), 6) AS m, coalesce(list_sum(list_transform(ts, lambda t: length(t))), 0) AS total FROM b),
        f AS (SELECT doc_id, ts, n, m, 0 AS i, 0::BIGINT AS used, []::VARCHAR[] AS out FROM c WHERE total > 600
              UNION ALL SELECT doc_id, ts, n, m, i + 1, used + length(x), CASE WHEN used >= 600 THEN out ELSE list_append(out, x) END
              FROM (SELECT *, CASE WHEN used >= 600 THEN '' ELSE substr(ts[(i * n) // m + 1], 1, CAST(least(600 - used, greatest(1, (600 - used) // (m - i))) AS BIGINT)) END AS x FROM f WHERE i < m)),
        x AS (SELECT doc_id, array_to_string(out, chr(10)) AS e FROM f WHERE i = m UNION ALL SELECT doc_id, array_to_string(ts, chr(10)) FROM c WHERE total <= 600)
        SELECT doc_id, CAST(length(e) AS INTEGER) AS n_chars, sha256(e) AS excerpt_sha256 FROM x""",
    "page_stride": """WITH p AS (SELECT doc_id, CAST(greatest(ceil(n_chars / 100), 1) AS INTEGER) AS pages FROM documents)
        SELECT doc_id, len(range(0, pages, greatest(1, pages // 40))) AS n, CAST(list_max(range(0, pages, greatest(1, pages // 40))) AS INTEGER) AS last FROM p""",
    "short_ids": f"""WITH n AS (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 7) AS BIGINT) AS v FROM documents)
        SELECT doc_id, {' || '.join(f"substr('{_ID}', CAST(v // {58**k} % 58 + 1 AS BIGINT), 1)" for k in reversed(range(5)))} AS id FROM n""",
    "cost_chunks": """WITH l AS (SELECT l_orderkey, l_linenumber, CAST(sum(floor(l_quantity)) AS BIGINT) AS q FROM lineitem GROUP BY ALL),
        s AS (SELECT *, sum(q) OVER o AS sq, sum(q) OVER o * 50 + 7 AS all_in, sum(q) OVER o * 20 + 3 AS all_out, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) = 1 AS last FROM l WINDOW o AS (PARTITION BY l_orderkey)),
        r AS (SELECT *, CAST(round_even(all_in * (q / sq), 0) AS BIGINT) AS ri, CAST(round_even(all_out * (q / sq), 0) AS BIGINT) AS ro FROM s),
        t AS (SELECT *, CASE WHEN last THEN all_in - coalesce(sum(ri) FILTER (NOT last) OVER o, 0) ELSE ri END AS tokens_in, CASE WHEN last THEN all_out - coalesce(sum(ro) FILTER (NOT last) OVER o, 0) ELSE ro END AS tokens_out FROM r WINDOW o AS (PARTITION BY l_orderkey)),
        p AS (SELECT *, tokens_in / 1000 * (CASE WHEN tokens_in <= 4000 THEN 0.0002::DOUBLE ELSE 0.0003 END) + tokens_out / 1000 * (CASE WHEN tokens_in <= 4000 THEN 0.0008::DOUBLE ELSE 0.0009 END) AS c,
                all_in / 1000 * (CASE WHEN all_in <= 4000 THEN 0.0002::DOUBLE ELSE 0.0003 END) + all_out / 1000 * (CASE WHEN all_in <= 4000 THEN 0.0008::DOUBLE ELSE 0.0009 END) AS total FROM t)
        SELECT l_orderkey, l_linenumber, CAST(tokens_in AS BIGINT) AS tokens_in, round(CASE WHEN last THEN c + total - sum(c) OVER (PARTITION BY l_orderkey) ELSE c END, 7) AS cost FROM p""",
    "attempt_reuse": "SELECT doc_id, attempt, sha256(text) AS key FROM documents, (VALUES (0), (1), (2)) t(attempt)",
    "cjk_share": "SELECT lang, count(*) FILTER (doc_id % 4 < 2) AS n_cjk FROM documents GROUP BY lang",
}
