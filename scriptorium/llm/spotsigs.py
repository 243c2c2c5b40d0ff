"""SpotSigs fingerprints, in DataFrame operations only.

A signature is a common word (an antecedent) with the next ``CHAIN`` content
words behind it, looked for among the next ``REACH`` words; other antecedents in
between are passed over. A text's fingerprint is the set of its signatures'
32-bit hashes, in rising order; in a text without one, as of a language without
listed common words, every word starts a chain, and a text of fewer words takes
one hash of them all. Likeness is the Jaccard similarity of two sets.

``near_duplicates`` joins fingerprints: classes of equal sets are formed first;
sets are partitioned by length so that similar ones lie in the same or the next
partition; inside a partition only sets that share a hash among their rarest
ones (the prefix that the threshold demands) are compared, lengths first.

Defined results: null and empty text have the empty fingerprint, which is like
another empty one (1) and unlike any other (0); the neighbour of the last
document is the first, of an only document itself; ids are any 64-bit numbers;
null ids come last; rows of one id, or of none, are ordered by a hash of the
text, and equal rows are dealt out like any others; only the named columns are
read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, table

#: Common words of English, German, French and Spanish.
ANTECEDENTS = (
    "the of and to in a is that it for was on are as with be this from by an "
    "der die und den das dem des nicht ist ein mit zu auf "
    "le la les de et un une est que dans pour "
    "el los las del y en se con por su"
).split()
CHAIN, REACH = 2, 8
#: Documents of a range in order of id; a window holds one range. Beyond so many ranges, these grow.
RANGE, RANGES = 2000, 65_536
#: Documents that a range of a small table has at least, and text bytes of a task while there are ranges enough.
LEAST_RANGE, TASK_BYTES = 100, 32 << 20
#: Rows that are drawn to find a border between ranges; borders decide who works, never the result.
DRAWN = 8
_SIGN = -(1 << 63)


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often it's used."""
    return F.transform(F.array(value), use)[0]


def _short(h: Column) -> Column:
    return h.bitwiseAND(F.lit(0xFFFFFFFF))


def signatures(text: Column) -> Column:
    """Sorted distinct 32-bit hashes of a text's spot signatures."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D.,;:!?]+"), lambda w: w != "")

    def hashes(words: Column) -> Column:
        def spot(word: Column, i: Column) -> Column:
            # Single places are read, for slices copy the whole array.
            chain = F.filter(F.array(*[F.get(words, i + k) for k in range(1, REACH + 1)]), lambda w: ~w.isin(ANTECEDENTS))
            return F.when(word.isin(ANTECEDENTS), _bound(chain, lambda c: F.when(F.size(c) >= CHAIN, _short(F.xxhash64(word, *[F.get(c, F.lit(k)) for k in range(CHAIN)])))))

        found = F.array_distinct(F.filter(F.transform(words, spot), lambda h: h.isNotNull()))
        chains = lambda: F.transform(F.sequence(F.lit(0), F.size(words) - CHAIN - 1), lambda i: _short(F.xxhash64(F.lit(""), *[F.get(words, i + k) for k in range(CHAIN + 1)])))
        rest = F.when(F.size(words) > CHAIN, F.sort_array(F.array_distinct(chains()))).otherwise(F.array(_short(F.xxhash64(words))))
        return _bound(found, lambda f: F.when(F.size(f) > 0, F.sort_array(f)).when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(rest))

    return _bound(words, hashes)


def rendered(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sorted sets; the share of lengths tells first where it must be 0."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(F.least(F.size(a), F.size(b)) == 0, F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def _sortable(*longs: Column) -> Column:
    """Text that sorts as the numbers do, one after the other."""
    return F.concat(*[F.lpad(F.hex(x.bitwiseXOR(F.lit(_SIGN))), 16, "0") for x in longs])


def _range_of(place: Column, borders: list[str]) -> Column:
    """The number of borders at or before the place, by binary search."""
    if not borders:
        return F.lit(0)
    among = F.split(F.lit(",".join(borders)), ",")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(borders).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(among, at + step - 1) <= place, at + step).otherwise(at))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, sigs and those of the next document in order of id (next_text, next_sigs); the last one's next is the first.

    Ranges of documents are ordered apart from each other; each takes the first
    document of the next range as its border. Ranges lie between places drawn
    from the documents, so they hold about as many each, whatever the ids.
    """
    docs = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    keys = ["none", "key", "mark"]
    docs = docs.withColumn("none", F.col("id").isNull()).withColumn("key", F.coalesce("id", F.lit(0))).withColumn("mark", F.xxhash64("text"))
    place = F.concat(F.col("none").cast("int").cast("string"), _sortable(F.col("key"), F.col("mark"), F.monotonically_increasing_id()))
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    ranges = max(1, min(RANGES, max(n // RANGE, min(4 * cores, n // LEAST_RANGE))))
    # So many tasks, as a count of bytes after the shuffle says nothing of the work on them.
    tasks = min(ranges, max(cores, (size or 0) // TASK_BYTES))
    borders: list[str] = []
    if ranges > 1:
        drawn = sorted(r.place for r in docs.select(place.alias("place")).sample(min(1.0, DRAWN * ranges / n), 7).collect())
        borders = [drawn[i * len(drawn) // ranges] for i in range(1, ranges)] if drawn else []
    docs = docs.withColumn("place", place).withColumn("range", _range_of(F.col("place"), borders))
    firsts = cut(docs.groupBy("range").agg(F.min(F.struct(*keys)).alias("first")).select("range", "first.*"))
    # One row a range, RANGES at most: its first document borders the range before, the very first one the last range.
    top = firsts.agg(F.max("range").alias("top"))
    edges = firsts.crossJoin(F.broadcast(top)).withColumn("to", F.coalesce(F.lag("range").over(Window.orderBy("range")), "top")).drop("top")
    border = docs.join(F.broadcast(edges), ["range", *keys]).dropDuplicates(["to"]).select(F.col("to").alias("range"), F.lit(1).alias("edge"), "place", "id", "text")
    rows = docs.select("range", F.lit(0).alias("edge"), "place", "id", "text").union(border)
    rows = rows.repartition(tasks, "range").withColumn("sigs", signatures(F.col("text")))
    behind = F.lead(F.struct("text", "sigs")).over(Window.partitionBy("range").orderBy("edge", "place"))
    return rows.withColumn("next", behind).filter("edge = 0").select("id", "text", "sigs", F.col("next.text").alias("next_text"), F.col("next.sigs").alias("next_sigs"))


def near_duplicates(docs: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Membership (id, class_id) and pairs (a, b, similarity) of classes whose sets are like enough."""
    import math

    sets = docs.select(docs[id_col].cast("long").alias("id"), signatures(docs[text_col].cast("string")).alias("sigs")).filter("id is not null and size(sigs) > 0")
    sets = cut(sets)
    classes = cut(sets.groupBy("sigs").agg(F.min("id").alias("class_id")))
    hashes = classes.select("class_id", F.size("sigs").alias("n"), F.explode("sigs").alias("h"))
    counts = hashes.groupBy("h").agg(F.count("*").alias("c"))
    ordered = hashes.join(counts, "h").groupBy("class_id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("hs"))
    need = F.ceil(F.col("n") * F.lit(threshold)).cast("int")
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold)))
    prefix = ordered.select("class_id", "n", part.alias("part"), F.explode(F.slice("hs", F.lit(1), F.col("n") - need + 1)).alias("x")).select("class_id", "n", "part", F.col("x.h").alias("h"))
    small = prefix.select(F.col("class_id").alias("a"), F.col("n").alias("m"), "h", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    pairs = small.join(prefix.withColumnRenamed("class_id", "b"), ["h", "part"]).filter("(m < n or (m = n and a < b)) and m >= n * %r" % threshold).select("a", "b").distinct()
    full = pairs.join(classes.select(F.col("class_id").alias("a"), F.col("sigs").alias("x")), "a").join(classes.select(F.col("class_id").alias("b"), F.col("sigs").alias("y")), "b")
    alike = full.select("a", "b", likeness(F.col("x"), F.col("y")).alias("similarity")).filter(F.col("similarity") >= threshold)
    return sets.join(classes, "sigs").select("id", "class_id"), alike


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents"), "doc_id", "text")
    text, after = F.coalesce("text", F.lit("")), F.coalesce("next_text", F.lit(""))
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    rows = rows.select("id", "sigs", "next_sigs", n.cast("long").alias("n_chars"), F.concat(F.substr(text, F.lit(1), n - half), F.substr(after, F.lit(1), half)).alias("edited"))
    rows = rows.withColumn("edited_sigs", signatures(F.col("edited")))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        rendered(F.col("sigs")).alias("fingerprint"),
        rendered(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


QUERIES = {"op4_spotsigs": op4_spotsigs}
ORACLE_SQL: dict[str, str] = {}
