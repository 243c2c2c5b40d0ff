"""Glossary matching: all terms that occur in a text, as a join."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms up to which all of them are sent out as one automaton; beyond, terms are matched by their first word.
AUTOMATON_TERMS = 200_000


def _low(column: str):
    """ASCII letters in lower case."""
    return F.translate(F.col(column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def term_hits(texts: DataFrame, terms: DataFrame, key: str, text: str, term: str) -> DataFrame:
    """(key, term) for every term inside a text: ASCII case ignored, no word bounds, the text's white space collapsed; one hit a term.

    The terms are counted first. A bounded glossary becomes one automaton that
    every task runs over its texts. A larger one stays distributed: terms and
    texts meet on the terms' first five characters.
    """
    texts = texts.select(key, F.regexp_replace(_low(text), r"\s+", " ").alias("_t"))
    terms = terms.select(term).filter(F.length(term) > 0).distinct().withColumn("_low", _low(term))
    if terms.count() <= AUTOMATON_TERMS:
        pairs = [(r["_low"], r[term]) for r in terms.collect()]

        def run(batches):
            import ahocorasick

            found: dict[str, list[str]] = {}
            for low, name in pairs:
                found.setdefault(low, []).append(name)
            automaton = ahocorasick.Automaton()
            for low, names in found.items():
                automaton.add_word(low, names)
            if found:
                automaton.make_automaton()
            for rows in batches:
                hits = [sorted({n for _, names in automaton.iter(t) for n in names}) if found and t else [] for t in rows["_t"]]
                out = pd.DataFrame({key: rows[key], term: hits}).explode(term)
                yield out[out[term].notna()]

        kind = texts.schema[key].dataType.simpleString()
        return texts.mapInPandas(run, f"{key} {kind}, {term} string")
    grams = F.expr("transform(sequence(1, greatest(length(_t), 1)), i -> substring(_t, i, 5))")
    left = texts.select(key, "_t", F.explode(F.array_distinct(grams)).alias("_g"))
    long = terms.filter("length(_low) >= 5").withColumn("_g", F.substring("_low", 1, 5))
    short = terms.filter("length(_low) < 5")
    hits = left.join(long, "_g").filter(F.col("_t").contains(F.col("_low"))).select(key, term)
    few = left.withColumn("_p", F.explode(F.expr("transform(sequence(1, 4), n -> substring(_g, 1, n))"))).join(short.withColumnRenamed("_low", "_p"), "_p").select(key, term)
    return hits.union(few).distinct()


def normalized_key(term):
    """Lower case with white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(term), r"\s+", " "))


def first_by_key(rows: DataFrame, keys: list, order: list[str]) -> DataFrame:
    """The first row of each key, in order; aggregated before the shuffle, so a frequent key is one row of each task."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_first")).select(*keys, *[f"_first.{c}" for c in (*order, *rest)])
