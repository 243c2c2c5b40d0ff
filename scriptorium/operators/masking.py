"""Masking of personal data with reversible tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.runtime import cut

#: Kinds of personal data and their patterns, in order; of matches that start together the earlier pattern wins.
PATTERNS = (
    ("EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("PHONE_NUMBER", r"\+[1-9]\d{6,14}\b"),
    ("PHONE_NUMBER", r"\+[1-9][\d\s().\-]{6,20}\d\b"),
    ("PHONE_NUMBER", r"\b(?:\(\d{3}\)|\d{3})[\s.\-]\d{3}[\s.\-]\d{4}\b"),
    ("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"),
    ("MAC_ADDRESS", r"\b(?:[0-9A-Fa-f]{2}[:\-]){5}[0-9A-Fa-f]{2}\b"),
    ("CREDIT_CARD_NUMBER", r"\b(?:4\d{12}(?:\d{3})?|5[1-5]\d{14}|3[47]\d{13}|3(?:0[0-5]|[68]\d)\d{11}|6(?:011|5\d{2})\d{12}|(?:2131|1800|35\d{3})\d{11})\b"),
    ("IBAN_CODE", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b"),
    ("SWIFT_CODE", r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b"),
    ("US_SOCIAL_SECURITY_NUMBER", r"\b(?!000|666|9\d{2})\d{3}[-\s](?!00)\d{2}[-\s](?!0000)\d{4}\b"),
    ("US_PASSPORT", r"\b[A-Z]\d{8}\b"),
    ("US_EMPLOYER_IDENTIFICATION_NUMBER", r"\b\d{2}-\d{7}\b"),
    ("UK_NATIONAL_INSURANCE_NUMBER", r"\b(?!BG|GB|NK|KN|TN|NT|ZZ)[A-CEGHJ-PR-TW-Z]{2}\s?\d{6}\s?[A-D]\b"),
    ("INDIA_AADHAAR_INDIVIDUAL", r"\b[2-9]\d{3}\s?\d{4}\s?\d{4}\b"),
    ("INDIA_PAN_INDIVIDUAL", r"\b[A-Z]{5}\d{4}[A-Z]\b"),
    ("JSON_WEB_TOKEN", r"\beyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+"),
    ("BASIC_AUTH_HEADER", r"\bBasic\s+[A-Za-z0-9+/]{10,}={0,2}"),
    ("AUTH_TOKEN", r"\bBearer\s+[A-Za-z0-9\-_.]{10,}"),
    ("GCP_API_KEY", r"\bAIza[A-Za-z0-9\-_]{35}\b"),
    ("AWS_CREDENTIALS", r"\b(?:AKIA|ASIA|AROA|ANPA|ANVA|AIPA)[A-Z0-9]{16}\b"),
)


def counts(text: Column, patterns=PATTERNS) -> dict[str, Column]:
    """Matches of each kind, patterns taken apart from each other."""
    out: dict[str, Column] = {}
    for name, pattern in patterns:
        n = F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
        out[name] = out[name] + n if name in out else n
    return out


def masked(chunks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """key, order, masked text and rows (token, original, kind) of each chunk.

    Matches that overlap an earlier one are passed over. Inside a chunk numbers
    run from the last match to the first; over a key's chunks the counter goes
    on, in order. It is made of counts per chunk: only the key, order and count
    of chunks that have matches come together, and what was found goes back to
    the texts by key and order, which tell chunks apart. Patterns run once.
    """
    found_type = "start int, end int, original string, kind string"

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(name, re.compile(p)) for name, p in PATTERNS]
        for rows in batches:
            spans = []
            for t in rows[text].fillna(""):
                hits = sorted(((m.start(), m.end(), m[0], name) for name, p in compiled for m in p.finditer(t)), key=lambda h: h[0])
                kept, last = [], -1
                for h in hits:
                    if h[0] >= last:
                        kept.append(h)
                        last = h[1]
                spans.append(kept)
            yield rows.assign(found=[[dict(zip(("start", "end", "original", "kind"), h, strict=True)) for h in s] for s in spans])

    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema}
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {text} string, found array<struct<{found_type.replace(' ', ':').replace(',:', ',')}>>"
    found = cut(chunks.select(key, order, text).mapInPandas(find, schema))
    spans = found.filter(F.size("found") > 0).select(key, order, F.size("found").alias("_n"))
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = spans.withColumn("before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col(key).alias("_key"), F.col(order).alias("_order"), "before")
    found = found.join(placed, found[key].eqNullSafe(placed["_key"]) & found[order].eqNullSafe(placed["_order"]), "left").drop("_key", "_order")
    n = F.size("found")
    number = lambda i: (F.col("before") + n - i).cast("string")
    token = lambda i: F.concat(F.lit("__DLP_TOKEN_"), F.lpad(number(i), F.greatest(F.lit(4), F.length(number(i))), F.lit("0")), F.lit("__"))
    rows = F.transform("found", lambda f, i: F.struct(token(i).alias("token"), f["original"].alias("original"), f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
    found = found.withColumn("rows", rows)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    piece = lambda s, r: F.substr(F.col(text), s["at"] + 1, r["start"] - s["at"])
    whole = F.aggregate("rows", start, lambda s, r: F.struct(r["end"].alias("at"), F.concat(s["out"], piece(s, r), r["token"]).alias("out")), lambda s: F.concat(s["out"], F.substr(F.col(text), s["at"] + 1)))
    return found.select(key, order, F.when(n > 0, whole).otherwise(F.col(text)).alias("masked"), F.transform("rows", lambda r: F.struct(r["token"], r["original"], r["kind"])).alias("rows"))


def unmasked(chunks: DataFrame, rows: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """Every token replaced by its original; of repeated tokens the later row counts."""
    last = rows.groupBy(*keys, "token").agg(F.max_by("original", order).alias("original"))
    maps = last.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("token", "original"))).alias("tokens"))
    maps = maps.withColumnsRenamed({k: f"_{k}" for k in keys})
    joined = chunks.join(maps, [chunks[k].eqNullSafe(maps[f"_{k}"]) for k in keys], "left")
    tokens = F.coalesce("tokens", F.array().cast("array<struct<token:string,original:string>>"))
    return joined.withColumn(text, F.aggregate(tokens, F.col(text), lambda t, r: F.replace(t, r["token"], r["original"]))).drop("tokens", *maps.columns)
