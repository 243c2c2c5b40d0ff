"""Rules by example, and ordered folds against plain versions of them."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import folds, masking, upsert
from scriptorium.operators.matching import term_hits
from scriptorium.plans import chunks, cost, jobs, language, logs, quality


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def one(spark, value, kind, expression):
    return rows(spark, [(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "category", "tokens"),
    [
        ("see https://a.example/x?y=1 and https://a.example/x?y=1", "url", ["https://a.example/x?y=1"]),
        ("write to a.b+c@d-e.org now", "email", ["a.b+c@d-e.org"]),
        ("route 10.0.0.0/8 or 2001:db8::/32", "cidr", ["10.0.0.0/8", "2001:db8::/32"]),
        ("PROJ-1234 and x#4567 but not #12 or #4567", "ticket_id", ["PROJ-1234", "#4567"]),
        ("run --verbose -v but not a-b", "cli_flag", ["--verbose", "-v"]),
        ("in 2024 it rose 12.5 to 1.2.3", "digits", ["2024", "12.5"]),
    ],
)
def test_protected(spark, text, category, tokens):
    assert one(spark, text, "string", lambda c: T.protected(c, category)) == tokens


def test_missing_is_empty_for_an_empty_side(spark):
    df = rows(spark, [("a 42", ""), ("", "x"), (None, "x"), ("a 42", "42 b"), ("a 42", "b")], "s string, t string")
    got = [r.m for r in df.select(T.missing(F.col("s"), F.col("t"), "digits").alias("m")).collect()]
    assert got == [[], [], [], [], ["42"]]


def test_skip_reasons(spark):
    data = [("  ",), ("ab",), ("12,5 % (3)",), ("<b> {x} %s",), ("A real sentence of words.",), (None,)]
    got = [r.r for r in rows(spark, data, "t string").select(T.skip_reason(F.col("t"), 3).alias("r")).collect()]
    assert got == ["empty", "short", "numeric", "placeholder", None, "empty"]


def test_output_faults(spark):
    long = "word " * 40
    data = [("abc", " "), ("abc", "## Security Notice x"), (long, long), ("abcd" * 10, "a"), (long, long[:-3] + "x"), ("Guten Tag", "Good day")]
    got = [r.r for r in rows(spark, data, "s string, t string").select(T.output_fault(F.col("s"), F.col("t")).alias("r")).collect()]
    assert got == ["empty", "prompt_leak", "same_text", "length_ratio", "edit_distance", None]


@pytest.mark.parametrize("piece", ["plain text ", 'a \\"b\\" \\n', "é漢\\\\"])
def test_salvage_of_long_outputs(spark, piece):
    whole = piece * 30_000
    cut = f'[{{"id": 1, "output": "{whole}"}}, {{"id": 2, "output": "c"}}, {{"id": 3, "output": "{whole}'
    assert [tuple(x) for x in one(spark, cut, "string", T.salvaged_items)] == [(1, json.loads(f'"{whole}"')), (2, "c")]


def test_salvage_and_shapes(spark):
    cut = '[{"id": 1, "output": "a\\"b"}, {"id": 2, "output": "c"}, {"id": 3, "outp'
    assert [tuple(x) for x in one(spark, cut, "string", T.salvaged_items)] == [(1, 'a"b'), (2, "c")]
    for text in ('[{"id":1,"output":"x"}]', '{"results":[{"id":1,"output":"x"}]}', '{"id":1,"output":"x"}'):
        assert [tuple(x) for x in one(spark, text, "string", lambda c: T.normalized_items(c, "array<struct<id:long,output:string>>"))] == [(1, "x")]
    assert one(spark, '```json{"a":1}```', "string", T.stripped_fences) == '{"a":1}'


def test_guardrail_and_tiers(spark):
    entries = cost.catalog(spark)
    usage = rows(spark, [("vendor-a", "large-x-preview", "eu"), ("vendor-a", "large", None), ("vendor-b", "other", None)], "provider string, model string, region string")
    got = {r.model: r.entry_model for r in cost.resolve_entry(usage, entries).collect()}
    assert got == {"large-x-preview": "large-x", "large": "large", "other": None}
    tiers = entries.filter("pos = 2").select(F.explode(F.array(F.lit(400), F.lit(501), F.lit(9999))).alias("n"), "tiers")
    assert [r.i for r in tiers.select(cost.tier_of(F.col("tiers"), F.col("n"))["input"].alias("i")).collect()] == [0.005, 0.006, 0.006]


def test_allocation_keeps_the_total(spark):
    parts = rows(spark, [("j", 0, 1), ("j", 1, 1), ("j", 2, 1), ("z", 0, 0), ("z", 1, 0)], "k string, i int, w int")
    got = {(r.k, r.i): r.allocated for r in cost.allocated(parts, "k", "i", "w", F.lit(10).cast("long")).collect()}
    assert got == {("j", 0): 3, ("j", 1): 3, ("j", 2): 4, ("z", 0): 0, ("z", 1): 10}


def test_index_percentile(spark):
    df = rows(spark, [("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("a", None), ("b", 7.0), ("b", 7.0)], "k string, v double")
    got = {r.k: (r.half, r.most) for r in logs.index_percentiles(df, ["k"], "v", half=0.5, most=0.99).collect()}
    assert got == {"a": (3.0, 4.0), "b": (7.0, 7.0)}


def test_language_gate(spark):
    hist = rows(spark, [("a", "en", 96, "en"), ("a", "xx", 4, "en"), ("b", "en", 50, "en"), ("b", "xx", 50, "en"), ("c", "de", 60, "en"), ("c", "en", 40, "en")], "k string, lang string, chars long, declared string")
    got = {r.k: r.verdict for r in language.gate(hist, "k", "declared").collect()}
    assert got == {"a": "ok", "b": "unsupported", "c": "mismatch"}
    assert one(spark, " English ", "string", language.normalized) == "en"
    assert one(spark, "Klingon", "string", language.normalized) == "klingon"


def test_page_ranges_and_names(spark):
    assert chunks.page_ranges("1-,2,-3,4") == [(1, -1), (2, 2), (1, 3), (4, 4)]
    assert jobs.safe_name("a.b-c_1") == "a.b-c_1"
    with pytest.raises(ValueError):
        jobs.safe_name("a; drop")
    assert one(spark, "x", "string", lambda c: chunks.in_ranges(F.lit(3), "")) is False
    assert one(spark, "../a b/c$d.txt", "string", T.safe_filename) == "c_d.txt"


def test_adaptive_cap(spark):
    tokens, items = quality.adaptive_cap(F.col("v"), 40_000, 200, 12, 1.0)
    got = [r.t for r in rows(spark, [(0,), (100,), (12_000,), (10**6,)], "v long").select(tokens.alias("t")).collect()]
    assert got == [40_000, 600, 1000, 2500]


def plain_soft(sizes, most, items):
    out, batch, total, n = [], 0, 0, 0
    for s in sizes:
        out.append(batch)
        total, n = total + s, n + 1
        if total > most or n > items:
            batch, total, n = batch + 1, 0, 0
    return out


def plain_hard(sizes, most):
    out, batch, total = [], 0, 0
    for i, s in enumerate(sizes):
        if i and total + s > most:
            batch, total = batch + 1, 0
        out.append(batch)
        total += s
    return out


def plain_duplicates(times, window):
    out, last = [], None
    for t in times:
        out.append(last is None or t - last > window)
        last = t if out[-1] else last
    return out


def test_folds(spark):
    r = random.Random(4)
    data = [(k, i, r.randrange(1, 40), 0) for k in range(6) for i in range(r.randrange(1, 25))]
    data = [(k, i, s, sum(x[2] for x in data if x[0] == k and x[1] <= i)) for k, i, s, _ in data]
    df = rows(spark, data, "k int, i int, s int, t int")
    soft = {(x.k, x.i): x.batch for x in folds.soft_batches(df, ["k"], ["i"], F.col("s"), 60, 3).collect()}
    hard = {(x.k, x.i): x.batch for x in folds.hard_batches(df, ["k"], ["i"], F.col("s"), 60).collect()}
    dup = {(x.k, x.t): x.accepted for x in folds.anchored_duplicates(df, ["k"], ["t"], F.col("t"), 30).collect()}
    for k in range(6):
        mine = [x for x in data if x[0] == k]
        assert [soft[k, x[1]] for x in mine] == plain_soft([x[2] for x in mine], 60, 3)
        assert [hard[k, x[1]] for x in mine] == plain_hard([x[2] for x in mine], 60)
        assert [dup[k, x[3]] for x in mine] == plain_duplicates([x[3] for x in mine], 30)


def test_masking_numbers_and_round_trip(spark):
    data = [("j", 0, "mail a@b.org or c@d.org"), ("j", 1, None), ("j", 2, "call +12025551234 é a@b.org"), ("k", 0, "nothing")]
    done = masking.masked(rows(spark, data, "j string, i int, t string"), "j", "i", "t").orderBy("j", "i").collect()
    assert done[0].masked == "mail __DLP_TOKEN_0002__ or __DLP_TOKEN_0001__"
    assert done[2].masked == "call __DLP_TOKEN_0004__ é __DLP_TOKEN_0003__"
    assert [x.original for x in done[2].rows] == ["+12025551234", "a@b.org"]
    assert (done[1].masked, done[3].masked) == (None, "nothing")


def test_masking_numbers_of_five_digits_round_trip(spark):
    data = [(job, i, " ".join(f"u{i}x{k}@b.org" for k in range(200))) for job in ("j", None) for i in range(52)]
    done = masking.masked(rows(spark, data, "j string, i int, t string"), "j", "i", "t").persist()
    found = done.select("j", "i", F.posexplode("rows").alias("pos", "r")).select("j", "i", "pos", "r.token", "r.original").persist()
    assert {x.token for x in found.filter("j = 'j'").collect()} == {f"__DLP_TOKEN_{n:04d}__" for n in range(1, 10_401)}
    back = masking.unmasked(done.select("j", "i", F.col("masked").alias("t")), found, ["j", "i"], "t", "pos")
    assert sorted(map(tuple, back.select("j", "i", "t").collect()), key=repr) == sorted(data, key=repr)


def test_masking_overlap_is_first_come(spark):
    text = "id 123-45-6789 or 212-555-1212 GB12ABCD3456"
    found = masking.masked(rows(spark, [("j", 0, text)], "j string, i int, t string"), "j", "i", "t").first()
    hits = sorted(((m.start(), m.end(), n) for n, p in masking.PATTERNS for m in re.finditer(p, text)), key=lambda h: h[0])
    kept, last = [], -1
    for h in hits:
        if h[0] >= last:
            kept.append(h[2])
            last = h[1]
    assert [x.kind for x in found.rows] == kept


def test_upserts(spark):
    old = rows(spark, [(1, "a", "x"), (2, "b", "y")], "id int, p string, q string")
    new = rows(spark, [(2, None, "z"), (3, "c", None)], "id int, p string, q string")
    assert {tuple(r) for r in upsert.merged(old, new, ["id"]).collect()} == {(1, "a", "x"), (2, None, "z"), (3, "c", None)}
    assert {tuple(r) for r in upsert.merged(old, new, ["id"], ["q"]).collect()} == {(1, "a", "x"), (2, "b", "z"), (3, "c", None)}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_term_hits_both_ways(spark, monkeypatch, limit):
    from scriptorium.operators import matching

    monkeypatch.setattr(matching, "AUTOMATON_TERMS", limit)
    texts = rows(spark, [(1, "The  Public\nlicense"), (2, None), (3, "pub"), (4, "")], "id int, t string")
    terms = rows(spark, [("public license",), ("PUB",), ("é",), ("",), ("the",)], "term string")
    assert {tuple(r) for r in term_hits(texts, terms, "id", "t", "term").collect()} == {(1, "public license"), (1, "PUB"), (3, "PUB"), (1, "the")}
