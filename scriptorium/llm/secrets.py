"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Base findings come from three patterns per text. Their values are candidates,
and beside them every long run of credential characters that looks live, with
letters, digits and enough different characters. Candidate values are hashed and
counted over the corpus by distinct repositories and distinct owners. A value is
a copied example (kind ``copied``) if ``COPIED_OWNERS`` owners hold it, or if
two do and it stands in ``COPIED_REPOS`` repositories; any other one is a
credential of its owner (kind ``owned``): what one owner alone holds never
counts as an example, in however many repositories. Both kinds are added to the
base spans, at the value itself and with both counts; nothing is taken away.

Defined results: null and empty text have no spans; a null owner or repository
counts as one unknown value; repeated rows each get their spans and count once
in the distinct counts; overlapping spans of different kinds all stay, in order
of start and then kind; spans are in code points, end exclusive; only the named
columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, spread, spread_join, table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so asking for their length at once finds what dropping short runs leaves.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned", "copied")
#: A value of so many owners is a copied example, and so is one of two owners in so many repositories.
COPIED_OWNERS, COPIED_REPOS = 3, 20
#: Matches whose spans are put together at a time, so a text of very many matches isn't copied for each.
STEP = 64
#: A live-looking value has so many different characters.
DIFFERENT_CHARS = 8

SPAN = "struct<start:bigint,rank:int,end:bigint,value:string>"
COUNTED = SPAN[:-1] + ",n_repos:bigint,n_owners:bigint>"


def _matches(text: Column, pattern: str, rank: int, group: int = 0) -> Column:
    """Array of SPAN: every leftmost non-overlapping match; value is the group's text."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    # What stands between matches, and the matches, give the starts.
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), values.alias("value"))
    state_of = lambda at, spans, kind: F.struct(at.cast("long").alias("at"), spans.cast(kind).alias("spans"))

    def one(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["whole"])
        span = F.struct(start.cast("long").alias("start"), F.lit(rank).alias("rank"), end.cast("long").alias("end"), part["value"].alias("value"))
        return state_of(end, F.concat(state["spans"], F.array(span)), f"array<{SPAN}>")

    def all_of(parts: Column) -> Column:
        def some(state: Column, i: Column) -> Column:
            found = F.aggregate(F.slice(parts, i * STEP + 1, F.lit(STEP)), state_of(state["at"], F.array(), f"array<{SPAN}>"), one)
            return F.transform(F.array(found), lambda x: state_of(x["at"], F.concat(state["spans"], F.array(x["spans"])), f"array<array<{SPAN}>>"))[0]

        steps = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / STEP).cast("int"))
        return F.aggregate(steps, state_of(F.lit(0), F.array(), f"array<array<{SPAN}>>"), some, lambda state: F.flatten(state["spans"]))

    spans = F.transform(F.array(parts), all_of)[0]  # so the parts are found once
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """Findings of the three patterns."""
    text = F.coalesce(text, F.lit(""))
    assign = F.filter(_matches(text, ASSIGN, 0, 1), lambda s: F.length(s["value"]) >= 6)
    return F.concat(assign, _matches(text, ACCESS, 1), _matches(text, HEX, 2))


def _live(value: Column) -> Column:
    different = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (different >= DIFFERENT_CHARS)


def candidate_spans(text: Column, base: Column) -> Column:
    """The values of base findings, and runs of credential characters that look live; each place once."""
    text = F.coalesce(text, F.lit(""))
    # A finding ends with its value.
    values = F.transform(base, lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), F.lit(3).alias("rank"), s["end"].alias("end"), s["value"].alias("value")))
    return F.array_union(values, F.filter(_matches(text, RUN, 3), lambda s: _live(s["value"])))


def ownership(candidates: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each value hash (columns hash, repo, owner), and ``n``, its places."""
    return candidates.groupBy("hash").agg(F.count("*").alias("n"), F.countDistinct(F.coalesce("repo", F.lit(""))).alias("n_repos"), F.countDistinct(F.coalesce("owner", F.lit(""))).alias("n_owners"))


def scan(docs: DataFrame, text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", keep: tuple[str, ...] = ("doc_id",), copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """The ``keep`` columns and ``spans``: array of (start, rank, end, value, n_repos, n_owners), sorted, rank counting KINDS; base spans have no counts."""
    found = cut(
        docs.select(
            F.struct(*[F.col(c) for c in keep]).alias("keep"),
            docs[repo_col].cast("string").alias("repo"),
            docs[owner_col].cast("string").alias("owner"),
            docs[text_col].cast("string").alias("text"),
            base_spans(docs[text_col].cast("string")).alias("base"),
        ).select("keep", "repo", "owner", "base", candidate_spans(F.col("text"), F.col("base")).alias("cands"))
    ).withColumn("rid", F.monotonically_increasing_id())
    each = found.filter(F.size("cands") > 0).select("rid", "repo", "owner", F.explode("cands").alias("span")).withColumn("hash", F.sha2("span.value", 256))
    uncounted = lambda s: F.struct(*[s[x].alias(x) for x in ("start", "rank", "end", "value")], *[F.lit(None).cast("long").alias(x) for x in ("n_repos", "n_owners")])
    copied = (F.col("n_owners") >= copied_owners) | ((F.col("n_owners") >= 2) & (F.col("n_repos") >= copied_repos))
    rank = F.when(copied, 4).otherwise(3)
    added = (
        spread_join(each, cut(ownership(each)), "hash")
        .groupBy("rid")
        .agg(F.collect_list(F.struct(F.col("span.start").alias("start"), rank.alias("rank"), F.col("span.end").alias("end"), F.col("span.value").alias("value"), "n_repos", "n_owners")).alias("added"))
    )
    none = F.array().cast(f"array<{COUNTED}>")
    return found.join(added, "rid", "left").select("keep.*", F.sort_array(F.concat(F.transform("base", uncounted), F.coalesce("added", none))).alias("spans"))


def rendered(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every maximal stretch under sorted spans replaced by a mark."""
    # Gaps between the spans: from the end of all spans before to the start of the next one that lies beyond.
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<lo:bigint,hi:bigint>>").alias("gaps"))
    state_of = lambda at, gaps: F.struct(at.cast("long").alias("at"), gaps.alias("gaps"))

    def one(state: Column, s: Column) -> Column:
        first = (s["start"] > state["at"]) | ((state["at"] == 0) & (F.size(state["gaps"]) == 0))
        gap = F.array(F.struct(state["at"].alias("lo"), s["start"].alias("hi")))
        return state_of(F.greatest(state["at"], s["end"]), F.when(first, F.concat(state["gaps"], gap)).otherwise(state["gaps"]))

    gaps = F.aggregate(spans, empty, one)
    pieces = lambda g: F.concat(F.transform(g["gaps"], lambda x: F.substr(text, (x["lo"] + 1).cast("int"), (x["hi"] - x["lo"]).cast("int"))), F.array(F.substr(text, (g["at"] + 1).cast("int"))))
    done = F.transform(F.array(gaps), lambda g: F.array_join(pieces(g), mark))[0]
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda *ranks: F.size(F.filter("spans", lambda s: s["rank"].isin(*ranks))).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(rendered(base), 256).alias("base_sha256"),
        rendered(F.col("spans")).alias("spans"),
        count(3).alias("n_owned"),
        count(4).alias("n_copied"),
        F.transform(F.filter("spans", lambda s: s["rank"] >= 3), lambda s: F.struct(s["n_repos"].alias("n_repos"), s["n_owners"].alias("n_owners"))).alias("counts"),
    )


QUERIES = {"op3_secret_scans": op3_secret_scans}
ORACLE_SQL: dict[str, str] = {}
