"""Language identification by prediction by partial matching.

Each language has a context tree over bytes, of variable order up to
``max_order``; escape probabilities are those of method C: at a context seen n
times with d different followers, a follower seen c times costs
-log2(c / (n + d)) bits and any other -log2(d / (n + d)) bits and its cost at
the next shorter context, down to 1/256 for each byte. The statistics are frozen
after fitting, so a text's code length under a language is an exact sum of
looked-up costs; the shortest wins. Texts are learned and scored in lower case,
so a text all in capitals is as much of its language as any other.

The fit takes a bounded sample of labelled rows of every language: at most
``sample_rows`` documents of at most ``sample_chars`` characters, chosen by a
hash of the id; where a language has too few of these, stretches of so many
characters of its longer ones. Every document is scored over its whole text.

Defined results: a null or letterless text is ``und`` with score 0; ties go to
the language that sorts first; with no labelled row everything is ``und``; a
null id counts as the empty text for the held-out rule; repeated rows get the
same prediction each; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import blocks, raw, spread, table

MAX_ORDER = 3
SAMPLE_ROWS = 150
SAMPLE_CHARS = 20_000
#: Evidence beyond so many bytes doesn't sharpen the score.
SCORE_BYTES = 64
#: Costs looked up at once: bytes of a block times languages.
BLOCK = 32_000_000
UNDETERMINED = "und"


class ContextTrees:
    """The languages' trees as one trie of contexts, with costs in bits of every (context, byte) that any language has seen.

    A pair that none has seen costs its escapes on the way to a shorter context
    that has it, so tables grow with what was seen, not with all bytes of all
    contexts.
    """

    PARTS = ("languages", "order", "symbol", "width", "parent", "child", "row", "cost", "escape")

    def __init__(self, samples: dict[str, list[bytes]], max_order: int = MAX_ORDER):
        self.languages = sorted(samples)
        self.order = max_order
        joined = np.frombuffer(b"".join(t for ts in samples.values() for t in ts), np.uint8)
        seen = np.unique(joined)
        self.symbol = np.zeros(256, np.int64)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.width = width = len(seen) + 2  # 0: a byte never seen; the last: before the start
        n_lang = len(self.languages)
        # From the latest byte to older ones; node 0 is the root.
        parents, keys = [np.array([-1])], [np.array([0])]
        reached = [np.zeros(sum(map(len, samples[x])), np.int64) for x in self.languages]
        streams = []
        for x in self.languages:
            buf = np.frombuffer(b"".join(samples[x]), np.uint8)
            starts = np.cumsum([0, *map(len, samples[x])])
            streams.append((self.symbol[buf], self._shifted(self.symbol[buf], starts)))
        bounds = [0, 1]
        counted = []
        for k in range(max_order + 1):
            counted.append([np.unique(node * width + sym, return_counts=True) for node, (sym, _) in zip(reached, streams, strict=True)])
            if k == max_order:
                break
            edges = [node * width + past[k] for node, (_, past) in zip(reached, streams, strict=True)]
            new = np.unique(np.concatenate(edges)) if edges else np.empty(0, np.int64)
            parents.append(new // width)
            keys.append(new % width)
            reached = [bounds[-1] + np.searchsorted(new, e) for e in edges]
            bounds.append(bounds[-1] + len(new))
        self.parent, key = np.concatenate(parents), np.concatenate(keys)
        n_nodes = len(self.parent)
        self.child = np.full((n_nodes + 1) * width, n_nodes, np.int32)  # the last node is nowhere
        self.child[self.parent[1:] * width + key[1:]] = np.arange(1, n_nodes)
        self.row = np.full((n_nodes + 1) * width, -1, np.int32)
        self.escape = np.zeros((n_nodes, n_lang), np.float32)
        costs = []
        for k, by_lang in enumerate(counted):
            lo, hi = bounds[k], bounds[k + 1]
            pairs = np.unique(np.concatenate([at for at, _ in by_lang])) if n_lang else np.empty(0, np.int64)
            node, symbol = pairs // width, pairs % width
            # A pair's shorter context has seen the same byte.
            shorter = np.concatenate(costs)[self.row[self.parent[node] * width + symbol]] if k else np.full((len(pairs), n_lang), 8.0)
            self.row[pairs] = sum(map(len, costs)) + np.arange(len(pairs))
            cost = np.empty((len(pairs), n_lang))
            for lang, (at, count) in enumerate(by_lang):
                counts = np.zeros(len(pairs))
                counts[np.searchsorted(pairs, at)] = count
                n, d = (np.bincount(at // width - lo, w, hi - lo) for w in (count, None))
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape = np.where(n > 0, np.log2(n + d) - np.log2(d), 0.0)
                    cost[:, lang] = np.where(counts > 0, np.log2((n + d)[node - lo]) - np.log2(counts), escape[node - lo] + shorter[:, lang])
                self.escape[lo:hi, lang] = escape
            costs.append(cost)
        self.cost = np.concatenate(costs).astype(np.float32)

    def parts(self) -> tuple:
        """Plain values that any process can read, with or without this package."""
        return tuple(getattr(self, x) for x in self.PARTS)

    @classmethod
    def of(cls, parts: tuple) -> ContextTrees:
        trees = cls.__new__(cls)
        trees.__dict__.update(zip(cls.PARTS, parts, strict=True))
        return trees

    def _shifted(self, sym: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """For k = 1..order, the symbol k bytes earlier in the same text."""
        past = []
        for k in range(1, self.order + 1):
            x = np.empty_like(sym)
            x[k:] = sym[:-k] if len(sym) > k else sym[:0]
            x[:k] = self.width - 1
            for i in range(k):
                at = starts[:-1] + i
                x[at[at < starts[1:]]] = self.width - 1
            past.append(x)
        return past

    def code_lengths(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if not len(buf) or not self.languages:
            return out
        sym = self.symbol[buf]
        nowhere, width = len(self.parent), self.width
        best = node = np.zeros(len(buf), np.int64)
        for past in self._shifted(sym, offsets):
            node = self.child[node * width + past]
            best = np.where(node != nowhere, node, best)
            node = node.astype(np.int64)
        at = self.row[best * width + sym]
        bits = self.cost[at] if len(self.cost) else np.zeros((len(buf), len(self.languages)), np.float32)
        left = np.flatnonzero(at < 0)  # not seen in this context: on to shorter ones
        bits[left] = 0
        here = best[left]
        while len(left):
            bits[left] += self.escape[here]
            root = here == 0
            bits[left[root]] += 8.0
            left, here = left[~root], self.parent[here[~root]]
            at = self.row[here * width + sym[left]]
            found = at >= 0
            bits[left[found]] += self.cost[at[found]]
            left, here = left[~found], here[~found]
        full = np.flatnonzero(np.diff(offsets))
        out[full] = np.add.reduceat(bits, offsets[full], axis=0, dtype=np.float64)
        return out

    def score(self, lengths: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
        """Share of the best language when the texts' evidence counts as SCORE_BYTES bytes at most."""
        over = (lengths - lengths.min(1, keepdims=True)) * (SCORE_BYTES / np.maximum(n_bytes, SCORE_BYTES))[:, None]
        return 1 / np.exp2(-over).sum(1)


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_order: int = MAX_ORDER, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> ContextTrees:
    """Trees of each language from a bounded sample of labelled rows that aren't held out."""
    rows = docs.select(docs[id_col].alias("id"), F.lower(docs[text_col].cast("string")).alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.filter(~held_out(F.col("id")) & F.col("lang").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return ContextTrees({}, max_order)
    rows = rows.filter(F.length("text") > 0).withColumn("long", F.length("text") > sample_chars)
    samples = _drawn(rows.filter("not long"), counts, sample_rows, sample_chars)
    few = [x for x, n in counts.items() if len(samples.get(x, [])) < min(n, sample_rows)]
    if few:  # whose rows are long, or are empty
        rows = rows.filter(F.col("lang").isin(few))
        sizes = {(r.lang, r.long): r.n for r in rows.groupBy("lang", "long").agg(F.count("*").alias("n")).collect()}
        for long in (False, True):
            part = {x: n for (x, kind), n in sizes.items() if kind == long and not (long and sizes.get((x, False), 0) >= sample_rows)}
            found = _drawn(rows.filter(F.col("long") == long), part, sample_rows, sample_chars) if part else {}
            for x, texts in found.items():
                samples[x] = [*samples.get(x, []), *texts][:sample_rows] if long else texts
    return ContextTrees(samples, max_order)


def _drawn(rows: DataFrame, counts: dict[str, int], sample_rows: int, sample_chars: int) -> dict[str, list[bytes]]:
    """About ``sample_rows`` texts, or stretches of them, of each of the counted languages, by a hash of the id."""
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    draw = (F.xxhash64(key, F.lit("ppm")).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * sample_rows / n))])
    some = rows.withColumn("draw", draw).filter(F.col("draw") < F.coalesce(rate[F.col("lang")], F.lit(0.0)))
    start = F.pmod(F.xxhash64(key, F.lit("stretch")), F.greatest(F.length("text") - sample_chars, F.lit(0)) + 1)
    stretch = F.substr("text", (start + 1).cast("int"), F.lit(sample_chars))
    drawn = sorted((r.draw, r.text, r.lang) for r in some.select("draw", stretch.alias("text"), "lang").collect())
    samples: dict[str, list[bytes]] = {}
    for _, text, lang in drawn:
        if len(samples.setdefault(lang, [])) < sample_rows:
            samples[lang].append(text.encode("utf-8", "surrogatepass"))
    return samples


ADDED = ("lang_pred", "lang_score", "bits_per_byte")


def identify(docs: DataFrame, trees: ContextTrees, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all, if None) with lang_pred, lang_score and bits_per_byte (null where ``und``).

    Columns of these three names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees.parts())
    columns = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    letter = F.coalesce(docs[text_col].cast("string").rlike(r"\p{L}"), F.lit(False))
    inner = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(columns)], F.lower(docs[text_col].cast("string")).alias("text"), letter.alias("letter"))
    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))

    def run(batches):
        trees = ContextTrees.of(shared.value)
        names = np.array([*trees.languages, UNDETERMINED], object)
        for batch in batches:
            buf, offsets = raw(batch.column(len(columns)))
            bits = np.concatenate([trees.code_lengths(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in blocks(offsets, BLOCK // max(len(trees.languages), 64))] or [np.zeros((0, len(trees.languages)))])
            sizes = np.diff(offsets)
            known = np.array(batch.column(len(columns) + 1).to_pylist(), bool) & (len(trees.languages) > 0) & (sizes > 0)
            best = np.where(known, bits.argmin(1) if trees.languages else 0, len(trees.languages))
            score = np.where(known, trees.score(bits, sizes) if trees.languages else 0.0, 0.0)
            rate = pa.array(bits.min(1) / np.maximum(sizes, 1) if trees.languages else np.zeros(len(sizes)), mask=~known)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(names[best], pa.string()), pa.array(score), rate], [*(f"c{i}" for i in range(len(columns))), "lang_pred", "lang_score", "bits_per_byte"])

    out = inner.mapInArrow(run, f"{kinds}, lang_pred string, lang_score double, bits_per_byte double")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "lang_pred", "lang_score", "bits_per_byte")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = identify(spread(docs.select("doc_id", "text")), fit(docs), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {"op10_language_id": op10_language_id}
ORACLE_SQL: dict[str, str] = {}
