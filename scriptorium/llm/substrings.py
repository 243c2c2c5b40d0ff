"""Exact removal of repeated word sequences through difference-cover anchors.

A sequence of 20 words that stands at two places covers 13 consecutive word
positions at which an 8-word anchor fits. The difference cover {0, 1, 3, 9}
modulo 13 has, for any two places, an offset below 13 at which both positions
are cover positions; so it's enough to hash anchors at cover positions. Anchors
are exchanged with their hashes shortened to 40 bits beside the bucket number:
a chance match costs a little work only. Matched anchors then extend: every
window of 20 words that holds one is compared by 96-bit hash with all others of
its bucket, in the order of (doc_id, start); windows that aren't the first are
removed. Repeats inside a batch are settled there and sent once, so a sequence
in a third of all documents takes one entry of each batch.

Defined results: null and empty texts have no words; a null id comes after all
others; documents of one id with different texts are ordered by a hash of the
text; rows of equal id and text are one document, with the same result on each;
only the named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import binary_of, blocks, cut, pack, raw, spread, table, unpack
from scriptorium.llm.exchange import ROWS, changes, gather, keyed, narrow, split
from scriptorium.llm.words import SEEDS, window_hashes, word_hashes

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1

_COVERED = np.isin(np.arange(PERIOD), COVER)
#: Kinds of exchanged rows.
ASK, FLAG, LATER = 0, 1, 2


def _rows(found: list[tuple[int, int, int, bytes]]) -> pa.Table:
    bucket, kind, source, body = zip(*found, strict=True) if found else ((), (), (), ())
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "kind": pa.array(kind, pa.int32()), "source": pa.array(source, pa.int32()), "body": binary_of(list(body))})


def anchors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and word position of every anchor at a cover position."""
    words, before = word_hashes(buf, offsets)
    count = np.diff(before)
    count[count < WINDOW] = 0
    fit = np.maximum(count - ANCHOR + 1, 0)
    text = np.repeat(np.arange(len(fit)), fit)
    pos = np.arange(len(text)) - np.repeat(np.cumsum(fit) - fit, fit)
    good = _COVERED[pos % PERIOD]
    text, pos = text[good], pos[good]
    return window_hashes(words, ANCHOR, SEEDS[1])[before[text] + pos], text, pos


def _ask(buckets: int):
    def run(batches):
        for batch in batches:
            key, mark, part = (batch.column(i).to_numpy() for i in range(3))
            buf, offsets = raw(batch.column(3))
            hashes, texts, places = [], [], []
            for i, j in blocks(offsets, 500_000):
                h, t, p = anchors(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hashes.append(h), texts.append(t + i), places.append(narrow(p))
            if not hashes:
                continue
            h, t, p = np.concatenate(hashes), np.concatenate(texts), narrow(np.concatenate(places))
            order = np.argsort(h)
            sorted_h = h[order]
            new = changes(sorted_h)
            alone = new & np.append(new[1:], True)
            once = np.zeros(len(h), bool)
            once[order[alone]] = True
            out = []
            # Repeated in this batch: flagged at once, and sent as a witness for others.
            for to, blob in split(part[t[~once]], t[~once], [p[~once]], [key, mark]):
                out.append((to % buckets, FLAG, to, blob))
            witnesses = sorted_h[new & ~alone]
            h, t, p = h[once], t[once], p[once]
            bucket = (h >> np.uint64(40)) % np.uint64(buckets)
            asked = dict(split(bucket, t, [h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint8), p], [key, mark, part]))
            bucket = (witnesses >> np.uint64(40)) % np.uint64(buckets)
            seen = dict(split(bucket, np.zeros(len(bucket), np.int64), [witnesses & np.uint64((1 << 40) - 1)], [np.zeros(1, np.uint8)]))
            nothing = pack(np.empty(0, np.uint64))
            for b in asked.keys() | seen.keys():
                body = asked.get(b, b"")
                out.append((b, ASK, len(body), body + seen.get(b, nothing)))
            yield from _rows(out).to_batches()

    return run


def _answer(rows: pa.Table) -> pa.Table:
    """Flags of the anchors that others share, by part."""
    kind, source = rows.column("kind").to_pylist(), rows.column("source").to_pylist()
    body = [b.as_buffer() for b in rows.column("body")]
    out = [(s, FLAG, 0, b.to_pybytes()) for k, s, b in zip(kind, source, body, strict=True) if k == FLAG]
    asked = [b.slice(0, s) for k, s, b in zip(kind, source, body, strict=True) if k == ASK and s]
    seen = [unpack(b.slice(s))[0] for k, s, b in zip(kind, source, body, strict=True) if k == ASK]
    (low, high, pos), (key, mark, part), owner, _ = gather(asked, 3, 3)
    h = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
    every = np.concatenate([h, *seen]) if seen else h
    order = np.argsort(every)
    new = changes(every[order])
    shared = np.zeros(len(every), bool)
    shared[order] = ~(new & np.append(new[1:], True))
    hit = np.flatnonzero(shared[: len(h)])
    out += [(to, FLAG, 0, blob) for to, blob in split(part[owner[hit]], owner[hit], [pos[hit]], [key, mark])]
    return _rows(out)


class _Part:
    """The documents of a part, each once, in order of (key, mark), and their candidate windows."""

    def __init__(self, docs: pa.Table, flags: pa.Table):
        key, mark = docs.column("key").to_numpy(), docs.column("mark").to_numpy()
        order = np.lexsort((mark, key))
        order = order[changes(key[order], mark[order])]
        self.key, self.mark = key[order], mark[order]
        place = {x: i for i, x in enumerate(zip(self.key.tolist(), self.mark.tolist(), strict=True))}
        (pos,), (k, m), owner, _ = gather([b for kind, b in zip(flags.column("kind").to_pylist(), flags.column("body").to_pylist(), strict=True) if kind == FLAG], 1, 2)
        doc = np.array([place.get(x, -1) for x in zip(k.tolist(), m.tolist(), strict=True)], np.int64)[owner] if len(owner) else owner
        pos, doc = pos[doc >= 0].astype(np.int64), doc[doc >= 0]
        with_flags = np.unique(doc)
        rank = np.full(len(self.key), -1)
        rank[with_flags] = np.arange(len(with_flags))
        texts = docs.column("text").combine_chunks() if isinstance(docs.column("text"), pa.ChunkedArray) else docs.column("text")
        buf, offsets = raw(texts.take(pa.array(order[with_flags])))
        starts, owners, first, second = [], [], [], []
        for i, j in blocks(offsets, 500_000):
            some, bounds = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            words, before = word_hashes(some, bounds)
            here = (rank[doc] >= i) & (rank[doc] < j)
            flagged = np.zeros(len(words) + 1, np.int32)
            flagged[before[rank[doc[here]] - i] + pos[here]] = 1
            total = np.concatenate(([0], np.cumsum(flagged)))
            s = np.arange(max(len(words) - WINDOW + 1, 0))
            text = np.searchsorted(before, s, "right") - 1
            s = s[(s + WINDOW <= before[text + 1]) & (total[s + PERIOD] > total[s])]
            text = np.searchsorted(before, s, "right") - 1
            starts.append(s - before[text])
            owners.append(with_flags[text + i])
            first.append(window_hashes(words, WINDOW)[s])
            second.append(window_hashes(word_hashes(some, bounds, SEEDS[1])[0], WINDOW, SEEDS[1])[s].astype(np.uint32))
        cat = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
        self.start, self.owner, self.h1, self.h2 = cat(starts, np.int64), cat(owners, np.int64), cat(first, np.uint64), cat(second, np.uint32)
        order = np.lexsort((self.h2, self.h1))
        new = np.zeros(len(order), bool)
        new[order] = changes(self.h1[order], self.h2[order])
        #: Windows that come first among the part's own, in order of (key, mark, start).
        self.firsts = np.flatnonzero(new)


def _dealt(p: _Part, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The part's first windows in order of bucket, and each one's bucket; inside a bucket the order stays."""
    bucket = ((p.h1[p.firsts] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return p.firsts[order], bucket[order]


def _offer(buckets: int):
    def run(_key: tuple, docs: pa.Table, flags: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows([])
        p, source = _Part(docs, flags), docs.column("part")[0].as_py()
        at, bucket = _dealt(p, buckets)
        return _rows([(b, LATER, source, blob) for b, blob in split(bucket, p.owner[at], [p.h1[at], p.h2[at]], [p.key, p.mark])])

    return run


def _later(bucket: tuple, rows: pa.Table) -> pa.Table:
    """For each part, the places in its value of those windows that start earlier elsewhere."""
    (h1, h2), (key, mark), owner, blob = gather(rows.column("body").to_pylist(), 2, 2)
    size = np.bincount(blob, minlength=rows.num_rows) if len(blob) else np.zeros(rows.num_rows, np.int64)
    place = np.arange(len(h1)) - np.repeat(np.cumsum(size) - size, size)
    order = np.lexsort((place, mark[owner], key[owner], h2, h1))
    later = np.sort(order[~changes(h1[order], h2[order])])
    source = np.array(rows.column("source").to_pylist(), np.int64)
    return _rows([(to, LATER, bucket[0].as_py(), b) for to, b in split(source[blob[later]], np.zeros(len(later), np.int64), [narrow(place[later])], [np.zeros(1, np.uint8)])])


def _finish(digests: bool, buckets: int):
    def run(_key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        p = _Part(docs, answers)
        gone = np.ones(len(p.start), bool)
        gone[p.firsts] = False
        dealt, bucket = _dealt(p, buckets)
        starts = np.searchsorted(bucket, np.arange(buckets))
        for kind, source, b in zip(*(answers.column(c).to_pylist() for c in ("kind", "source", "body")), strict=True):
            if kind == LATER:
                gone[dealt[starts[source] + unpack(b)[0].astype(np.int64)]] = True
        at = np.flatnonzero(gone)
        cover: dict[tuple[int, int], np.ndarray] = {}
        cuts = np.flatnonzero(changes(p.owner[at])).tolist()
        for i, j in zip(cuts, [*cuts[1:], len(at)] if cuts else [], strict=True):
            d = p.owner[at[i]]
            cover[int(p.key[d]), int(p.mark[d])] = p.start[at[i:j]]
        n_words, n_removed, kept = [], [], []
        for key, mark, text in zip(docs.column("key").to_pylist(), docs.column("mark").to_pylist(), docs.column("text"), strict=True):
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
            n_words.append(len(words))
            starts = cover.get((key, mark))
            if starts is not None:
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, starts, 1)
                np.add.at(steps, starts + WINDOW, -1)
                keep = np.cumsum(steps[:-1]) == 0
                words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            n_removed.append(n_words[-1] - len(words))
            joined = b" ".join(words)
            kept.append(hashlib.sha256(joined).hexdigest() if digests else joined.decode("utf-8", "replace"))
        return pa.table({"doc_id": docs.column("id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the kept words joined by a space (``digests``: their SHA-256)."""
    docs, parts = keyed(docs, id_col, text_col)
    # Buckets of hashes are larger than parts, so that names of documents take little of their values.
    buckets = max(12, parts // 4)
    asked = docs.select("key", "mark", "part", "text").mapInArrow(_ask(buckets), ROWS)
    flags = cut(asked.groupBy("bucket").applyInArrow(_answer, ROWS))
    groups = docs.groupBy("part")
    offered = groups.cogroup(flags.groupBy("bucket")).applyInArrow(_offer(buckets), ROWS)
    later = offered.groupBy("bucket").applyInArrow(_later, ROWS)
    done = groups.cogroup(flags.union(later).groupBy("bucket")).applyInArrow(_finish(digests, buckets), "doc_id long, n_words long, n_removed long, kept string")
    return done.select(F.col("doc_id").alias(id_col), "n_words", "n_removed", "kept")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), digests=True).withColumnRenamed("kept", "kept_sha256")


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
