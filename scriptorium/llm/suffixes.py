"""Exact removal of repeated byte strings by column-wise construction over a collection.

The collection is cut into fragments that can be ordered apart from each other.
Each window of ``PASSAGE`` bytes has an anchor: the leftmost place of the least
hash of ``GRAM`` bytes inside it. Windows of a text that share an anchor form a
fragment, from the first one's first byte to what a string of ``LENGTH`` bytes
takes that starts with the last one. Equal strings start with equal windows, and
these have equal anchors at equal offsets, so they meet in the fragments of one
anchor hash, aligned at the anchor; fragments of other hashes can't hold them.
Equal fragments are counted first, by a cryptographic hash; one of each class
goes on, and only where an anchor hash has several classes.

A bucket's fragments are then a collection of aligned documents, which is built
column by column from the right (the way of BCR and its extension to common
prefixes): each round reads one symbol of every document, in the order of the
round before (that stretch of symbols is the collection's Burrows-Wheeler
transform), puts the suffixes into their new order by one stable sort, and
updates the common prefixes of neighbours. A string repeats where a neighbour's
common prefix reaches its length, and one construction tells this for both
lengths: strings of ``LENGTH`` bytes are removed, and what strings of
``PASSAGE`` bytes cover, as a passage of fifty words does, is counted only.
The columns come and go as sequential shuffle files; a bucket has a fixed number
of bytes, so its state stays in memory.

An anchor hash of more than ``HOT`` classes, as at the edge of a passage that
very many texts share, would bring them all to one bucket. Its fragments are cut
further, down to single strings, which are dealt out by a 96-bit hash of all of
their bytes and are equal where they meet.

Defined results: null and empty texts have no bytes; documents shorter than
``LENGTH`` bytes lose nothing; a repeated row is one more copy, so its strings
stand elsewhere too; null ids are told apart by their text; only the named
columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import binary_of, blocks, cut, raw, spread, table, unpack
from scriptorium.llm.exchange import ROWS, changes, gather, keyed, split
from scriptorium.llm.words import SEEDS, mixed, window_hashes

#: Bytes of strings that are removed, and of those that are counted.
LENGTH, PASSAGE = 400, 240
GRAM = 32
#: Windows whose anchors are found at a time; positions take the low bits of a hash.
STRETCH, PLACE_BITS = 1 << 22, 24

#: Classes of one anchor hash up to which they are ordered in one bucket.
HOT = 2048
#: Hot fragments whose strings are hashed at a time.
HOT_STEP = 512

ASK, COVERED, WINDOWS, SHIP = 0, 1, 2, 3
#: Marks of a shipped fragment: it repeats as a whole; its anchor hash is hot.
FULL, IS_HOT = 1, 2


def anchored(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """First and last window, anchor and anchor hash of every fragment; places in buf."""
    if len(buf) > STRETCH + PASSAGE:  # one long text: windows of one stretch at a time
        parts = []
        for i in range(0, len(buf) - PASSAGE + 1, STRETCH):
            some = buf[i : i + STRETCH + PASSAGE - 1]
            lo, hi, at, h = anchored(some, np.array([0, len(some)]))
            parts.append([lo + i, hi + i, at + i, h])
        return [np.concatenate(x) for x in zip(*parts, strict=True)]
    n = len(buf)
    sizes = np.diff(offsets)
    if n < PASSAGE or not (sizes >= PASSAGE).any():
        return [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)]
    # What hashes alike only shares a bucket, so any hash will do here.
    grams = window_hashes(buf.astype(np.uint64), GRAM)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span, width = 1, PASSAGE - GRAM + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: span - width], least[width - span :])
    anchor = (least & low).astype(np.int64)
    steps = np.zeros(n + 1, np.int8)
    long = sizes >= PASSAGE
    steps[offsets[:-1][long]] += 1
    steps[offsets[1:][long] - PASSAGE + 1] -= 1
    fit = np.cumsum(steps, dtype=np.int8)[: len(anchor)] > 0
    new, last = fit.copy(), fit.copy()
    same = fit[1:] & fit[:-1] & (anchor[1:] == anchor[:-1])
    new[1:] &= ~same
    last[:-1] &= ~same
    lo, hi = np.flatnonzero(new), np.flatnonzero(last)
    return [lo, hi, anchor[lo], grams[anchor[lo]]]


def fragments(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Text, first window, anchor's distance, windows less one, size, anchor hash and two halves of the hash of every fragment."""
    lo, hi, at, h = anchored(buf, offsets)
    text = np.searchsorted(offsets, lo, "right") - 1
    end = np.minimum(hi + LENGTH, offsets[text + 1])
    data = memoryview(np.ascontiguousarray(buf))
    whole = np.frombuffer(b"".join([hashlib.blake2b(data[i:j], digest_size=16).digest() for i, j in zip(lo.tolist(), end.tolist(), strict=True)]), np.uint64).reshape(-1, 2)
    return [text, lo - offsets[text], at - lo, hi - lo, end - lo, h, whole[:, 0], whole[:, 1]]


def whole_cover(lo: np.ndarray, more: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """What strings of a fragment cover that repeats as a whole: begin, end, and whether strings of LENGTH bytes do."""
    long = size >= LENGTH
    end = lo.astype(np.int64) + np.where(long, size, more.astype(np.int64) + PASSAGE)
    return [lo.astype(np.uint32), end.astype(np.uint32), long.astype(np.uint8)]


class Columns:
    """Aligned documents, ordered column by column from the right.

    ``group``: documents of different groups never compare. ``left``, ``right``:
    the columns of each document's first byte and behind its last one. With
    ``keep``, each round's stretch of the transform stays in ``transform``: the
    documents in order of their suffixes behind the column, and their symbols.
    """

    def __init__(self, group: np.ndarray, left: np.ndarray, right: np.ndarray, data: np.ndarray, starts: np.ndarray, keep: bool = False):
        self.transform: dict[int, tuple[np.ndarray, np.ndarray]] | None = {} if keep else None
        self.group = np.unique(group, return_inverse=True)[1].astype(np.int64)
        self.left, self.right, self.data, self.base = left, right, data, starts - left
        self.order = np.empty(0, np.int64)
        self.common = np.empty(0, np.int32)

    def _enter(self, new: np.ndarray) -> None:
        """Empty suffixes come before all others of their group, with nothing in common."""
        both = np.concatenate((new, self.order))
        common = np.concatenate((np.zeros(len(new), np.int32), self.common))
        at = np.argsort(self.group[both], kind="stable")
        self.order, self.common = both[at], common[at]
        self.common[1:][at[:-1] < len(new)] = 0

    def _leave(self, gone: np.ndarray) -> None:
        kept = np.flatnonzero(~gone)
        if len(kept):
            firsts = np.concatenate(([0], kept[:-1] + 1))
            self.common = np.minimum.reduceat(self.common[: kept[-1] + 1], firsts)
        else:
            self.common = self.common[:0]
        self.order = self.order[kept]

    def _insert(self, column: int) -> None:
        """Put each document's symbol of this column before its suffix."""
        symbols = self.data[self.base[self.order] + column]
        if self.transform is not None:
            self.transform[column] = (self.order, symbols)
        key = self.group[self.order] * 256 + symbols
        n = len(key)
        if n < 2:
            self.common[:] = 0
            return
        if (key[1:] >= key[:-1]).all():
            self.common[1:] = np.where(key[1:] == key[:-1], self.common[1:] + 1, 0)
            self.common[0] = 0
            return
        at = np.argsort(key, kind="stable")
        key = key[at]
        common = np.zeros(n, np.int32)
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        before, here = at[same - 1], at[same]
        value = self.common[here]
        apart = np.flatnonzero(here != before + 1)
        if len(apart):
            ends = np.empty(2 * len(apart), np.int64)
            ends[::2], ends[1::2] = before[apart] + 1, here[apart] + 1
            value[apart] = np.minimum.reduceat(np.append(self.common, 0), ends)[::2]
        common[same] = value + 1
        self.order, self.common = self.order[at], common

    def repeats(self, lengths: tuple[int, ...], last_start: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length, the first and last column of each document, up to ``last_start``, at which a string of so many bytes repeats; first > last if none."""
        n = len(self.left)
        found = [(np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)) for _ in lengths]
        if not n:
            return found
        last_start = self.right if last_start is None else last_start
        enter = np.argsort(-self.right, kind="stable")
        leave = np.argsort(-self.left, kind="stable")
        e = x = 0
        ends, lefts = self.right[enter], self.left[leave]
        for column in range(int(self.right.max()) - 1, int(self.left.min()) - 1, -1):
            i = e
            while e < n and ends[e] == column + 1:
                e += 1
            if e > i:
                self._enter(enter[i:e])
            if not len(self.order):
                continue
            self._insert(column)
            for length, (first, last) in zip(lengths, found, strict=True):
                hit = self.common >= length
                if hit.any():
                    hit[:-1] |= hit[1:]
                    docs = self.order[hit]
                    docs = docs[column <= last_start[docs]]
                    first[docs] = column
                    last[docs] = np.maximum(last[docs], column)
            i = x
            while x < n and lefts[x] == column:
                x += 1
            if x > i:
                self._leave(self.left[self.order] == column)
        return found


def _rows(found: list[tuple[int, int, bytes]]) -> pa.Table:
    bucket, kind, body = zip(*found, strict=True) if found else ((), (), ())
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "kind": pa.array(kind, pa.int32()), "source": pa.array([0] * len(kind), pa.int32()), "body": binary_of(list(body))})


def _ask(parts: int):
    def run(batches):
        for batch in batches:
            key, mark, part = (batch.column(i).to_numpy() for i in range(3))
            buf, offsets = raw(batch.column(3))
            found = []
            for i, j in blocks(offsets, 500_000):
                some = fragments(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                some[0] = some[0] + i
                found.append(some)
            if not found:
                continue
            text, lo, da, more, size, h, f1, f2 = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((f2, f1, h))
            new = changes(h[order], f1[order], f2[order])
            times = np.diff(np.append(np.flatnonzero(new), len(order)))
            many = np.zeros(len(order), bool)
            many[order] = np.repeat(times > 1, times)
            head = np.zeros(len(order), bool)
            head[order] = new
            out = []
            # Repeated in this batch: settled for all; the first of each class asks on for the others.
            for to, blob in split(part[text[many]], text[many], whole_cover(lo[many], more[many], size[many]), [key, mark]):
                out.append((to, COVERED, blob))
            columns = [h, f1, f2.astype(np.uint32), lo.astype(np.uint32), da.astype(np.uint8), more.astype(np.uint8), size.astype(np.uint16), many.astype(np.uint8)]
            for b, blob in split((h[head] >> np.uint64(20)) % np.uint64(parts), text[head], [c[head] for c in columns], [key, mark, part]):
                out.append((b, ASK, blob))
            yield from _rows(out).to_batches()

    return run


def _classes(_key: tuple, rows: pa.Table) -> pa.Table:
    """Classes of equal fragments: what is covered, and one of each class that has to be compared."""
    kind, body = rows.column("kind").to_pylist(), rows.column("body").to_pylist()
    out = [(_key[0].as_py(), COVERED, b) for k, b in zip(kind, body, strict=True) if k == COVERED]
    (h, f1, f2, lo, da, more, size, many), (key, mark, part), owner, _ = gather([b for k, b in zip(kind, body, strict=True) if k == ASK], 8, 3)
    if len(h):
        order = np.lexsort((f2, f1, h))
        new, group = changes(h[order], f1[order], f2[order]), changes(h[order])
        at = np.flatnonzero(new)
        total = np.add.reduceat(many[order].astype(np.int64) + 1, at)
        full = np.zeros(len(h), bool)
        full[order] = np.repeat(total > 1, np.diff(np.append(at, len(h))))
        kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(group))
        kinds = np.repeat(kinds, np.diff(np.append(np.flatnonzero(group), len(h))))
        marks = full.astype(np.uint8)
        marks[order[kinds > HOT]] |= IS_HOT
        hit = np.flatnonzero(full & (many == 0))
        out += [(to, COVERED, b) for to, b in split(part[owner[hit]], owner[hit], whole_cover(lo[hit], more[hit], size[hit]), [key, mark])]
        ship = np.sort(order[new & (kinds > 1)])
        out += [(to, SHIP, b) for to, b in split(part[owner[ship]], owner[ship], [h[ship], lo[ship], da[ship], more[ship], size[ship], marks[ship]], [key, mark])]
    return _rows(out)


def _strings(buf: np.ndarray, starts: np.ndarray, more: np.ndarray, size: np.ndarray, length: int) -> list[np.ndarray]:
    """Fragment, offset and two hashes of every string of ``length`` bytes that starts in a window of some fragments."""
    data = np.concatenate([buf[s : s + z] for s, z in zip(starts.tolist(), size.tolist(), strict=True)]).astype(np.uint64)
    begin = np.cumsum(size) - size
    n = np.maximum(np.minimum(more + 1, size - length + 1), 0)
    which = np.repeat(np.arange(len(starts)), n)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[which] + offset
    return [which, offset, *(window_hashes(data, length, seed)[at] if len(at) else np.empty(0, np.uint64) for seed in SEEDS)]


def _ship(parts: int):
    def run(_key: tuple, docs: pa.Table, flags: pa.Table) -> pa.Table:
        key, mark = docs.column("key").to_numpy(), docs.column("mark").to_numpy()
        place = {x: i for i, x in enumerate(zip(key.tolist(), mark.tolist(), strict=True))}
        (h, lo, da, more, size, marks), (k, m), owner, _ = gather(flags.column("body").to_pylist(), 6, 2)
        if not len(h) or not place:
            return _rows([])
        part = docs.column("part")[0].as_py()
        row = np.array([place[x] for x in zip(k.tolist(), m.tolist(), strict=True)], np.int64)[owner]
        buf, offsets = raw(docs.column("text"))
        names = [key, mark, np.full(len(key), part, np.int32)]
        out, hot = [], np.flatnonzero(marks & IS_HOT)
        for i in range(0, len(hot), HOT_STEP):
            some = hot[i : i + HOT_STEP]
            for long, length in enumerate((PASSAGE, LENGTH)):
                which, offset, h1, h2 = _strings(buf, offsets[row[some]] + lo[some], more[some].astype(np.int64), size[some].astype(np.int64), length)
                kind = (marks[some][which] & np.uint8(FULL)) | np.uint8(2 * long)
                columns = [h1, h2.astype(np.uint32), lo[some][which], offset.astype(np.uint16), kind]
                out += [(b, WINDOWS, blob) for b, blob in split((h1 >> np.uint64(20)) % np.uint64(parts), row[some][which], columns, names)]
        cold = np.flatnonzero(~marks & IS_HOT)
        if not len(cold):
            return _rows(out)
        h, lo, da, more, size, full, row = h[cold], lo[cold], da[cold], more[cold], size[cold], marks[cold], row[cold]
        bucket = ((h >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(changes(bucket[order]))
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            at = order[i:j]
            start = offsets[row[at]] + lo[at]
            data = np.concatenate([buf[s : s + z] for s, z in zip(start.tolist(), size[at].tolist(), strict=True)])
            columns = [h[at], lo[at], da[at], more[at], size[at], full[at]]
            (blob,) = (b for _, b in split(np.zeros(len(at), np.int64), row[at], columns, names))
            # ``split`` keeps the order of rows here, so the bytes stay aligned with them.
            out.append((int(bucket[at[0]]), ASK, len(blob).to_bytes(8, "little") + blob + data.tobytes()))
        return _rows(out)

    return run


def _compare(rows: pa.Table) -> pa.Table:
    """What repeats of fragments that differ as a whole."""
    kinds, bodies = rows.column("kind").to_pylist(), [b.as_buffer() for b in rows.column("body")]
    return _rows([*_hot([b for k, b in zip(kinds, bodies, strict=True) if k == WINDOWS]), *_ordered([b for k, b in zip(kinds, bodies, strict=True) if k == ASK])])


def _hot(bodies: list) -> list[tuple[int, int, bytes]]:
    """Strings that others equal, joined for each fragment; any two of one fragment overlap."""
    (h1, h2, lo, offset, kind), (key, mark, part), owner, blob = gather(bodies, 5, 3)
    if not len(h1):
        return []
    long = kind >> 1
    order = np.lexsort((h2, h1, long))
    new = changes(h1[order], h2[order], long[order])
    shared = np.zeros(len(h1), bool)
    shared[order] = ~(new & np.append(new[1:], True))
    hit = np.flatnonzero(shared & (kind & FULL == 0))
    if not len(hit):
        return []
    hit = hit[np.lexsort((offset[hit], long[hit], lo[hit], owner[hit]))]
    first = np.flatnonzero(changes(owner[hit], lo[hit], long[hit]))
    last = np.append(first[1:], len(hit)) - 1
    who, begin, kind = owner[hit[first]], lo[hit[first]].astype(np.int64), long[hit[first]]
    ends = [(begin + offset[hit[first]]).astype(np.uint32), (begin + offset[hit[last]] + np.where(kind > 0, LENGTH, PASSAGE)).astype(np.uint32), kind.astype(np.uint8)]
    return [(to, COVERED, b) for to, b in split(part[who], who, ends, [key, mark])]


def _ordered(bodies: list) -> list[tuple[int, int, bytes]]:
    """Repeats of aligned fragments by column-wise construction."""
    sizes = [int.from_bytes(b.slice(0, 8).to_pybytes(), "little") for b in bodies]
    (h, lo, da, more, size, full), (key, mark, part), owner, _ = gather([b.slice(8, s) for b, s in zip(bodies, sizes, strict=True)], 6, 3)
    if not len(h):
        return []
    data = np.concatenate([np.frombuffer(b, np.uint8, -1, 8 + s) for b, s in zip(bodies, sizes, strict=True)])
    size = size.astype(np.int64)
    left = -da.astype(np.int64)
    found = Columns(h, left, left + size, data, np.cumsum(size) - size).repeats((PASSAGE, LENGTH), left + more)
    out = []
    for long, (length, (first, last)) in enumerate(zip((PASSAGE, LENGTH), found, strict=True)):
        hit = np.flatnonzero((first <= last) & (full == 0))
        begin = lo[hit].astype(np.int64) + (first - left)[hit]
        end = lo[hit].astype(np.int64) + (last - left)[hit] + length
        out += [(to, COVERED, b) for to, b in split(part[owner[hit]], owner[hit], [begin.astype(np.uint32), end.astype(np.uint32), np.full(len(hit), long, np.uint8)], [key, mark])]
    return out


def _joined(begin: list[int], end: list[int]) -> list[list[int]]:
    """Maximal runs of ranges that are sorted by their begin."""
    out: list[list[int]] = []
    for b, e in zip(begin, end, strict=True):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return out


def _finish(digests: bool):
    def run(_key: tuple, docs: pa.Table, flags: pa.Table) -> pa.Table:
        (begin, end, long), (k, m), owner, _ = gather([b for kind, b in zip(flags.column("kind").to_pylist(), flags.column("body").to_pylist(), strict=True) if kind == COVERED], 3, 2)
        names: dict[tuple[int, int], int] = {}
        who = np.array([names.setdefault(x, len(names)) for x in zip(k.tolist(), m.tolist(), strict=True)], np.int64)
        who = who[owner] if len(who) else owner
        order = np.lexsort((begin, who))
        begin, end, long, who = begin[order], end[order], long[order], who[order]
        bounds = np.searchsorted(who, np.arange(len(names) + 1))
        n_bytes, n_removed, n_repeated, kept, spans = [], [], [], [], []
        for key, mark, text in zip(docs.column("key").to_pylist(), docs.column("mark").to_pylist(), docs.column("text"), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            d = names.get((key, mark))
            here = slice(bounds[d], bounds[d + 1]) if d is not None else slice(0)
            removed = long[here] > 0
            gone, stays, at = _joined(begin[here][removed].tolist(), end[here][removed].tolist()), [], 0
            n_repeated.append(sum(e - b for b, e in _joined(begin[here].tolist(), end[here].tolist())))
            for b, e in gone:
                stays.append(data[at:b])
                at = e
            stays.append(data[at:])
            rest = b"".join(stays)
            n_bytes.append(len(data))
            n_removed.append(len(data) - len(rest))
            spans.append([{"start": b, "end": e} for b, e in gone])
            kept.append(hashlib.sha256(rest).hexdigest().encode() if digests else rest)
        return pa.table({"doc_id": docs.column("id"), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_repeated": pa.array(n_repeated, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": binary_of(kept)})

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_repeated (bytes that strings of PASSAGE bytes cover which stand elsewhere too), spans (removed runs, byte offsets) and kept (remaining bytes; ``digests``: their SHA-256)."""
    docs, parts = keyed(docs, id_col, text_col)
    asked = docs.select("key", "mark", "part", "text").mapInArrow(_ask(parts), ROWS)
    flags = cut(asked.groupBy("bucket").applyInArrow(_classes, ROWS))
    groups = docs.groupBy("part")
    shipped = groups.cogroup(flags.filter(F.col("kind") == SHIP).groupBy("bucket")).applyInArrow(_ship(parts), ROWS)
    compared = shipped.groupBy("bucket").applyInArrow(_compare, ROWS)
    covered = flags.filter(F.col("kind") == COVERED).union(compared)
    done = groups.cogroup(covered.groupBy("bucket")).applyInArrow(_finish(digests), "doc_id long, n_bytes long, n_removed long, n_repeated long, spans array<struct<start:long,end:long>>, kept binary")
    return done.withColumnRenamed("doc_id", id_col)


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), digests=True)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.col("kept").cast("string").alias("kept_sha256"), "n_repeated")


QUERIES = {"op6_suffix_array": op6_suffix_array}
ORACLE_SQL: dict[str, str] = {}
