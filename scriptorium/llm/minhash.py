"""Near-duplicate groups by MinHash: many universal hash minima, banding, verification, components.

A document's set holds its distinct shingles of ``WORDS`` words. Documents of
equal sets form one class, pre-aggregated before anything else is shuffled; the
class's least id stands for it. Bands of minima bring similar classes into
buckets. Band keys travel packed, one that several classes of a batch share once
for the batch, and only keys that two classes share come out as rows. In each
bucket every class is first compared with the bucket's centre only. What these
links leave in different components inside one bucket is then compared in tiles,
pairs of one component excepted, behind a filter on finer signatures of these
documents: 2048 minima of 2 bits, whose agreement at the threshold is taken six
standard deviations low. Every link is confirmed on the full sets. No bucket is
capped; centres and classes of very many rows are joined by broadcast, so that
their rows stay dealt out. With 71 bands of 6 minima a pair at the threshold
shares a bucket with probability 1 - 1e-6.

Defined results: no text or words: an empty set, linked with nothing; a null id
takes no part in linking, has no component and is kept; rows that repeat an id
are each linked by their own text; very long texts are hashed whole; only the
named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import binary_of, blocks, cut, pack, raw, spread, spread_join, table, unpack
from scriptorium.llm.components import connected_components
from scriptorium.llm.exchange import changes, gather, split
from scriptorium.llm.words import LOWER, mixed, word_hashes

WORDS = 5
THRESHOLD = 75
BANDS, ROWS = 71, 6
#: Minima of the finer signatures; two bits of each are kept.
FINE = 2048
#: Bytes of band keys of one exchange bucket, and of the least number of buckets.
KEY_BYTES, LEAST_BUCKETS = 16 << 20, 12
#: Kinds of exchanged rows.
KEYS, MET = 0, 1
#: Members of a bucket that one task compares with one another.
TILE = 1024
#: Ids, and bytes of full sets, that may be broadcast; beyond, the same joins shuffle.
BROADCAST_IDS, BROADCAST_BYTES = 2_000_000, 16 << 20

_seeds = np.random.default_rng(20240229)
_MULTIPLY = (_seeds.integers(0, 2**32, BANDS * ROWS, np.uint32) | np.uint32(1))[:, None]
_ADD = _seeds.integers(0, 2**32, BANDS * ROWS, np.uint32)[:, None]
_FINE_MULTIPLY = (_seeds.integers(0, 2**32, FINE, np.uint32) | np.uint32(1))[:, None]
_FINE_ADD = _seeds.integers(0, 2**32, FINE, np.uint32)[:, None]
_PLACE = _seeds.integers(0, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _seeds.integers(0, 2**63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, before = word_hashes(LOWER[buf], offsets)
    n = len(words)
    windows = np.zeros(max(n - WORDS + 1, 0), np.uint64)
    for k in range(WORDS):
        windows += words[k : k + len(windows)] * _PLACE[k]
    windows = mixed(windows)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= WORDS:
            s = np.sort(windows[a : b - WORDS + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(mixed(np.array([(words[a:b] * _PLACE[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(shingles: np.ndarray, multiply: np.ndarray = _MULTIPLY, add: np.ndarray = _ADD, cells: int = 1 << 19) -> np.ndarray:
    """The minima of all universal hash functions over a set."""
    least = np.full(len(multiply), 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    step = max(1, cells // len(multiply))
    for i in range(0, len(x), step):
        np.minimum(least, (multiply * x[i : i + step] + add).min(1), out=least)
    return least


def _fine(batches):
    """The finer signatures, four minima to a byte."""
    for batch in batches:
        buf, offsets = raw(batch.column(1))
        out = []
        for i, j in blocks(offsets, 500_000):
            for found in shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                bits = (signature(found, _FINE_MULTIPLY, _FINE_ADD) & np.uint32(3)).astype(np.uint8).reshape(-1, 4)
                out.append((bits << np.arange(0, 8, 2, dtype=np.uint8)).sum(1, dtype=np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), binary_of(out)], ["node", "fine"])


def _sketch(batches):
    """Size and hash of each set; band keys for the least id of each set in the batch."""
    for batch in batches:
        buf, offsets = raw(batch.column(1))
        ids = batch.column(0).to_pylist()
        sizes, hashes, first, sketched = [], [], {}, []
        for i, j in blocks(offsets, 500_000):
            for k, found in enumerate(shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), i):
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                sizes.append(len(found)), hashes.append(digest)
                if len(found) and ids[k] is not None:
                    if digest not in first:
                        sketched.append(signature(found))
                        first[digest] = [k, len(first)]
                    elif ids[k] < ids[first[digest][0]]:
                        first[digest][0] = k
        minima = np.array(sketched, np.uint32).reshape(-1, BANDS, ROWS)
        keys = mixed((minima.astype(np.uint64) * _BAND).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
        of = {k: n for k, n in first.values()}
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                binary_of(hashes),
                binary_of([keys[of[k]].tobytes() if k in of else None for k in range(len(ids))]),
            ],
            ["doc_id", "n_shingles", "set_hash", "keys"],
        )


def _send(buckets: int):
    """Band keys by bucket, packed with the ids and set hashes that they come from.

    Of a key that several classes of a batch share, the class that meets most
    others is sent to the key's bucket, with their number; the others have met
    already, and go to any bucket as they are. So a key that a third of all
    classes hold brings one entry of each batch to its bucket.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            sets = np.frombuffer(b"".join(h[:8] for h in batch.column(1).to_pylist()), np.int64)
            keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64)
            owner = np.repeat(np.arange(len(ids)), BANDS)
            order = np.lexsort((ids[owner], sets[owner], keys))
            order = order[changes(keys[order], sets[owner[order]])]  # the least id of each class
            keys, owner = keys[order], owner[order]
            at = np.flatnonzero(changes(keys))
            size = np.diff(np.append(at, len(keys)))
            run_of = np.repeat(np.arange(len(at)), size)
            degree = np.bincount(owner, size[run_of], len(ids))
            sent_on = np.lexsort((ids[owner], -degree[owner], run_of))[at]
            met = np.ones(len(keys), bool)
            met[sent_on] = False
            met = np.flatnonzero(met)
            sent_on = np.sort(sent_on)
            counts = size[run_of[sent_on]].astype(np.uint32)
            by_owner = np.argsort(owner[sent_on], kind="stable")
            sent_on, counts = sent_on[by_owner], counts[by_owner]
            sent = [(b, KEYS, blob) for b, blob in split(keys[sent_on] % np.uint64(buckets), owner[sent_on], [keys[sent_on], counts], [ids, sets])]
            if len(met):
                any_bucket = int(mixed(ids[:1].view(np.uint64))[0] % np.uint64(buckets))
                sent.append((any_bucket, MET, pack(keys[met].view(np.int64), ids[owner[met]], size[run_of[met]])))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in sent], pa.int32()), pa.array([k for _, k, _ in sent], pa.int32()), binary_of([x for _, _, x in sent])], ["bucket", "kind", "body"])

    return run


def _meet(rows: pa.Table) -> pa.Table:
    """(key, node) of keys that two classes share, with the number of nodes that it is known to meet."""
    kinds, bodies = rows.column("kind").to_pylist(), rows.column("body").to_pylist()
    (keys, counts), (ids, sets), owner, _ = gather([b for k, b in zip(kinds, bodies, strict=True) if k == KEYS], 2, 2)
    ids, sets = ids[owner], sets[owner]
    order = np.lexsort((ids, sets, keys))
    within = counts[order] > 1
    keys, ids, counts = keys[order], ids[order], counts[order].astype(np.int64)
    # The least id of each class stands for it; one that has met others in its batch stays.
    good = changes(keys, sets[order]) | within
    keys, ids, counts, within = keys[good], ids[good], counts[good], within[good]
    at = np.flatnonzero(changes(keys))
    size = np.diff(np.append(at, len(keys)))
    total = np.repeat(np.add.reduceat(counts, at), size) if len(at) else counts
    many = np.repeat(size > 1, size) | within
    columns = [[keys.view(np.int64)[many], ids[many], total[many]]]
    columns += [unpack(b) for k, b in zip(kinds, bodies, strict=True) if k == MET]
    return pa.table({name: pa.array(np.concatenate([c[i] for c in columns]), pa.int64()) for i, name in enumerate(("key", "node", "members"))})


def _full_sets(batches):
    for batch in batches:
        buf, offsets = raw(batch.column(1))
        for i, j in blocks(offsets, 500_000):
            sets = shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), binary_of([s.tobytes() for s in sets])], ["id", "shingles"])


def _confirmed(batches):
    """Pairs whose full sets reach the threshold."""
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if 100 * min(len(a), len(b)) < THRESHOLD * max(len(a), len(b)):
                good.append(False)
                continue
            both = np.sort(np.concatenate((a, b)))
            common = int((both[1:] == both[:-1]).sum())
            good.append(100 * common >= THRESHOLD * (len(a) + len(b) - common) > 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))


def links(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (u, v) of document ids whose full sets are similar enough."""
    pairs = cut(pairs)
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    few = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    sets = cut(texts.select("id", "text").mapInArrow(_full_sets, "id long, shingles binary"))
    if (sets.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0) <= BROADCAST_BYTES:
        sets = F.broadcast(sets)  # few texts in many pairs: then no set travels with each pair
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
    return cut(both.select("u", "v", "a", "b").mapInArrow(_confirmed, "u long, v long").distinct())


def _across(_key: tuple, rows: pa.Table) -> pa.Table:
    """Pairs of a tile whose components differ and whose signatures agree."""
    nodes, parts, block = (rows.column(c).to_numpy() for c in ("node", "component", "block"))
    fine = np.frombuffer(b"".join(rows.column("fine").to_pylist()), np.uint64).reshape(len(nodes), -1)
    chance = THRESHOLD / 100 + (1 - THRESHOLD / 100) / 4
    most_apart = FINE - int(FINE * (chance - 6 * (chance * (1 - chance) / FINE) ** 0.5))
    pairs_of_bits = np.uint64(0x5555555555555555)
    cross = len(set(block.tolist())) > 1
    kinds, counts = np.unique(parts, return_counts=True)
    rare = np.flatnonzero(parts != kinds[counts.argmax()]) if len(nodes) else []
    us, vs = [], []
    done = np.zeros(len(nodes), bool)
    for i in rare:
        done[i] = True
        fit = ~done & (parts != parts[i])
        if cross:
            fit &= block != block[i]
        at = np.flatnonzero(fit)
        apart = fine[at] ^ fine[i]
        at = at[np.bitwise_count((apart | (apart >> np.uint64(1))) & pairs_of_bits).sum(1) <= most_apart]
        us.append(np.full(len(at), nodes[i]))
        vs.append(nodes[at])
    u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (us, vs))
    return pa.table({"u": pa.array(np.maximum(u, v), pa.int64()), "v": pa.array(np.minimum(u, v), pa.int64())})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable over links) and kept (it is that id)."""
    docs = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    sketches = cut(docs.mapInArrow(_sketch, "doc_id long, n_shingles long, set_hash binary, keys binary"))
    classes = cut(sketches.filter("n_shingles > 0 and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")))
    heads = sketches.filter("keys is not null")
    buckets = max(LEAST_BUCKETS, -(-heads.count() * BANDS * 8 // KEY_BYTES))
    sent = heads.select("doc_id", "set_hash", "keys").mapInArrow(_send(buckets), "bucket int, kind int, body binary")
    inside = cut(sent.groupBy("bucket").applyInArrow(_meet, "key long, node long, members long"))
    # A bucket's centre is its member that meets most others over all buckets, as the text does that copies were made of.
    degree = inside.groupBy("node").agg(F.sum("members").alias("degree"))
    best = F.max_by("node", F.struct("degree", -F.col("node")))
    centres = inside.join(degree, "node").groupBy("key").agg(best.alias("centre"))
    inside = cut(inside.join(centres, "key"))
    stars = inside.filter("node <> centre").select(F.greatest("node", "centre").alias("u"), F.least("node", "centre").alias("v")).distinct()
    first = links(stars, docs)
    parts = connected_components(first)

    # Centres whose buckets still hold several components: compare across these, in tiles, each pair once a centre.
    met = inside.select("centre", "node").distinct()
    placed = met.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed_up = placed.groupBy("centre").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).filter("lo <> hi")
    mixed_up = cut(mixed_up.select("centre", "members", F.col("members").alias("n")))
    opened = cut(spread_join(placed, mixed_up, "centre"))
    few = opened.count() <= BROADCAST_IDS // 4
    tiles = F.ceil(F.col("members") / TILE).cast("int")
    nodes = opened.select(F.col("node").alias("id")).distinct()
    fine = cut(docs.join(F.broadcast(nodes) if few else nodes, "id", "left_semi").select("id", "text").mapInArrow(_fine, "node long, fine binary"))
    open_ = (
        fine.join(F.broadcast(opened) if few else opened, "node")
        .withColumn("tiles", F.when(F.col("members") > TILE, tiles).otherwise(1))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumn("tile_a", F.least("block", "other"))
        .withColumn("tile_b", F.greatest("block", "other"))
    )
    across = open_.groupBy("centre", "tile_a", "tile_b").applyInArrow(_across, "u long, v long").distinct()
    rest = links(across.join(stars, ["u", "v"], "left_anti"), docs)
    parts = connected_components(first.union(rest))

    # What is alone in its class and has no link is its own component and needs no join.
    by_class = classes.join(parts, "node", "left").filter("n > 1 or component is not null")
    by_class = cut(by_class.select("set_hash", "n", F.coalesce("component", "node").alias("component")))
    rows = sketches.select("doc_id", "n_shingles", "set_hash")
    linked = F.col("n_shingles") > 0
    joined = spread_join(rows.filter(linked & F.col("doc_id").isNotNull()), by_class, "set_hash", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    alone = rows.filter(~linked | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"op2_minhash": op2_minhash}
ORACLE_SQL: dict[str, str] = {}
