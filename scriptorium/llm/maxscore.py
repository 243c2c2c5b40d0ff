"""Exact top-k search by MaxScore over sharded, impact-ordered postings.

Each dimension has a posting list of a shard's rows by falling component, read
from its front by terms above zero and from its end by those below, as far as it
adds to a score; further on it can only lower one. A term's bound is what the
next posting of its list can add. With the current k-th score as threshold, the
terms of the least bounds that together stay below it are non-essential: a row
that no essential list has brought up yet can't get in through them. So only
essential lists are traversed, a stretch of the one of the highest bound at a
time; rows that come up first there are scored, term block by term block, and
the other terms are probed only while a row can still reach the threshold. After
every stretch the threshold rises and the bound of that list falls, and more
terms become non-essential; at last all are, and the shard is done. Shards are
dealt to tasks, each with all blocks of queries (or a group of them, if there are
many). A task goes through its shards one after another, and the threshold that a
query has reached holds in the next one. The tasks' lists of k are merged by a
window that keeps k rows a query on the map side. Nothing is broadcast: blocks go
to tasks, never to single shards, by one shuffle.

Defined results: vectors that are null, empty or hold a null or non-finite component take
no part, as query or as row; shorter vectors count as zero beyond their end;
ties go to the smaller id; a row of a query's own id is never its result, so
repeated ids are results of other queries only, each row for itself; of a
query's id, each distinct vector is one query; null ids take no part; scores
have to fit a long; only the named columns are read; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import binary_of, cut, pack, table, unpack

#: Rows of a shard and queries of a block; they bound what one comparison holds.
SHARD, BLOCK = 4096, 1024
#: Blocks of queries that a task holds at most.
HELD = 256
#: Terms that are added before rows are dropped again.
STEP = 16
#: Postings of a list's first stretch, and of its longest; each is twice the one before. With a threshold from other shards, all are of the longest.
STRETCH, LONGEST = 64, 4096


def _packed(key: tuple, rows: pa.Table) -> pa.Table:
    """A shard or block as one value: ids, and components row by row, by id; a row of n copies stands n times."""
    ids = rows.column("id").to_numpy()
    order = np.repeat(np.argsort(ids, kind="stable"), rows.column("n").to_numpy()[np.argsort(ids, kind="stable")])
    vectors = rows.column("vector").to_pylist()
    width = max(map(len, vectors), default=0)
    matrix = np.zeros((len(order), width), np.int64)
    for i, j in enumerate(order.tolist()):
        matrix[i, : len(vectors[j])] = vectors[j]
    if matrix.size and abs(matrix).max() < 1 << 15:
        matrix = matrix.astype(np.int16)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "body": binary_of([pack(ids[order], np.array([width]), matrix.ravel())])})


def _matrix(blob) -> tuple[np.ndarray, np.ndarray]:
    ids, width, flat = unpack(blob)
    return ids, flat.reshape(len(ids), int(width[0]))


class Shard:
    """Impact-ordered postings of a shard's rows. ``read`` and ``products`` count postings read and products made."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.read, self.products = ids, 0, 0
        self.rows = matrix = matrix.astype(np.int64)
        self.largest = int(abs(matrix).max(initial=0))
        self.exact: dict[type, np.ndarray] = {}
        self.lists = np.argsort(-matrix, axis=0, kind="stable").T.astype(np.int32)
        self.impacts = np.take_along_axis(matrix.T, self.lists, 1)

    def _as(self, kind: type) -> np.ndarray:
        if kind not in self.exact:
            self.exact[kind] = self.rows.astype(kind)
        return self.exact[kind]

    def search(self, own: int, query: np.ndarray, k: int, found: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but those of the query's own id, among these and the ``found`` ones of other shards."""
        n, width = len(self.ids), min(len(query), self.rows.shape[1])
        query = query[:width]
        most_sum = width * self.largest * int(abs(query).max(initial=0))
        # Sums of products below 2**24 and 2**53 are whole in floats of 32 and 64 bits.
        kind = np.float32 if most_sum < 1 << 24 else np.float64 if most_sum < 1 << 53 else np.int64
        rows, weights = self._as(kind), query.astype(kind)
        fresh = self.ids != own
        best, scores = found or (np.empty(0, np.int64), np.empty(0, np.int64))
        if not n:
            return best, scores
        up = query > 0
        most = np.maximum(np.where(up, self.impacts[:width, 0] * query, self.impacts[:width, -1] * query), 0)
        by_most = np.argsort(-most, kind="stable")
        rest = np.append(np.cumsum(most[by_most][::-1])[::-1], 0)
        threshold = int(scores[-1]) if len(best) == k else None
        bounds, place, stretch = most.copy(), np.zeros(width, np.int64), STRETCH if threshold is None else LONGEST
        while True:
            if threshold is not None and bounds.sum() < threshold:
                break  # all terms are non-essential
            d = int(bounds.argmax()) if width else 0
            if width and bounds[d] > 0:
                i, j = place[d], min(place[d] + stretch, n)
                some = self.lists[d, i:j] if up[d] else self.lists[d, n - j : n - i]
                place[d], stretch = j, min(2 * stretch, LONGEST)
                bounds[d] = max(0, int((self.impacts[d, j] if up[d] else self.impacts[d, n - 1 - j]) * query[d])) if j < n else 0
                self.read += j - i
                some = some[fresh[some]]
            else:  # no list adds anything to what is left
                some = np.flatnonzero(fresh)
            fresh[some] = False
            partial, done = np.zeros(len(some), rows.dtype), 0
            while done < width and len(some):
                terms = by_most[done : done + STEP]
                partial = partial + rows[np.ix_(some, terms)] @ weights[terms]
                self.products += len(some) * len(terms)
                done = min(done + STEP, width)
                if threshold is not None:
                    alive = partial + rest[done] >= threshold
                    some, partial = some[alive], partial[alive]
            if len(some):
                best, scores = np.concatenate((best, self.ids[some])), np.concatenate((scores, partial.astype(np.int64)))
                top = np.lexsort((best, -scores))[:k]
                best, scores = best[top], scores[top]
                threshold = int(scores[-1]) if len(best) == k else None
            if not fresh.any() or not bounds.any() and not width:
                break
        return best, scores


def _search(k: int):
    """Of rows (deal, kind, of, body), by deal and kind: the k best of a deal's shards (kind 1) for each of its queries (kind 0)."""

    def result(blocks, best):
        of = [(q << 32) + np.arange(len(ids)) for q, ids, _ in blocks]
        sizes = [len(x) for found in best for x, _ in found]
        columns = (
            np.repeat(np.concatenate([ids for _, ids, _ in blocks] or [[]]).astype(np.int64), sizes),
            np.repeat(np.concatenate(of or [[]]).astype(np.int64), sizes),
            *(np.concatenate([x[i] for found in best for x in found] or [[]]).astype(np.int64) for i in (0, 1)),
        )
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_id", "place", "id", "score"])

    def run(batches):
        at, blocks, best = None, [], []
        for batch in batches:
            for deal, kind, of, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if deal != at:
                    yield result(blocks, best)
                    at, blocks, best = deal, [], []
                ids, matrix = _matrix(body.as_buffer())
                if kind == 0:
                    blocks.append((of, ids, matrix))
                    best.append([(np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids))
                    continue
                shard = Shard(ids, matrix)
                for (_, own, queries), found in zip(blocks, best, strict=True):
                    found[:] = [shard.search(int(o), q.astype(np.int64), k, x) for o, q, x in zip(own, queries, found, strict=True)]
        yield result(blocks, best)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """query_id, rank (from 1), id and score of each query's k best rows by integer inner product.

    Both tables hold integer arrays; rows of a query's own id are left out.
    """
    packed = []
    for t, size, copies in ((vectors, SHARD, k), (queries, BLOCK, 1)):
        rows = t.select(t[id_col].cast("long").alias("id"), t[vector_col].cast("array<bigint>").alias("vector")).filter("id is not null and vector is not null and size(vector) > 0")
        # Equal rows are counted first: more than k of them can't all be results, and equal queries are one.
        rows = cut(rows.groupBy("id", "vector").agg(F.least(F.count("*"), F.lit(copies)).alias("n")))
        n = max(1, -(-rows.count() // size))
        spread = rows.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("int"))
        packed.append((cut(spread.groupBy("block").applyInArrow(_packed, "block int, body binary")), n))
    (shards, n_shards), (blocks, n_blocks) = packed
    # Every block of queries meets every shard: the stated query set against all rows. Blocks are sent
    # once a deal, so the number of deals is held where their bytes come to a few times those of the shards.
    groups = -(-n_blocks // HELD)
    deals = min(n_shards, max(2 * vectors.sparkSession.sparkContext.defaultParallelism, 8 * n_shards // n_blocks))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = blocks.select("block", "body", each(deals).alias("to")).select((F.col("to") * groups + F.col("block") % groups).alias("deal"), F.lit(0).alias("kind"), F.col("block").cast("long").alias("of"), "body")
    dealt = shards.select("block", "body", each(groups).alias("to")).select((F.col("block") % deals * groups + F.col("to")).alias("deal"), F.lit(1).alias("kind"), F.col("block").cast("long").alias("of"), "body")
    tasks = sent.unionByName(dealt).repartitionById(deals * groups, F.col("deal")).sortWithinPartitions("deal", "kind")
    found = tasks.mapInArrow(_search(k), "query_id long, place long, id long, score long")
    best = Window.partitionBy("query_id", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def quantized(vector, scale: int = 256):
    """floor(scale * x) of each component; null where a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))
    return F.when(~bad, whole)


def op1_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", quantized(F.col("embedding")).alias("vector"))
    found = top_k(rows, rows.filter(F.col("vec_id") % 50 == 0), 5, "vec_id")
    return found.withColumnRenamed("id", "vec_id")


QUERIES = {"op1_maxscore": op1_maxscore}
ORACLE_SQL = {
    "op1_maxscore": """
        WITH e AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM e q, e c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
