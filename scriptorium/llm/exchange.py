"""Exchange of packed arrays between texts and hash buckets.

Row-wise shuffles of word or byte positions cost more than the positions hold.
Here a task packs what it found in a batch of texts into one binary value per
hash bucket; a bucket's task compares arrays and packs its answers per group of
documents. Group and bucket counts follow the corpus's size, so each stays
within a fixed number of bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import pack, unpack

#: Text bytes of a group of documents, up to 4096 groups; then groups grow up to LARGEST.
GROUP, GROUPS, LARGEST = 8 << 20, 4096, 256 << 20
MISSING_ID = (1 << 63) - 1

ROWS = "bucket int, kind int, source int, body binary"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Columns id, key, mark, part and text, and the number of parts.

    ``key`` is the id, the greatest long if null; with ``mark``, a hash of the
    text, it tells documents apart. Rows with equal id and text are one document.
    """
    docs = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(12, min(-(-size // GROUP), GROUPS), -(-size // LARGEST))
    docs = docs.withColumn("key", F.coalesce("id", F.lit(MISSING_ID))).withColumn("mark", F.xxhash64("text"))
    return docs.withColumn("part", F.pmod(F.xxhash64("key", "mark"), F.lit(parts)).cast("int")).select("id", "key", "mark", "part", "text"), parts


def by_run(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of runs of equal values."""
    if not len(owner):
        return owner, np.empty(0, np.uint32)
    at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    return owner[at], np.diff(np.append(at, len(owner))).astype(np.uint32)


def split(target: np.ndarray, owner: np.ndarray, columns: list[np.ndarray], names: list[np.ndarray]):
    """(target, blob) for each target; a blob packs its rows' columns, then names of owners and run lengths.

    Rows of an owner must stand together; ``names`` are arrays by owner.
    """
    order = np.argsort(target, kind="stable")
    target, owner, columns = target[order], owner[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1], [True]))) if len(target) else np.zeros(1, int)
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        who, runs = by_run(owner[i:j])
        yield int(target[i]), pack(*(c[i:j] for c in columns), *(n[who] for n in names), runs)


def gather(blobs: list, n_columns: int, n_names: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Columns, names, owner of each row, and the blob of each row."""
    opened = [unpack(b) for b in blobs]
    if not opened:
        empty = np.empty(0, np.int64)
        return [empty] * n_columns, [empty] * n_names, empty, empty
    columns = [np.concatenate([o[k] for o in opened]) for k in range(n_columns)]
    names = [np.concatenate([o[n_columns + k] for o in opened]) for k in range(n_names)]
    runs = np.concatenate([o[-1] for o in opened])
    owner = np.repeat(np.arange(len(runs)), runs)
    return columns, names, owner, np.repeat(np.arange(len(opened)), [len(o[0]) for o in opened])


def narrow(x: np.ndarray) -> np.ndarray:
    """In 16 bits if all fit, else in 32."""
    return x.astype(np.uint16 if not len(x) or x.max() < 65536 else np.uint32)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where sorted columns differ from the row before; the first row does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out
