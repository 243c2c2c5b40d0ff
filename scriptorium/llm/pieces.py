"""SentencePiece encoding and decoding through a table of distinct chunks.

Pieces of the model never hold a whitespace marker behind another character and
never hold a line feed, so no merge crosses the start of a run of markers or of
line feeds. A text is cut there into chunks; each distinct chunk is segmented
once and kept in a bounded table, and the ids of a text are joined back by
position. A model without these two properties is given whole texts instead.

Defined results: null and empty text give no ids and the empty decoded text;
very long texts are cut into chunks like any other; repeated rows and ids give a
row each; columns besides the named ones are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm.common import spread, table

MODEL = "piece_bpe_32k.model"
#: Chunks kept by a task before the table starts anew; bounds its memory.
TABLE_SIZE = 600_000
#: Longer chunks are segmented but not kept.
LONGEST_KEPT = 64


class ChunkTable:
    """Encodes texts as the library does, one distinct chunk at a time."""

    def __init__(self, model_file: str, size: int = TABLE_SIZE):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = size
        self.ids: dict[str, bytes] = {"": array("i", [self.model.piece_to_id("▁")]).tobytes()}
        self.names = [str(i) for i in range(self.model.vocab_size())]
        self.runs = re.compile(" +[^ \n]*|\n+[^ \n]*").findall
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.marker = self.model.piece_to_id("▁")
        probe = self.model.encode("\n")
        self.exact = (
            not any("\n" in p or re.search("[^▁]▁", p) for p in pieces)
            and probe[:1] == [self.marker]
            and self.model.encode("  a \n") == [*self.model.encode("  a"), self.marker, *probe[1:]]
            and self.model.encode("a▁b") == self.model.encode("a b")
        )

    def _cut(self, text: str) -> list[str]:
        """Chunks, each without the space that the library's own leading marker stands for."""
        if not text:
            return []
        text = " " + text.replace("▁", " ")
        if "  " not in text:
            return text[1:].replace("\n", " \n").split(" ")
        return [c.removeprefix(" ") for c in self.runs(text)]

    def _learn(self, chunks: list[str]) -> None:
        """Segment chunks; in front of a line feed, the library's leading marker is not the text's."""
        for skip, some in ((0, [c for c in chunks if c and c[0] != "\n"]), (1, [c for c in chunks if c and c[0] == "\n"])):
            found = self.model.encode(some, num_threads=1) if some else []
            self.ids.update((c, array("i", ids[skip:]).tobytes()) for c, ids in zip(some, found, strict=True))

    def _packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        cut = list(map(self._cut, texts))
        if len(self.ids) > self.size:
            self.ids = {"": self.ids[""]}
        new = set().union(*cut).difference(self.ids)
        self._learn(list(new))
        known = self.ids.__getitem__
        out = [b"".join(map(known, cs)) for cs in cut]
        for c in new:
            if len(c) > LONGEST_KEPT:
                del self.ids[c]
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.exact:
            return self.model.encode(texts, num_threads=1)
        return [np.frombuffer(ids, np.int32).tolist() for ids in self._packed(texts)]

    def lengths(self, texts: list[str]) -> list[int]:
        if not self.exact:
            return list(map(len, self.model.encode(texts, num_threads=1)))
        return [len(ids) // 4 for ids in self._packed(texts)]

    def joined(self, ids: list[int]) -> bytes:
        return ",".join(map(self.names.__getitem__, ids)).encode()


@contextmanager
def without_gc():
    """No collection of garbage while a table of many small objects without cycles grows.

    Spark gives a worker's process to other tasks later, of this query and others;
    what theirs leave in cycles has to be collected again.
    """
    before = gc.isenabled()
    gc.collect()
    gc.disable()
    try:
        yield
    finally:
        if before:
            gc.enable()
        gc.collect()
        pa.default_memory_pool().release_unused()


def _groups(sizes: list[int], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    i = size = 0
    for j, n in enumerate(sizes):
        size += n
        if size > chars:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(sizes):
        yield i, len(sizes)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None, digests: bool = False) -> DataFrame:
    """One row per document with its ids and the text that they decode to.

    ``digests``: instead of ids and text, the number of ids and the SHA-256 of
    the comma-joined ids and of the decoded text in UTF-8.
    """
    path = model_file or public_tokenizers.path(MODEL)
    kind = docs.schema[id_col].dataType.simpleString()

    def encoded(batches):
        coder = ChunkTable(path)
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            for i, j in _groups(sizes):
                ids = coder.encode([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()])
                back = [coder.model.decode(x) if x else "" for x in ids]
                keys = batch.column(0).slice(i, j - i)
                if digests:
                    hexed = [hashlib.sha256(coder.joined(x)).hexdigest() for x in ids]
                    plain = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]
                    yield pa.RecordBatch.from_arrays([keys, pa.array(map(len, ids), pa.int64()), pa.array(hexed), pa.array(plain)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.list_(pa.int32())), pa.array(back)], ["id", "ids", "decoded"])

    def run(batches):
        with without_gc():
            yield from encoded(batches)

    schema = f"id {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), digests=True)


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
