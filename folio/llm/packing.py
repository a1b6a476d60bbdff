"""Packing by concatenate and cut: two passes and prefix sums over partition token totals.

Pass one encodes every document, adds the end id, and writes ids with the tokens before it in its
partition. The totals of the partitions (one number each) are summed up on the driver to global
offsets. Pass two cuts the endless sequence into windows of 2048 and returns a boundary record for
each piece of a document. Only the last window can need padding.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; an empty
table has no pieces; other columns are not read. Which document comes first follows the
partitions as written in pass one, so it does not change when a task runs again.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from folio.llm.bpe import WordBpe, vocabulary
from folio.llm.common import arrow_map, table, written

PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ends_sequence boolean, ends_document boolean"


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """part int, before long (tokens of the partition's earlier rows), doc_id, n long, ids binary (unsigned 16-bit if the vocabulary allows)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    class State:
        def __init__(self):
            self.bpe, self.before, self.part = WordBpe(path), 0, TaskContext.get().partitionId()

    def each(cols, s):
        end = np.array([end_id], s.bpe.kind).tobytes()
        ids = [x + end for x in s.bpe.encode(cols[1])]
        sizes = [len(x) // len(end) for x in ids]
        starts = np.cumsum([s.before, *sizes])
        s.before = int(starts[-1])
        return [[s.part] * len(ids), starts[:-1].tolist(), cols[0], sizes, ids]

    return arrow_map(docs.select("doc_id", "text"), f"part int, before long, doc_id {kind}, n long, ids binary", each, State)


def packed(docs: DataFrame, path: str, end_id: int = 1, size: int = 2048) -> DataFrame:
    """The pieces of all documents; columns doc_id and those of PIECE."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = written(tokenized(docs, path, end_id), "tokens", batch_rows=1000)
    totals = sorted(ids.groupBy("part").sum("n").collect())
    base, sofar = {}, 0
    for part, n in totals:
        base[part], sofar = sofar, sofar + n
    all_tokens = sofar

    def each(cols):
        out = [[] for _ in range(9)]
        for part, before, doc, n, raw in zip(*cols):
            wide = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
            at, start = base[part] + before, 0
            while start < n:
                seq, off = divmod(at + start, size)
                length = min(size - off, n - start)
                last = off + length == size or at + start + length == all_tokens
                row = (doc, start, length, zlib.crc32(wide[4 * start : 4 * (start + length)]), n, seq, off, last, start + length == n)
                for c, x in zip(out, row):
                    c.append(x)
                start += length
        return out

    return arrow_map(ids, f"doc_id {kind}, {PIECE}", each)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), vocabulary())
