"""Harmonic packing of token sequences.

Class k of capacity C holds pieces with C/(k+1) < length <= C/k, and a bin of class k takes exactly k of them. A document is cut so that its
pieces fill their classes: whole capacities first, then from the rest the longest C//k that fits, until what is left wastes at most SLACK of a bin
or is at most C//SMALL. Each worker fills the bins of the rows it reads, without a shuffle; what a worker has left in open bins at its end is laid
end to end, cut at the capacity, so that at most one sequence of a task is short.

Nulls and edge cases: a null text is empty and is packed as its end id alone; repeated rows are packed as often as they occur; an empty table
gives no piece; a null doc_id stays null; extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .bpe import encoder
from .common import arrow_schema, prepare, table, text_of

CAPACITY = 1024
SLACK = 0.01
SMALL = 16
#: Sequence ids of a task lie in a range of their own.
PER_TASK = 1 << 36
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(n: int, capacity: int = CAPACITY, slack: float = SLACK, small: int = SMALL) -> list[int]:
    """The lengths of a document's pieces, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if rest * small <= capacity or capacity - k * rest <= slack * capacity:
            return [*out, rest]
        fit = capacity // -(-capacity // rest)
        out.append(fit)
        rest -= fit
    return out


class Packer:
    """Bins of one worker. A piece is (document's order, doc_id, start, ids); closed sequences go to emit(sequence, pieces)."""

    def __init__(self, emit, capacity: int = CAPACITY):
        self.emit, self.capacity, self.open, self.sequence = emit, capacity, {}, 0

    def close(self, pieces: list) -> None:
        self.emit(self.sequence, pieces)
        self.sequence += 1

    def add(self, piece: tuple) -> None:
        k = self.capacity // len(piece[2])
        if k == 1:
            self.close([piece])
            return
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            self.close(self.open.pop(k))

    def end(self) -> None:
        """Lays what open bins hold end to end."""
        row, room = [], self.capacity
        for k in sorted(self.open):
            for doc, start, ids, whole in self.open[k]:
                while len(ids) > room:
                    row.append((doc, start, ids[:room], whole))
                    start, ids = start + room, ids[room:]
                    self.close(row)
                    row, room = [], self.capacity
                row.append((doc, start, ids, whole))
                room -= len(ids)
                if not room:
                    self.close(row)
                    row, room = [], self.capacity
        if row:
            self.close(row)
        self.open = {}


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all docs (doc_id, text): PIECE, and with with_ids the ids as array of int.

    sequence_id is unique over all tasks; a reader who wants the sequences groups by it and sorts by offset.
    """
    prepare(docs.sparkSession)
    ddl = PIECE + (", ids array<int>" if with_ids else "")
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base = encoder(tokenizer), TaskContext.get().partitionId() * PER_TASK
        out: list[tuple] = []
        said: list[np.ndarray] = []

        def emit(sequence: int, pieces: list) -> None:
            offset = 0
            for doc, start, ids, whole in pieces:
                out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), whole, base + sequence, offset))
                if with_ids:
                    said.append(ids)
                offset += len(ids)

        def rows() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=False)]
            if with_ids:
                ends = np.cumsum([0, *map(len, said)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(said).astype(np.int32))))
            out.clear()
            said.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        bins = Packer(emit, capacity)
        for batch in batches:
            ids, ends = enc.encode_column(batch.column(1), end_id)
            for doc, at, end in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                start = 0
                for n in cuts(end - at, capacity):
                    # a copy of what a bin keeps, lest it hold its whole batch
                    bins.add((doc, start, ids[at + start : at + start + n].copy(), end - at))
                    start += n
                if len(out) >= 1024:
                    yield rows()
        bins.end()
        if out:
            yield rows()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, ddl)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 1024."""
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
