"""Token-ID files: range asymmetric numeral systems over shared static tables.

A *segment* is a run of whole documents in ascending doc_id order: one frequency table, counted over all of the segment's ids, serves all its
blocks. A *block* is coded by LANES interleaved coders that share one stream of 16-bit words. Its header holds the number of ids, and the final
states of the lanes: a checkpoint from which the block is decoded without any other block. Each block has a CRC-32 of its ids. Segments are rows
of a Parquet table (columns of SEGMENT), so Spark commits them atomically and any store that Spark reads will do; they decode in parallel.

Nulls and edge cases: a null text is the empty text, whose only id is the end id; a null doc_id sorts first; repeated rows are coded as often as
they occur (equal doc_ids by their texts' first 64 characters, then a hash); an empty table gives an empty table of segments; extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .common import arrow_schema, prepare, table, text_of

SCALE = 16
TOTAL = 1 << SCALE
LANES = 1024
BLOCK_IDS = 1 << 18
#: A segment ends with the document that reaches either.
SEGMENT_IDS, SEGMENT_DOCS = 1 << 21, 1 << 16
SEGMENT = (
    "part int, segment int, part_start long, n_ids long, doc_ids array<long>, doc_lengths array<long>, symbols binary, frequencies binary, blocks array<binary>, checks array<long>"
)


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum up to TOTAL, at least 1 for each count above 0."""
    if len(counts) > TOTAL:
        raise ValueError(f"at most {TOTAL} distinct ids fit the table")
    f = np.maximum(1, counts * TOTAL // max(1, counts.sum())).astype(np.int64)
    while over := int(f.sum()) - TOTAL:
        order = np.argsort(-f, kind="stable")
        if over < 0:
            f[order[0]] -= over
        else:
            spare = f[order] - 1
            room = np.minimum(spare, np.maximum(1, spare * over // max(1, spare.sum())))
            take = np.minimum(room, np.maximum(0, over - (np.cumsum(room) - room)))
            f[order] -= take
    return f


class Table:
    """Shared by all blocks of a segment."""

    def __init__(self, symbols: np.ndarray, frequencies: np.ndarray):
        self.symbols, self.f = symbols.astype(np.int64), frequencies.astype(np.uint64)
        self.c = (np.cumsum(self.f) - self.f).astype(np.uint64)

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        return cls(symbols, quantised(counts[symbols]))

    def packed(self) -> tuple[bytes, bytes]:
        return zlib.compress(np.diff(self.symbols, prepend=0).astype("<u4").tobytes()), zlib.compress((self.f - np.uint64(1)).astype("<u2").tobytes())

    @classmethod
    def unpacked(cls, symbols: bytes, frequencies: bytes) -> Table:
        return cls(np.cumsum(np.frombuffer(zlib.decompress(symbols), "<u4").astype(np.int64)), np.frombuffer(zlib.decompress(frequencies), "<u2").astype(np.uint64) + np.uint64(1))

    def rank(self, ids: np.ndarray) -> np.ndarray:
        place = np.zeros(int(self.symbols[-1]) + 1, np.int64)
        place[self.symbols] = np.arange(len(self.symbols))
        return place[ids]

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.symbols)), self.f.astype(np.int64))


def encode_block(ranks: np.ndarray, t: Table) -> bytes:
    """Header (ids, lanes: unsigned 32 bits each), the lanes' final states, then the words in the order in which decoding needs them."""
    n, lanes = len(ranks), min(LANES, len(ranks))
    f, c = t.f[ranks], t.c[ranks]
    most = f << np.uint64(16)
    x = np.full(lanes, 1 << 16, np.uint64)
    words = []
    half, low = np.uint64(16), np.uint64(0xFFFF)
    for start in range((n - 1) // lanes * lanes if n else 0, -1, -lanes or -1):
        stop = min(n, start + lanes)
        y, g = x[: stop - start], f[start:stop]
        full = y >= most[start:stop]
        words.append((y[full] & low).astype("<u2"))
        y[full] >>= half
        q = y // g
        y[:] = (q << half) + (y - q * g) + c[start:stop]
    return np.array([n, lanes], "<u4").tobytes() + x.astype("<u4").tobytes() + b"".join(w.tobytes() for w in reversed(words))


def decode_block(block: bytes, t: Table, slots: np.ndarray) -> np.ndarray:
    n, lanes = (int(v) for v in np.frombuffer(block, "<u4", 2))
    x = np.frombuffer(block, "<u4", lanes, 8).astype(np.uint64)
    words = np.frombuffer(block, "<u2", offset=8 + 4 * lanes).astype(np.uint64)
    out, at = np.empty(n, np.int64), 0
    half, low, least = np.uint64(16), np.uint64(0xFFFF), np.uint64(1 << 16)
    for start in range(0, n, lanes or 1):
        stop = min(n, start + lanes)
        y = x[: stop - start]
        slot = y & low
        s = slots[slot.astype(np.int64)]
        out[start:stop] = s
        y[:] = t.f[s] * (y >> half) + slot - t.c[s]
        empty = y < least
        k = int(np.count_nonzero(empty))
        y[empty] = (y[empty] << half) | words[at : at + k]
        at += k
    if at != len(words) or (x != least).any():  # the coders end where they began
        raise ValueError("a block's words don't fit its states")
    return t.symbols[out]


def encode_segment(pieces: list[np.ndarray]) -> dict:
    """The columns symbols, frequencies, blocks and checks of the ids of pieces."""
    ids = np.concatenate(pieces)
    t = Table.of(ids)
    blocks, checks = [], []
    for k in range(0, len(ids), BLOCK_IDS):
        part = ids[k : k + BLOCK_IDS]
        blocks.append(encode_block(t.rank(part), t))
        checks.append(zlib.crc32(part.astype("<u4").tobytes()))
    symbols, frequencies = t.packed()
    return {"n_ids": len(ids), "symbols": symbols, "frequencies": frequencies, "blocks": blocks, "checks": checks}


def decode_segment(symbols: bytes, frequencies: bytes, blocks: list[bytes], checks: list[int]) -> np.ndarray:
    """The segment's ids; ValueError if a block's checksum differs."""
    t = Table.unpacked(symbols, frequencies)
    slots, out = t.slots(), []
    for block, check in zip(blocks, checks, strict=True):
        ids = decode_block(block, t, slots)
        if zlib.crc32(ids.astype("<u4").tobytes()) != check:
            raise ValueError("a block's checksum differs")
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encodes docs (doc_id, text) in ascending doc_id order into the Parquet table at path.

    Rows are dealt by ranges of doc_id, the text's start and hash, and the row's place in docs, so each task holds a run of documents and no doc_id, nor a
    repeated row, is too frequent for it; within a task memory is bounded by one segment and one document.
    """
    prepare(docs.sparkSession)
    schema = arrow_schema(SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, segment, start = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        names: list = []
        lengths: list[int] = []
        pieces: list[np.ndarray] = []  # runs of ids of whole documents
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal segment, start, held
            row = {"part": part, "segment": segment, "part_start": start, "doc_ids": names[:], "doc_lengths": lengths[:]} | encode_segment(pieces)
            segment, start, held = segment + 1, start + held, 0
            for kept in (names, lengths, pieces):
                kept.clear()
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            ids, at = enc.encode_column(batch.column(1), end_id)
            begun = 0
            for k, (doc, n) in enumerate(zip(batch.column(0).to_pylist(), np.diff(at).tolist(), strict=True), 1):
                names.append(doc)
                lengths.append(n)
                held += n
                if held >= SEGMENT_IDS or len(names) >= SEGMENT_DOCS:
                    pieces.append(ids[at[begun] : at[k]])
                    begun = k
                    yield flush()
            if begun < batch.num_rows:
                pieces.append(ids[at[begun] :])
        if names:
            yield flush()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    order = ["doc_id", "_start", "_hash"]
    keyed = rows.withColumns({"_start": F.substring("text", 1, 64), "_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})  # equal rows needn't lie in one range
    dealt = keyed.repartitionByRange(*order, "_row").sortWithinPartitions(*order)
    dealt.select("doc_id", "text").mapInArrow(run, SEGMENT).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and the ids (array of int), or with digest ids_crc32 in their place.

    The number of ids before each part is a running sum over parts: as many rows as tasks wrote, brought to the driver.
    """
    prepare(spark)
    files = spark.read.schema(SEGMENT).parquet(path)
    before, total = {}, 0
    for part, n in files.groupBy("part").agg(F.sum("n_ids")).orderBy("part").collect():
        before[part], total = total, total + n
    last = "ids_crc32 long" if digest else "ids array<int>"
    schema = arrow_schema(f"doc_id long, start long, n_tokens long, {last}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = decode_segment(row["symbols"], row["frequencies"], row["blocks"], row["checks"])
                stops = np.cumsum(row["doc_lengths"])
                starts = stops - row["doc_lengths"]
                if digest:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    ends = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                    out = pa.array(ends, pa.int64())
                else:
                    out = pa.ListArray.from_arrays(pa.array(np.append(starts, stops[-1:]), pa.int32()), pa.array(ids, pa.int32()))
                first = before[row["part"]] + row["part_start"]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + first, pa.int64()), pa.array(row["doc_lengths"], pa.int64()), out], schema=schema)

    return files.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, as read back from the files."""
    import uuid

    import public_tokenizers

    from .common import shared_dir

    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path, digest=True)
