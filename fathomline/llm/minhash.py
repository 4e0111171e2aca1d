"""MinHash near-duplicates by an inverted join of signature coordinates.

A document's set of word shingles has a signature of SIGNED coordinates, each the least value of a hash function over the set; equal sets are one node.
Two sets agree in a coordinate with the probability of their Jaccard similarity. The first INDEXED coordinates, with their values, are the keys of an
inverted index. A pair that agrees in MATCHES of them shares one of any INDEXED - MATCHES + 1 that one of the two is posted under in a common order; so
a node is posted under as many of its pairs as that, the rarest ones (the prefix), and its long lists are skipped. The order is by counts of all pairs
in 2^16 classes of them, which a task holds as one array. A posting carries a byte of each coordinate; pairs that meet count their agreeing bytes, the skipped
lists' included, and stay if AGREE of SIGNED agree: the match threshold. Both thresholds lie so far below what a pair at the limit gives that one in some
10^9 of such pairs is lost.

What stays joins nodes into clusters; in each, links are confirmed on the full sets, computed from the texts of those documents alone, and the
documents' components follow from confirmed links only.

Nulls and edge cases: a null or empty text, or one of white space alone, has no shingles and is linked with nothing, not even its like; a text of fewer
words than a shingle is one shingle; repeated rows and equal sets share a component; a null doc_id is no component's id unless a component has no other,
and counts as equal to it then; an empty table gives no rows; extra columns take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, cells, fixed, hashed, stored, table, text_of
from .components import components
from .linking import Kind, linked

SHINGLE, SIMILAR = 3, 85
SIGNED, AGREE = 64, 32
INDEXED, MATCHES = 32, 13
PREFIX = INDEXED - MATCHES + 1
CLASSES = 1 << 16
#: Members of a block of postings; members and bytes of a block of full sets.
POSTED, HELD, HELD_BYTES = 4096, 2048, 16 << 20

_random = np.random.Generator(np.random.PCG64(13))
_FLIP = _random.integers(0, 1 << 63, (SIGNED, 1), np.uint64)
_SPREAD = _random.integers(0, 1 << 63, (SIGNED, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS = [np.uint64(x) for x in _random.integers(1 << 62, 1 << 63, SHINGLE, np.uint64) | np.uint64(1)]
_STEP = 4096


class _Hashes(dict):
    """Hashes of words, as many as fit."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str, hashes: dict, size: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes; words are told by ASCII white space, A-Z count as a-z."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(hashes.__getitem__, words)), np.uint64)
    n = min(size, len(h))
    total = np.full(len(h) - n + 1, np.uint64(n), np.uint64)
    for k in range(n):
        total += hashed(h[k : len(h) - n + 1 + k]) * _WORDS[k]
    return np.unique(hashed(total))


def signature(x: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's hash over a set that isn't empty."""
    least = None
    for k in range(0, len(x), _STEP):
        part = ((x[k : k + _STEP] ^ _FLIP) * _SPREAD).min(1)
        least = part if least is None else np.minimum(least, part)
    return least


def signed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, seen (a hash of the text), n (the set's size), h1 and h2 (128 bits that name the set), values (INDEXED), bytes (SIGNED)."""
    ddl = "doc_id long, seen long, n long, h1 long, h2 long, values binary, bytes binary"

    def make():
        import xxhash

        hashes = _Hashes()

        def work(batch: pa.RecordBatch) -> dict:
            names, values = np.zeros((batch.num_rows, 3), np.uint64), np.zeros((batch.num_rows, SIGNED), np.uint64)
            for k, text in enumerate(batch.column(2)):
                x = shingles(text.as_py(), hashes)
                raw = x.tobytes()
                names[k] = len(x), xxhash.xxh64_intdigest(raw, 1), xxhash.xxh64_intdigest(raw, 2)
                if len(x):
                    values[k] = signature(x)
            n, h1, h2 = names.view(np.int64).T
            return {"doc_id": batch.column(0), "seen": batch.column(1), "n": n, "h1": h1, "h2": h2, "values": cells(values[:, :INDEXED]), "bytes": cells((values >> np.uint64(24)).astype(np.uint8))}

        return work

    return by_batch(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text_of(docs)).alias("seen"), text_of(docs).alias("text")), ddl, make)


def _classes(values: np.ndarray) -> np.ndarray:
    return ((values >> np.uint64(20)) % np.uint64(CLASSES)).astype(np.int64)


def frequencies(nodes: DataFrame) -> np.ndarray:
    """How many (coordinate, value) pairs of all nodes fall in each class."""

    def run(batches):
        counts = np.zeros(CLASSES, np.int64)
        for batch in batches:
            counts += np.bincount(_classes(fixed(batch.column(0), 8 * INDEXED).view(np.uint64)).ravel(), minlength=CLASSES)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["class", "n"])

    found = nodes.select("values").mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def postings(nodes: DataFrame) -> DataFrame:
    """nodes (node, n, values, bytes) -> key, node, body, often: a row for each of the PREFIX rarest pairs, with the set's size and the bytes, and whether its list may be long."""
    shared, most = nodes.sparkSession.sparkContext.broadcast(frequencies(nodes)), POSTED

    def make():
        often = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            node, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values, bytes_ = fixed(batch.column(2), 8 * INDEXED).view(np.uint64), fixed(batch.column(3), SIGNED)
            order = np.lexsort((values, often[_classes(values)]), axis=1)[:, :PREFIX]
            body = np.concatenate([n.astype("<u4").view(np.uint8).reshape(-1, 4), bytes_], 1)
            return {"key": np.take_along_axis(values, order, 1).ravel().view(np.int64), "node": np.repeat(node, PREFIX), "body": cells(np.repeat(body, PREFIX, 0)), "often": pa.array(np.take_along_axis(often[_classes(values)], order, 1).ravel() > most)}

        return work

    return by_batch(nodes.select("node", "n", "values", "bytes"), "key long, node long, body binary, often boolean", make)


class Sketches(Kind):
    """Set sizes and bytes of the coordinates. Linked: AGREE bytes agree, and the sizes allow the similarity."""

    @staticmethod
    def load(column):
        return fixed(column, 4 + SIGNED)

    @staticmethod
    def _agree(left, right):
        a, b = (np.ascontiguousarray(x[:, :4]).view("<u4")[:, 0].astype(np.int64) for x in (left, right))
        sizes = 100 * np.minimum(a, b) >= SIMILAR * np.maximum(a, b)
        return sizes & ((left[:, 4:] == right[:, 4:]).sum(1) >= AGREE)

    def near(self, body, among):
        return self._agree(self.bodies[among], body[None])

    @classmethod
    def pairs(cls, left, right):
        return cls._agree(left, right)


class Sets(Kind):
    """Full sets; linked by their similarity. Intersections are counted over the block's inverted lists."""

    @staticmethod
    def load(column):
        out = np.empty(len(column), object)
        for k, x in enumerate(column):
            out[k] = np.frombuffer(x.as_buffer(), "<u8")
        return out

    def __init__(self, bodies):
        super().__init__(bodies)
        self.sizes = np.array([len(x) for x in bodies], np.int64)
        every = np.concatenate(list(bodies))
        order = np.argsort(every, kind="stable")
        self.who = np.repeat(np.arange(len(bodies)), self.sizes)[order]
        self.values, starts = np.unique(every[order], return_index=True)
        self.starts = np.append(starts, len(every))

    def near(self, body, among):
        at = np.minimum(np.searchsorted(self.values, body), len(self.values) - 1)
        at = at[self.values[at] == body]
        begin, length = self.starts[at], self.starts[at + 1] - self.starts[at]
        places = np.repeat(begin - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
        both = np.bincount(self.who[places], minlength=len(self.sizes))[among]
        return 100 * both >= SIMILAR * (self.sizes[among] + len(body) - both)


def _bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, node, body (the full set) of the rows of docs that wanted (key, node, doc_id, seen) names."""
    names = wanted.select("key", "node", F.col("doc_id").alias("_doc"), F.col("seen").alias("_seen"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    # merged at every size: where a few names were sent to all tasks instead, the shuffle of texts would begin with the table's growth
    met = rows.join(names.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_seen")))

    def make():
        hashes = _Hashes()

        def work(batch: pa.RecordBatch) -> dict:
            return {"key": batch.column(0), "node": batch.column(1), "body": pa.array([shingles(t.as_py(), hashes).tobytes() for t in batch.column(2)], pa.binary())}

        return work

    return by_batch(met.select("key", "node", "text"), "key long, node long, body binary", make)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept, a row for each row of docs."""
    found = stored(signed(docs), "signatures")
    sets = found.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("values").alias("values"), F.first("bytes").alias("bytes"), F.min(F.struct("doc_id", "seen")).alias("row"))
    nodes = stored(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    clusters = components(linked(postings(nodes), Sketches, POSTED, 64 << 20)).select("node", F.col("root").alias("key"))
    wanted = clusters.unionAll(clusters.select(F.col("key").alias("node"), "key")).distinct().join(nodes.select("node", "row.doc_id", "row.seen"), "node")
    full = stored(_bodies(docs, stored(wanted, "wanted")), "full-sets")
    star = components(linked(full, Sets, HELD, HELD_BYTES))
    rooted = nodes.select("node", "h1", "h2", "least").join(star, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("h1", "h2", "component_id")
    some = found.where("n > 0").select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2"]).select("doc_id", "n", "component_id")
    every = some.unionAll(found.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component."""
    return near_duplicates(table(spark, sf_dir, "documents"))
