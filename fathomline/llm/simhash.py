"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints within 4 bits differ in at most 4 of their 8 bytes, so at least MATCHES = 4 positional bytes are shared: the guaranteed
minimum. The index's posting lists are keyed by a choice of 4 positions with the bytes there (70 choices), so that two fingerprints meet in a list
exactly if their tally of shared positional bytes reaches the minimum; a pair that shares more meets more often, and counts in the first of its lists
only. Pairs that pass the tally are verified by their Hamming distance.

Equal fingerprints are one node. A list emits a spanning forest of its links, not its pairs, which keeps every component. The task that a list beyond
BLOCK nodes comes to only passes it on, 16 bytes for each node, and compares nothing. Such lists are joined as groups of many blocks (see linking):
of near copies, a few nodes reach nearly all. A list whose nodes aren't linked would meet in all pairs of blocks; it is cut into finer lists by the
bits that it doesn't share instead, again and again while it is long, so each of its nodes costs a few rows more and none is left out.

Nulls and edge cases: a null or empty text, or one of white space alone, has fingerprint zero and is linked like any other; repeated rows are one
node; a null doc_id never is a component's id unless all of its doc_ids are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, by_batch, cells, fixed, free_name, hashed, prepare, stored, table, text_of
from .components import components
from .linking import Kind, linked

BITS = 4
MATCHES = 8 - BITS
SHINGLE = 4
SEED = 42
BLOCK = 4096
CHOICES = list(combinations(range(8), MATCHES))


def _first_choice() -> np.ndarray:
    """For each mask of shared bytes the first of CHOICES that it covers, or -1."""
    out = np.full(256, -1, np.int64)
    for k in range(len(CHOICES) - 1, -1, -1):
        mask = sum(1 << p for p in CHOICES[k])
        for m in range(256):
            if m & mask == mask:
                out[m] = k
    return out


FIRST = _first_choice()


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash over XXH64 of word shingles, repeats included."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, seed) for s in parts], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):
        ones += np.unpackbits(h[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            fp = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            return {"doc_id": batch.column(0), "fp": fp}

        return work

    return by_batch(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")), "doc_id long, fp long", make)


def postings(nodes: DataFrame) -> DataFrame:
    """nodes (fp) -> (key, fp): a row for each choice of positions."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            part = fp.astype("<i8").view(np.uint8).reshape(-1, 8).astype(np.int64)
            keys = [sum((part[:, p] << (8 * k) for k, p in enumerate(choice)), np.int64(n) << 32) for n, choice in enumerate(CHOICES)]
            return {"key": np.concatenate(keys), "fp": np.tile(fp, len(CHOICES))}

        return work

    return by_batch(nodes.select("fp"), "key long, fp long", make)


def forest(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all nodes of a list that chains of links within BITS join.

    Breadth first: each node is compared with those not yet reached, so what is compared shrinks as links are found.
    """
    nodes = own.view(np.uint64)  # bitwise_count takes the absolute value of signed ones
    left, queue, a, b = np.arange(len(nodes)), [], [], []
    while len(left) or queue:
        if not queue:
            queue, left = [left[0]], left[1:]
        u = queue.pop()
        near = np.bitwise_count(nodes[left] ^ nodes[u]) <= BITS
        if near.any():
            found = left[near]
            left = left[~near]
            queue.extend(found)
            a.append(np.repeat(nodes[u], len(found)))
            b.append(nodes[found])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)) if a else (empty, empty)


def _verified(key: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of lists of two: the pair's tally reaches MATCHES, this is the first list where it does, and the distance holds."""
    diff = x ^ y
    shared = np.packbits(diff.view(np.uint8).reshape(-1, 8) == 0, axis=1, bitorder="little")[:, 0]
    return (FIRST[shared] == key >> 32) & (np.bitwise_count(diff.view(np.uint64)) <= BITS)


class Fingerprints(Kind):
    """Bodies are a fingerprint and the bits that its list shares, 8 bytes each; linked within BITS."""

    @staticmethod
    def load(column):
        return fixed(column, 16)[:, :8].copy().view("<u8")[:, 0]

    def near(self, body, among):
        return np.bitwise_count(self.bodies[among] ^ body) <= BITS


def finer(members: DataFrame) -> DataFrame:
    """Members of lists (key, node, body) in lists of which every linked pair shares one.

    The bits that a list doesn't share are cut into BITS + 1 parts. Two fingerprints that differ in at most BITS bits are equal in one of these: a new list is
    of an old one, a part and its value, and shares that part's bits, too. Of distinct fingerprints a list that shares 52 bits holds 4096 at most, so
    cutting ends.
    """

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            key, node = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            own = fixed(batch.column(2), 16).copy().view("<u8")
            shared, at, parts = own[:, 1], np.arange(len(key)), []
            # the number of each bit among those that aren't shared, and how many these are
            bits = np.arange(64, dtype=np.uint64)
            free = (shared[:, None] >> bits & np.uint64(1)) == 0
            place, total = np.cumsum(free, 1) - 1, free.sum(1)
            for part in range(BITS + 1):
                inside = free & (place * (BITS + 1) // np.maximum(total, 1)[:, None] == part)
                mask = (inside.astype(np.uint64) << bits).sum(1, dtype=np.uint64)
                parts.append((hashed(hashed(key ^ np.uint64(part + 1)) ^ (own[:, 0] & mask)), at, shared | mask))
            keys, at, masks = (np.concatenate(x) for x in zip(*parts, strict=True))
            return {"key": keys.view(np.int64), "node": node[at].view(np.int64), "body": cells(np.stack([own[at, 0], masks], 1))}

        return work

    return by_batch(members.select("key", "node", "body"), "key long, node long, body binary", make)


def _listed(long: DataFrame) -> DataFrame:
    """Members (key, node, body) of posting lists (key, fp)."""

    def make():
        masks = np.array([sum(0xFF << (8 * p) for p in choice) for choice in CHOICES], np.uint64)

        def work(batch: pa.RecordBatch) -> dict:
            key, fp = (batch.column(k).to_numpy() for k in (0, 1))
            return {"key": key, "node": fp, "body": cells(np.stack([fp.view(np.uint64), masks[key >> 32]], 1))}

        return work

    return by_batch(long.select("key", "fp"), "key long, node long, body binary", make)


def links(nodes: DataFrame) -> DataFrame:
    """nodes (fp, distinct) -> edges (a, b), signed fingerprints: a spanning forest of each posting list."""
    prepare(nodes.sparkSession)
    ddl, most = "a long, b long, key long", BLOCK
    schema = arrow_schema(ddl)

    def rows(a, b, key=None) -> pa.RecordBatch:
        n = len(a)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), none if b is None else pa.array(b, pa.int64()), none if key is None else pa.array(np.full(n, key), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rest, long = None, np.zeros(0, np.int64), False  # of the list that a batch's end cut: its key, nodes held, whether nodes were sent on

        def closed(key: int, fp: np.ndarray, sent: bool) -> Iterator[pa.RecordBatch]:
            if sent:
                if len(fp):
                    yield rows(fp, None, key)
            elif len(fp) > 1:
                a, b = forest(fp)
                if len(a):
                    yield rows(a, b)

        for batch in batches:
            key, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if last is not None and len(key):
                if key[0] == last:
                    n = int(np.searchsorted(key, last, "right"))
                    rest, key, fp = np.concatenate([rest, fp[:n]]), key[n:], fp[n:]
                if len(key):
                    yield from closed(last, rest, long)
                    last, rest, long = None, rest[:0], False
            if len(key):
                at = int(np.searchsorted(key, key[-1], "left"))
                last, rest, key, fp = int(key[-1]), fp[at:], key[:at], fp[:at]
                starts = np.flatnonzero(np.diff(key, prepend=-1))
                sizes = np.diff(starts, append=len(key))
                two = starts[sizes == 2]
                good = _verified(key[two], fp[two], fp[two + 1])
                if good.any():
                    yield rows(fp[two[good]], fp[two[good] + 1])
                for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                    yield from closed(int(key[s]), fp[s : s + n], False)
            if len(rest) > most or long and len(rest):
                yield rows(rest, None, last)
                rest, long = rest[:0], True
        if last is not None:
            yield from closed(last, rest, long)

    found = stored(postings(nodes).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, ddl), "links")
    edges, long = found.where("key is null").select("a", "b"), found.where("key is not null").select("key", F.col("a").alias("fp"))
    if long.isEmpty():
        return edges
    return edges.unionAll(linked(stored(_listed(long), "long-lists"), Fingerprints, BLOCK, 64 << 20, finer))


def grouped(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp, root (a fingerprint of the component), component_id, a row for each row of docs."""
    found = stored(fingerprints(docs), "fingerprints")
    nodes = stored(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    star = components(links(nodes))
    rooted = nodes.join(star, nodes["fp"] == star["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return found.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp, component_id (the smallest doc_id that links reach), a row for each row of docs."""
    return grouped(docs).drop("root")


def _one_each(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Of each group of keys the row whose text has the smallest hash, the first by all columns as JSON of equals; a partial aggregate."""
    row = F.struct(*(F.col(f"`{c}`") for c in columns))
    first = F.min_by(row, F.struct(F.xxhash64(F.col("text").cast("string")), F.to_json(row))).alias("row")
    return df.groupBy(*keys).agg(first).select("row.*")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their component. Of rows that share such a doc_id and a component one stays, by the hash of its text.

    A component without any doc_id keeps one row, of the fingerprint that is its root, by the same rule.
    """
    named = grouped(docs)
    mark, at, group, own = (free_name(docs, x) for x in ("_fp", "_at", "_root", "_own"))

    @F.pandas_udf("long")
    def digest(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    kept = named.where("doc_id = component_id")
    out = docs.join(kept.select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns)
    if not named.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty():
        # rows that share a doc_id may lie in several components: each row goes by its own fingerprint
        roots = kept.select(F.col("doc_id").alias(own), F.col("fp").alias(at), F.col("root").alias(group)).distinct()
        out = out.withColumn(mark, digest(text_of(out)))
        out = _one_each(out.join(roots, (out["doc_id"] == F.col(own)) & (F.col(mark) == F.col(at))), docs.columns, own, group)
    bare = named.where("doc_id is null and component_id is null and fp = root").select("fp").distinct()
    if bare.isEmpty():
        return out
    nameless = docs.where(docs["doc_id"].isNull()).withColumn(mark, digest(text_of(docs)))
    one = _one_each(nameless.join(bare.select(F.col("fp").alias(at)), F.col(mark) == F.col(at), "left_semi"), docs.columns, mark)
    return out.unionByName(one)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
