"""Links within groups of any size: members that share a key are held against each other, and no pair of them is emitted that others already join.

A group is cut into blocks of bounded rows and bytes by a hash. Within a block links are followed breadth first: each member is compared with those not
yet reached, so a block of copies takes one comparison a member, and what is emitted is a spanning forest. Of a group of several blocks, the members that
reached most others (its hubs) then visit all its blocks, and what they join is one component, as a rule nearly all of a group of copies. At last every
member outside its group's largest component visits all blocks. So each pair of members has met, but for those within one component, and work is in
proportion to the group's size times the blocks that those outside fill. Where that is far more than the group, and linked pairs share finer keys, the group
is cut by these instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, prepare, stored
from .components import components

HUBS = 32
#: Visits of outsiders, for each member of their group, beyond which the group is cut by finer keys.
DEAR = 6


class Kind:
    """How bodies are read and compared. A subclass holds the bodies of one block."""

    @staticmethod
    def load(column: pa.Array) -> np.ndarray:
        """A batch's bodies as an array that can be cut and joined."""
        raise NotImplementedError

    def __init__(self, bodies: np.ndarray):
        self.bodies = bodies

    def near(self, body, among: np.ndarray) -> np.ndarray:
        """Which of the block's members at `among` are linked with body."""
        raise NotImplementedError

    @classmethod
    def pairs(cls, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which left[k] and right[k] are linked."""
        return np.array([bool(cls(right[k : k + 1]).near(left[k], np.zeros(1, np.int64))[0]) for k in range(len(left))], bool)


def forest(block: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (places) that join all of a block's members that chains of links join, and how many each member reached first."""
    n = len(block.bodies)
    left, queue, a, b, claims = np.arange(1, n), [0], [], [], np.zeros(n, np.int64)
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
            continue
        u = queue.pop()
        near = block.near(block.bodies[u], left)
        if near.any():
            found, left = left[near], left[~near]
            queue.extend(found.tolist())
            a.append(np.full(len(found), u))
            b.append(found)
            claims[u] = len(found)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b), claims) if a else (none, none, claims)


def _segments(batches: Iterator[pa.RecordBatch], kind: type[Kind]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of whole groups: starts of the groups, then their key, many (whether there are more blocks), node and body columns; a node once in a group."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, block, many, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        parts = (key, block, many, node, kind.load(batch.column(4)))
        if rest is not None:
            parts = tuple(np.concatenate([x, y]) for x, y in zip(rest, parts, strict=True))
        key, block, node = parts[0], parts[1], parts[3]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
        once = fresh | np.concatenate([[True], node[1:] != node[:-1]])
        starts = np.flatnonzero(fresh)
        cut = starts[-1]
        rest = tuple(x[cut:][once[cut:]] for x in parts)
        if cut:
            yield _run(parts, once, fresh, cut)
    if rest is not None:
        yield np.zeros(1, np.int64), rest[0], rest[2], rest[3], rest[4]


def _run(parts: tuple, once: np.ndarray, fresh: np.ndarray, cut: int) -> tuple:
    good = np.flatnonzero(once[:cut])
    return np.flatnonzero(fresh[good]), parts[0][good], parts[2][good], parts[3][good], parts[4][good]


def _within(dealt: DataFrame, kind: type[Kind]) -> DataFrame:
    """a, b: the links of each block's forest; and rows with a key: hubs (a) and how many they reached (b)."""
    ddl = "a long, b long, key long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, key, many, node, bodies in _segments(batches, kind):
            sizes = np.diff(starts, append=len(key))
            two = starts[(sizes == 2) & ~many[starts]]
            good = two[kind.pairs(bodies[two], bodies[two + 1])] if len(two) else two
            edges, hubs = [(node[good], node[good + 1])], []
            for s, n in zip(starts, sizes, strict=True):
                if n > 2 or many[s]:
                    own = node[s : s + n]
                    a, b, claims = forest(kind(bodies[s : s + n]))
                    edges.append((own[a], own[b]))
                    if many[s]:
                        best = np.argsort(-claims, kind="stable")[:HUBS]
                        hubs.append((own[best], claims[best], key[s : s + 1].repeat(len(best))))
            a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], schema=schema)
            if hubs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*hubs, strict=True)], schema=schema)

    return dealt.select("key", "block", F.col("many"), "node", "body").repartition("key", "block").sortWithinPartitions("key", "block", "node").mapInArrow(run, ddl)


def _visited(members: DataFrame, visitors: DataFrame, kind: type[Kind]) -> DataFrame:
    """members and visitors (key, block, node, body, root) -> a, b: of each visitor and block a link into each component other than its own."""
    ddl = "a long, b long"
    schema = arrow_schema(ddl)
    columns = ["key", "block", "side", "node", "root", "body"]
    both = members.withColumn("side", F.lit(0)).select(*columns).unionAll(visitors.withColumn("side", F.lit(1)).select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, at, side, node, root = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            bodies, edges = kind.load(batch.column(5)), []
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (at[1:] != at[:-1]) | (side[1:] != side[:-1])]))
            for s, e in zip(starts, [*starts[1:], len(key)], strict=True):
                if (key[s], at[s]) != now:
                    now, held, block = (key[s], at[s]), [], None
                if side[s] == 0:
                    held.append((node[s:e], root[s:e], bodies[s:e]))
                    continue
                if not held:
                    continue
                if block is None:
                    own, roots, whole = (np.concatenate(x) for x in zip(*held, strict=True))
                    block = kind(whole)
                for k in range(s, e):
                    among = np.flatnonzero(roots != root[k])
                    if len(among):
                        found = among[block.near(bodies[k], among)]
                        found = found[np.unique(roots[found], return_index=True)[1]]
                        edges.append((np.full(len(found), node[k]), own[found]))
            if edges:
                a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return both.repartition("key", "block").sortWithinPartitions("key", "block", "side").mapInArrow(run, ddl)


def _rooted(members: DataFrame, edges: DataFrame) -> DataFrame:
    star = components(edges).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return members.join(star, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("_root", "node")).drop("_node", "_root")


def linked(members: DataFrame, kind: type[Kind], rows: int, most: int, finer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """members (key long, node long, body binary) -> edges (a, b) that join what links within groups join. Blocks hold about `rows` members and `most` bytes.

    finer: members -> members under new keys, of which every linked pair of a group shares one, and which must become smaller each time. Repeated rows count once. A column often tells, if there is one, which groups may have more members than a block. members is read up to three times:
    store it, if it is dear.
    """
    prepare(members.sparkSession)
    n = F.ceil(F.greatest(F.count("*") / rows, F.sum(F.octet_length("body").cast("double")) / most)).cast("int")
    counted = members.where("often") if "often" in members.columns else members
    big = stored(counted.groupBy("key").agg(n.alias("n")).where("n > 1"), "big-groups")
    place = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    dealt = members.join(big, "key", "left").withColumn("many", F.col("n").isNotNull()).withColumn("block", F.when(F.col("many"), place).otherwise(0))
    found = stored(_within(dealt, kind), "links")
    edges = found.where("key is null").select("a", "b")
    if big.isEmpty():
        return edges
    groups = stored(members.join(big, "key").withColumn("block", place), "groups")
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.col("b").desc(), "a"))
    hubs = found.where("key is not null").withColumn("_k", first).where(F.col("_k") <= HUBS).select("key", F.col("a").alias("node"))
    everywhere = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    rooted = stored(_rooted(groups, edges), "groups")
    visitors = rooted.join(hubs, ["key", "node"], "left_semi").withColumn("block", everywhere)
    edges = edges.unionAll(stored(_visited(rooted, visitors, kind), "links"))
    rooted = stored(_rooted(groups, edges), "groups")
    main = rooted.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("_main"))
    outside = rooted.join(main, "key").where("root <> _main")
    if finer is not None:
        visits = outside.groupBy("key").agg((F.count("*") * F.first("n")).alias("_visits")).join(rooted.groupBy("key").agg(F.count("*").alias("_size")), "key")
        dear = stored(visits.where(F.col("_visits") > DEAR * F.col("_size")).select("key"), "dear-groups")
        if not dear.isEmpty():
            edges = edges.unionAll(linked(stored(finer(rooted.join(dear, "key", "left_semi")), "finer-groups"), kind, rows, most, finer))
            outside = outside.join(dear, "key", "left_anti")
    outside = outside.withColumn("block", everywhere)
    return edges.unionAll(stored(_visited(rooted, outside, kind), "links"))
