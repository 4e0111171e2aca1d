"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _state(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))")).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, root): for each node with an edge to another node the smallest node of its component.

    Every round is two aggregations and two joins over the edges and ends in a checkpoint; rounds stop when the edges no longer change, after
    O(log n) rounds in practice. No group of neighbours is ever collected. Loops and edges with a null are left out; no edges give no rows.
    """
    e = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    state = _state(e)
    while state[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(root.select("hi", F.col("m").alias("lo")))
        e = cut_lineage(small.distinct())
        before, state = state, _state(e)
        if state == before:
            break
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
