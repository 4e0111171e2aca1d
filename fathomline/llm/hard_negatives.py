"""Hard negatives by exact inner-product search over a table of pivot distances.

Let M be the largest norm of all rows. A row x becomes (x, sqrt(M² - |x|²)) and an anchor q becomes (q, 0): then |q - x|² = |q|² + M² - 2<q, x>, so an
inner product is a Euclidean distance. For PIVOTS pivots p, the distances of every row to every pivot are stored. By the triangle inequality
|d(q,p) - d(x,p)| <= d(q,x) <= d(q,p) + d(x,p), so the stored distances bracket each score; only rows whose bracket reaches what an anchor still looks for
are scored exactly.

Rows lie in *cells* (of their nearest pivot), and cells in chunks of about CHUNK rows by a hash; a cell of any size is so many chunks, each of them a
sorted run in some task. An anchor goes to a chunk of its own cell first, which gives it a threshold, then to those chunks whose cell's range
of distances can still hold better rows. Anchors stream past a chunk in blocks; what a task holds is one chunk and one block.

Positives (rows of the anchor's label) are looked for in cells by label, so rows of other labels are never met; negatives in cells over all labels.
Pivots are picked, each the farthest from those before it, among SAMPLE rows drawn by a hash; nothing but the speed depends on them.

Nulls and edge cases: rows with a null label, a null vector, or a component that is null or not finite (also after scaling) take no part; rows that are
equal in id, label and vector count once, others that share an id are rows of their own; a row without an id is no anchor and comes behind all ids of its
score; rows of different length never meet; scores saturate at the bounds of a long; an empty table gives no rows; extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, by_batch, prepare, stored, table

SCALE = 256
PIVOTS, SAMPLE, SAMPLE_BYTES = 16, 2000, 64 << 20
CHUNK, VISITORS = 4096, 256
POSITIVES, NEGATIVES = 5, 3
LONG_LEAST, LONG_MOST = -(1 << 63), (1 << 63) - 1
#: Shares of a positive's score, in percent, that a negative's score lies between.
LOW, HIGH = 50, 95


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def quantised(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """df (vec_id, label, embedding) -> row (unique), vec_id, label, dim, v (integers as doubles), norm2: each distinct row that takes part, written once."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * float(scale)) < float("inf"))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(F.forall("embedding", fine)).dropDuplicates()

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            vectors = batch.column(2)
            flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * scale)
            ends = np.concatenate([[0], np.cumsum(np.diff(vectors.offsets.to_numpy()))])
            with np.errstate(over="ignore"):
                sums = np.concatenate([[0], np.cumsum(flat * flat)]) if np.abs(flat).max(initial=0) < 1 << 20 else None
            norm2 = sums[ends[1:]] - sums[ends[:-1]] if sums is not None else np.array([np.dot(x := flat[a:b], x) for a, b in zip(ends, ends[1:], strict=False)])
            v = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            return {"vec_id": batch.column(0), "label": batch.column(1), "dim": pa.array(np.diff(ends), pa.int32()), "v": v, "norm2": norm2}

        return work

    out = by_batch(rows, "vec_id long, label long, dim int, v array<double>, norm2 double", make)
    return stored(out.withColumn("row", F.monotonically_increasing_id()), "vectors")


class Pivots:
    """Augmented pivot vectors and the distances to them."""

    def __init__(self, sample: list[list[float]], most: float, n: int):
        width = max(map(len, sample))
        x = np.zeros((len(sample), width + 1))
        for row, v in zip(x, sample, strict=True):
            row[: len(v)] = v
        self.most = most
        x[:, -1] = np.sqrt(np.maximum(most - (x * x).sum(1), 0))
        picked, far = [0], np.full(len(x), np.inf)
        while len(picked) < min(n, len(x)):
            far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(1))
            if not far.max() > 0:
                break
            picked.append(int(far.argmax()))
        self.p = x[picked]

    def distances(self, v: np.ndarray, norm2: np.ndarray, augmented: bool) -> np.ndarray:
        """Of rows (augmented) or anchors to each pivot."""
        width = min(v.shape[1], self.p.shape[1] - 1)
        dots = v[:, :width] @ self.p[:, :width].T
        own = np.sqrt(np.maximum(self.most - norm2, 0)) if augmented else np.zeros(len(v))
        total = norm2 + own * own
        return np.sqrt(np.maximum(total[:, None] + self.most - 2 * (dots + own[:, None] * self.p[:, -1]), 0))


def pivot_table(rows: DataFrame) -> tuple[DataFrame, float]:
    """rows of quantised() with cell, d (of the row as a point) and q (as an anchor, null where it is none by vec_id); and M²."""
    spark = rows.sparkSession
    most, count, widest = rows.agg(F.max("norm2"), F.count("*"), F.max("dim")).first()
    n = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, widest or 1))))
    share = round(min(1.0, n / max(1, count)) * (1 << 30))
    drawn = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < share).orderBy("row").limit(2 * n).select("v").toArrow().column(0).to_pylist()
    shared = spark.sparkContext.broadcast(Pivots(drawn or [[0.0]], most or 0.0, PIVOTS))

    def make():
        pivots = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            row, vec_id, label, dim, v, norm2 = batch.columns
            dims, norms = dim.to_numpy(), norm2.to_numpy()
            points, anchors = (np.zeros((len(dims), len(pivots.p))) for _ in range(2))
            for size in np.unique(dims):
                at = np.flatnonzero(dims == size)
                x = _matrix(v.take(pa.array(at)))
                points[at], anchors[at] = (pivots.distances(x, norms[at], own) for own in (True, False))
            lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))
            return {"row": row, "vec_id": vec_id, "label": label, "dim": dim, "v": v, "norm2": norm2, "cell": points.argmin(1), "d": lists(points), "q": lists(anchors)}

        return work

    found = by_batch(rows.select("row", "vec_id", "label", "dim", "v", "norm2"), "row long, vec_id long, label long, dim int, v array<double>, norm2 double, cell int, d array<double>, q array<double>", make)
    return stored(found, "pivot-table"), most or 0.0


def exact(a: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Integer inner products: in doubles while a hundredfold is exact there, else in Python's integers."""
    if most < 1 << 46:
        return a @ x.T
    whole = np.frompyfunc(int, 1, 1)
    return whole(a).dot(whole(x).T)


def _first(ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """The places of the n best, ties by id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:n], np.int64)
    if len(scores) > 4 * n:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
        return near[np.lexsort((ids[near], -scores[near]))[:n]]
    return np.lexsort((ids, -scores))[:n]


class Chunk:
    """Rows of one chunk, that anchors are held against."""

    def __init__(self, parts: list[pa.RecordBatch], m2: float):
        batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        get = lambda name: batch.column(name)
        self.m2, self.row, self.label = m2, get("row").to_numpy(), get("label").to_numpy()
        self.none = get("vec_id").is_null().to_numpy(zero_copy_only=False)
        self.ids = get("vec_id").fill_null(LONG_MOST).to_numpy()
        self.x, self.d, self.norm2 = _matrix(get("v")), _matrix(get("d")), get("norm2").to_numpy()
        self.longest = float(np.sqrt(self.norm2.max()))

    def hits(self, batch: pa.RecordBatch, same: bool, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Anchor, wanted score, places in the chunk and their scores: the n best for each of an anchor's wants.

        same: rows of the anchor's label, from the least score on; else rows of other labels with LOW to HIGH percent of the wanted score, from least on.
        """
        get = lambda name: batch.column(name)
        a, q, norm2 = _matrix(get("v")), _matrix(get("d")), get("norm2").to_numpy()
        want, least = get("want").to_pylist(), get("least").to_pylist()
        low = np.array([min(x) for x in least], np.float64)
        high = np.array([max(x) * HIGH / 100 if x else np.inf for x in want], np.float64) if not same else np.full(len(low), np.inf)
        sums = norm2[:, None] + self.m2
        slack = 1e-9 * sums + 1
        with np.errstate(invalid="ignore", over="ignore"):
            gap = np.zeros((len(a), len(self.x)))
            for j in range(q.shape[1]):
                np.maximum(gap, np.abs(q[:, j, None] - self.d[:, j]), out=gap)
            out = (sums - gap * gap) / 2 + slack < low[:, None]  # brackets that don't reach; what is no number is never out
            if not same:
                reach = np.full(gap.shape, np.inf)
                for j in range(q.shape[1]):
                    np.minimum(reach, q[:, j, None] + self.d[:, j], out=reach)
                out |= (sums - reach * reach) / 2 - slack > high[:, None]
        row, label = get("row").to_numpy(), get("label").to_numpy()
        fit = ~out & ((row[:, None] != self.row) if same else (label[:, None] != self.label))
        some = np.flatnonzero(fit.any(0))
        if not len(some):
            return
        scores = exact(a, self.x[some], float(np.sqrt(norm2.max())) * self.longest)
        fit = fit[:, some]
        for k in np.flatnonzero(fit.any(1)):
            at = np.flatnonzero(fit[k])
            s = scores[k, at]
            for w, l in zip(want[k] or [0], least[k], strict=True):
                good = (s >= l) if same else (s >= l) & (100 * s >= LOW * w) & (100 * s <= HIGH * w)
                if good.any():
                    best = np.flatnonzero(good)
                    best = best[_first(self.ids[some[at[best]]], s[best], n)]
                    yield int(row[k]), w, some[at[best]], s[best]


_KEY = ["dim", "part", "cell", "chunk"]
_HIT = "anchor long, want long, vec_id long, score long"


def met(members: DataFrame, visitors: DataFrame, m2: float, same: bool, n: int) -> DataFrame:
    """members and visitors (both with dim, part, cell, chunk) -> anchor, want, vec_id, score: of each chunk the n best for what its visitors want."""
    prepare(members.sparkSession)
    schema, none = arrow_schema(_HIT), F.lit(None).cast("array<long>")
    here = members.select(*_KEY, F.lit(0).alias("side"), "row", "vec_id", "label", "v", "norm2", "d", none.alias("want"), none.alias("least"))
    there = visitors.select(*_KEY, F.lit(1).alias("side"), "row", "vec_id", "label", "v", "norm2", F.col("q").alias("d"), "want", "least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, chunk = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)], 1)
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
            for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                key, side = tuple(keys[a, :4]), keys[a, 4]
                if key != now:
                    now, parts, chunk = key, [], None
                if side == 0:
                    parts.append(batch.slice(a, b - a))
                    continue
                if not parts:
                    continue
                chunk = chunk or Chunk(parts, m2)
                for c in range(a, b, VISITORS):
                    found = list(chunk.hits(batch.slice(c, min(VISITORS, b - c)), same, n))
                    if found:
                        sizes = [len(x[2]) for x in found]
                        at = np.concatenate([x[2] for x in found])
                        scores = [max(LONG_LEAST, min(LONG_MOST, int(s))) for x in found for s in x[3]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in found], sizes)), pa.array(np.repeat([x[1] for x in found], sizes), pa.int64()), pa.array(chunk.ids[at], mask=chunk.none[at]), pa.array(scores, pa.int64())], schema=schema)

    both = here.unionByName(there)
    return both.repartition(*_KEY).sortWithinPartitions(*_KEY, "side").mapInArrow(run, _HIT)


def _spans(points: DataFrame) -> DataFrame:
    """Of each cell (dim, part, cell): the number of its chunks, and the range of its rows' distances to each pivot."""
    ranges = [F.array(*(f(F.get("d", F.lit(j))) for j in range(PIVOTS))).alias(name) for name, f in (("lo", F.min), ("hi", F.max))]
    return points.groupBy("dim", "part", "cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("n"), *ranges)


def _dealt(points: DataFrame, part: Column) -> tuple[DataFrame, DataFrame]:
    points = points.withColumn("part", part)
    spans = stored(_spans(points), "cells")
    chunk = F.pmod(F.xxhash64("row"), F.col("n")).cast("int")
    return points.join(spans.select("dim", "part", "cell", "n"), ["dim", "part", "cell"]).withColumn("chunk", chunk).drop("n"), spans


def _visits(anchors: DataFrame, spans: DataFrame, m2: float) -> DataFrame:
    """anchors in all chunks of their part whose cell's range can hold a score of their least."""
    away = F.array_max(F.transform(F.arrays_zip("q", "lo", "hi"), lambda z: F.greatest(z["lo"] - z["q"], z["q"] - z["hi"], F.lit(0.0))))
    reach = (F.col("norm2") + m2 - away * away) / 2 + 1e-9 * (F.col("norm2") + m2) + 1
    own = anchors.drop("cell", "chunk").join(spans, ["dim", "part"])
    kept = own.where(~F.coalesce(reach < F.array_min("least"), F.lit(False)))  # an unknown reach is none that falls short
    return kept.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))


def hard_negatives(df: DataFrame, anchor: Column, label: Column | None = None) -> DataFrame:
    """df (vec_id, label, embedding) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score. label: takes the column's place."""
    points, m2 = pivot_table(quantised(df if label is None else df.withColumn("label", label)))
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last()]
    any_score = F.array(F.lit(LONG_LEAST))
    # positives: first in a chunk of the anchor's own cell, then wherever the fifth best score of there can be beaten
    own, spans = _dealt(points, F.col("label"))
    anchors = stored(own.where(anchor).withColumn("want", F.lit(None).cast("array<long>")), "anchors")
    near = met(own, anchors.withColumn("least", any_score), m2, True, POSITIVES)
    bounds = near.groupBy("anchor").agg(F.count("*").alias("_n"), F.min("score").alias("_least")).where(F.col("_n") == POSITIVES)
    bound = anchors.join(bounds.select(F.col("anchor").alias("row"), "_least"), "row", "left").withColumn("least", F.array(F.coalesce("_least", F.lit(LONG_LEAST))))
    far = met(own, _visits(bound.drop("_least"), spans, m2), m2, True, POSITIVES)
    w = Window.partitionBy("anchor").orderBy(*order)
    positives = stored(far.withColumn("place", F.row_number().over(w)).where(F.col("place") <= POSITIVES).select("anchor", F.col("vec_id").alias("positive_id"), "place", F.col("score").alias("want")), "positives")
    # negatives: the same, each positive's score with a threshold of its own
    every, spans = _dealt(points, F.lit(0).cast("long"))
    wants = positives.where("want >= 0").select("anchor", "want").distinct()
    half = F.expr(f"want div 100 * {LOW}")  # no more than the share itself, which is tested exactly
    first = wants.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("want", half.alias("least")))).alias("_w"))

    def asking(w: DataFrame) -> DataFrame:
        return every.join(w.select(F.col("anchor").alias("row"), F.col("_w.want").alias("want"), F.col("_w.least").alias("least")), "row")

    near = met(every, asking(first), m2, False, NEGATIVES)
    bounds = near.groupBy("anchor", "want").agg(F.count("*").alias("_n"), F.min("score").alias("_least")).where(F.col("_n") == NEGATIVES).drop("_n")
    second = wants.join(bounds, ["anchor", "want"], "left").groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("want", F.coalesce("_least", half).alias("least")))).alias("_w"))
    far = met(every, _visits(asking(second), spans, m2), m2, False, NEGATIVES)
    w = Window.partitionBy("anchor", "want").orderBy(*order)
    negatives = far.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= NEGATIVES)
    found = positives.join(negatives, ["anchor", "want"]).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("want").alias("positive_score"), F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every 50th vector its positives' hard negatives; every 7th vector's label is moved on by one first."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0, moved)


ORACLE_SQL = """
WITH fit AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), rows AS (SELECT *, row_number() OVER () AS id FROM fit
), scored AS (
  SELECT a.id, a.vec_id AS anchor_id, b.id AS other, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT id, anchor_id, vec_id AS positive_id, other, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id) <= 5
), found AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.id, p.other ORDER BY score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
  FROM positives p JOIN scored s ON s.id = p.id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3
"""
