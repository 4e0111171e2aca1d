"""Exact filtered search by cosine, for one query or many, and the merge of two passes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import md5
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import ship, stored

#: Queries of one matrix product, and of one pass over the rows: the latter's vectors are all that a search sends to every task.
BLOCK, PASS = 1000, 16_000
#: Tasks of a search for each core of the cluster, however many pieces the rows lie in; and tasks whose hits are merged at once.
WAVES, FAN = 4, 64
#: Rows of one matrix product: what a worker holds at once is BLOCK x ROWS scores, whatever the size of a batch.
ROWS = 1024
#: Values of a filter that the scan is asked for by name; more are looked up by a join.
NAMED = 1000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def length(v: Column) -> Column:
    """Null for a null, empty or zero vector."""
    return F.nullif(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(0.0))


def knn(chunks: DataFrame, query: list[float], k: int = 8, filters: dict | None = None, min_similarity: float = 0.0, vector: str = "embedding", key: str = "chunk_id") -> DataFrame:
    """The k nearest rows of one query vector. Filters (null: none) reach the scan before anything is ranked; k below 1 counts as 1."""
    for column, value in (filters or {}).items():
        if value is not None:
            chunks = chunks.where(F.col(column) == value)
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    if not norm:
        return chunks.limit(0).withColumn("similarity", F.lit(0.0)).drop(vector)
    q = F.array(*(F.lit(float(x) / norm) for x in query))
    scored = chunks.where(F.size(vector) == len(query)).withColumn("similarity", dot(F.col(vector), q) / length(F.col(vector))).drop(vector)
    kept = scored.where(F.col("similarity").isNotNull() & ~F.isnan("similarity") & (F.col("similarity") >= min_similarity))
    return kept.orderBy(F.round("similarity", 12).desc(), key).limit(at_least_one(k))


def at_least_one(k: int | None) -> int:
    return max(k or 1, 1)


def knn_batch(chunks: DataFrame, queries: DataFrame, k: int = 8, filters: tuple[str, ...] = (), min_similarity: float = 0.0, vector: str = "embedding", key: str = "chunk_id", query_key: str = "query_id", depth: int | None = None) -> DataFrame:
    """The k nearest rows of each query (query_key, qvec and a column q_<name> for each filter; null there: no filter), with rank; ties (to twelve digits) by key.

    k below 1 counts as 1. Null keys are hits like others, the last of equals.

    A pass reads the rows once and holds up to PASS queries in every task: a matrix product for each block of them, the k best of each query kept in
    arrays. More queries than PASS, told off by a hash, take more passes. Where all queries of a pass have a filter, only rows with values that
    occur among them are read: of rows laid out by that column (see laid_out) only those files.

    Tasks are WAVES for each core at most, those of all passes together (but one for each pass), so that what they hand on grows with neither the rows nor, beyond
    k hits for each query, the queries; their hits are merged in levels of FAN: depth of them, by default as many as the tasks need.
    """
    spark, k = chunks.sparkSession, at_least_one(k)
    ship(spark)
    types = dict(chunks.dtypes) | {query_key: dict(queries.dtypes)[query_key]}
    tasks = WAVES * spark.sparkContext.defaultParallelism
    kept = chunks.where(F.col(vector).isNotNull())
    asked = queries.select(query_key, F.col("qvec").cast("array<double>").alias("qvec"), *(F.col(f"q_{f}").cast("string").alias(f"q_{f}") for f in filters))
    schema = f"`{query_key}` {types[query_key]}, `{key}` {types[key]}, similarity double, _task int"
    parts, found = max(1, -(-queries.count() // PASS)), None
    tasks = -(-tasks // parts)  # all passes run at once: together they are as many tasks, and hand on as many hits, as one
    for part in range(parts):
        rows = (asked if parts == 1 else asked.where(F.pmod(F.xxhash64(query_key), F.lit(parts)) == part)).toArrow()  # at most about PASS
        search = Search(rows, k, min_similarity, len(filters))
        if not search.names:
            continue
        scan = _wanted(kept, filters, rows).select(key, F.col(vector).cast("array<double>").alias(vector), *(F.col(f).cast("string").alias(f"f_{f}") for f in filters)).coalesce(tasks)
        shared = spark.sparkContext.broadcast(search)
        hits = scan.mapInArrow(lambda batches, shared=shared: shared.value.nearest(batches, [query_key, key, "similarity", "_task"]), schema)
        found = hits if found is None else found.unionAll(hits)
    if found is None:
        return spark.createDataFrame([], f"`{query_key}` {types[query_key]}, `{key}` {types[key]}, similarity double, rank int")
    levels = depth or max(1, math.ceil(math.log(tasks, FAN)))
    for level in range(levels - 1, -1, -1):
        # groups of tasks that become fewer by FAN, at last one
        group = [F.pmod("_task", F.lit(FAN**level)).alias("_group")] if level else []
        own = Window.partitionBy(query_key, *group).orderBy(F.col("similarity").desc(), F.col(key).asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return found.drop("_task")


def _wanted(rows: DataFrame, filters: tuple[str, ...], asked: pa.Table) -> DataFrame:
    """rows without those that no query of `asked` can want, by conditions that a scan can be pruned with."""
    for at, name in enumerate(filters, 2):
        values = set(asked.column(at).to_pylist())
        if None in values or not values:
            continue
        if len(values) <= NAMED:
            rows = rows.where(F.col(name).cast("string").isin(sorted(values)) if dict(rows.dtypes)[name] != "string" else F.col(name).isin(sorted(values)))
        else:
            have = rows.sparkSession.createDataFrame([(v,) for v in values], "_value string")
            rows = rows.join(have, F.col(name).cast("string") == F.col("_value"), "left_semi")
    return rows


def laid_out(chunks: DataFrame, path: str, by: str = "scheme") -> DataFrame:
    """Writes chunks to path in a folder for each value of `by`, and reads them back: a search that filters by it opens the folders of its values alone.

    Rows are dealt by the value; a value with very many rows is dealt to as many tasks, and files, as they need.
    """
    schema = chunks.schema
    chunks.hint("rebalance", by).write.partitionBy(by).parquet(path)
    return chunks.sparkSession.read.schema(schema).parquet(path).select(*schema.names)


def _sortable(keys: pa.Array) -> np.ndarray:
    """Keys as an array that sorts as they do, nulls last: numbers and strings as they are, others as tuples (of structs, by their fields)."""
    if not keys.null_count and (pa.types.is_integer(keys.type) or pa.types.is_floating(keys.type) or pa.types.is_string(keys.type)):
        return np.array(keys.to_pylist())
    return _tuples(keys.to_pylist())


def _tuples(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    for i, x in enumerate(values):
        out[i] = (x is None, tuple(x.items()) if isinstance(x, dict) else 0 if x is None else x)
    return out


def _unsorted(keys: np.ndarray, kind: pa.DataType) -> pa.Array:
    values = keys.tolist()
    return pa.array([None if none else dict(x) if pa.types.is_struct(kind) else x for none, x in values] if keys.dtype == object else values, kind)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if (a.dtype == object) != (b.dtype == object):
        a, b = (x if x.dtype == object else _tuples(x.ravel().tolist()).reshape(x.shape) for x in (a, b))
    return np.concatenate([a, b])


def _above(scores: np.ndarray, keys: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Of each column the scores that reach its least, and their rows' keys, moved up; as many rows as the fullest column has of them, none if there are none."""
    q, row = np.nonzero((scores.T >= least[:, None]) & (scores.T > -np.inf))
    if not len(q):
        return None
    n = np.bincount(q, minlength=scores.shape[1])
    place = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
    out, names = np.full((n.max(), scores.shape[1]), -np.inf), np.broadcast_to(keys[:1], (n.max(), scores.shape[1])).copy()
    out[place, q], names[place, q] = scores[row, q], keys[row]
    return out, names


class Search:
    """Queries of one pass, in blocks, and the search of a task's rows for the k nearest of each."""

    def __init__(self, rows: pa.Table, k: int, least: float, n_filters: int):
        self.k, self.least = k, least
        vectors = [(i, np.array(v, np.float64)) for i, v in enumerate(rows.column(1).to_pylist()) if v and all(x is not None for x in v) and any(v)]
        by_size: dict[int, list] = {}
        for i, v in vectors:
            by_size.setdefault(len(v), []).append((i, v / np.linalg.norm(v)))
        self.blocks = []  # places among the queries, unit vectors, what each filter wants
        wanted = [np.array(rows.column(2 + f).to_pylist(), object) for f in range(n_filters)]
        for group in by_size.values():
            for at in range(0, len(group), BLOCK):
                who = np.array([i for i, _ in group[at : at + BLOCK]])
                self.blocks.append((who, np.stack([v for _, v in group[at : at + BLOCK]]), [w[who] for w in wanted]))
        self.keys, self.names = rows.column(0), [i for i, _ in vectors]

    def nearest(self, batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, ROWS):
                self._add(batch.slice(at, ROWS), best)
        every = self.keys.combine_chunks()
        for b in list(best):
            scores, keys = best.pop(b)
            rank, q = np.nonzero(scores > -np.inf)
            if len(q):
                task = pa.array(np.full(len(q), TaskContext.get().partitionId(), np.int32))
                yield pa.RecordBatch.from_arrays([every.take(pa.array(self.blocks[b][0][q])), _unsorted(keys[rank, q], kind), pa.array(scores[rank, q]), task], names=columns)

    def _add(self, batch: pa.RecordBatch, best: dict) -> None:
        size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        for b, (_, q, wanted) in enumerate(self.blocks):
            fit = np.flatnonzero(size == q.shape[1])
            if not len(fit):
                continue
            part = batch if len(fit) == batch.num_rows else batch.take(pa.array(fit))
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(fit), -1)
            with np.errstate(invalid="ignore", divide="ignore"):
                s = (x / np.linalg.norm(x, axis=1)[:, None]) @ q.T
            s[~(s >= self.least)] = -np.inf  # those that are no number, too
            for f, want in enumerate(wanted):
                have = np.array(part.column(2 + f).to_pylist(), object)
                values, code = np.unique(np.array([v for v in want if v is not None], str), return_inverse=True)
                codes = np.full(len(want), -1)
                codes[[v is not None for v in want]] = code
                place = {v: i for i, v in enumerate(values.tolist())}
                mine = np.array([place.get(v, -2) for v in have])
                s[(codes >= 0) & (mine[:, None] != codes)] = -np.inf
            keys = _sortable(part.column(0))
            if b not in best:
                best[b] = self._top(s, np.broadcast_to(keys[:, None], s.shape))
                continue
            had = best[b]
            least = had[0][-1] - 1e-11 if len(had[0]) == self.k else np.full(s.shape[1], -np.inf)
            new = _above(s, keys, least)
            if new is not None:
                best[b] = self._top(*(_joined(*x) for x in zip(had, new, strict=True)))

    def _top(self, scores: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each column the k best, ties (to twelve digits) by key; every row that ties with the last of them is looked at."""
        if len(scores) > self.k:
            cut = np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k] - 1e-12
            most = int((scores >= cut).sum(0).max()) if np.isfinite(cut).all() else int(((scores >= cut) & (scores > -np.inf)).sum(0).max())
            most = max(self.k, min(most, len(scores)))
            near = np.argpartition(-scores, most - 1, axis=0)[:most] if most < len(scores) else None
            if near is not None:
                scores, keys = np.take_along_axis(scores, near, 0), np.take_along_axis(keys, near, 0)
        scores = np.round(scores, 12)
        order = np.lexsort((keys, -scores), axis=0)[: self.k]
        return np.take_along_axis(scores, order, 0), np.take_along_axis(keys, order, 0)


def merged(first: DataFrame, own: DataFrame, query_key: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """Hits of two passes as one row for each query and row, with the pass that found it first and its similarity."""
    both = first.withColumn("pass", F.lit(1)).unionByName(own.withColumn("pass", F.lit(2)), allowMissingColumns=True)
    return both.groupBy(query_key, key).agg(F.min("pass").alias("pass"), F.max("similarity").alias("similarity"))


def in_scope(scheme: Column, query_scheme: Column) -> Column:
    """Rows of another scheme than the query's are out; those of none, and all where the query has none, are in."""
    return query_scheme.isNull() | (F.coalesce(scheme, F.lit("")) == "") | (scheme == query_scheme)


def two_pass(chunks: DataFrame, queries: DataFrame, k: int, scheme: str = "scheme", query_key: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """chunks (key, scheme, embedding, ...) and queries (query_key, qvec, q_<scheme>, ...) -> merged hits with the columns of both (but the vectors), in scope.

    The first pass takes the k nearest of all, the second as many of the query's own scheme. The queries are written once, as both passes and a join read them.
    """
    queries = stored(queries, "queries")
    hits = merged(*passes(chunks, queries, k, scheme, query_key, key), query_key, key)
    rows = hits.join(chunks.drop("embedding"), key).join(queries.drop("qvec"), query_key)
    return rows.where(in_scope(F.col(scheme).cast("string"), F.col(f"q_{scheme}").cast("string")))


def passes(chunks: DataFrame, queries: DataFrame, k: int, scheme: str = "scheme", query_key: str = "query_id", key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """The hits of two_pass's passes, as keys and similarity alone."""
    wish = f"q_{scheme}"
    first = knn_batch(chunks, queries.select(query_key, "qvec"), k, key=key, query_key=query_key)
    own = knn_batch(chunks, queries.where(F.col(wish).isNotNull()).select(query_key, "qvec", wish), k, (scheme,), key=key, query_key=query_key)
    return first.drop("rank"), own.drop("rank")


def scoped_hits(chunks: DataFrame, queries: DataFrame, k: int, document: str = "document_id", scheme: str = "scheme", query_key: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """two_pass's hits without texts: the queries' columns (but the vector), key, document, scheme, pass, similarity, and whether a query has `several` of the document.

    queries are read more than once: a table. A hit is a few numbers here, so what is shuffled doesn't grow with the texts' length.
    """
    first, own = passes(chunks, queries, k, scheme, query_key, key)
    both = first.withColumn("pass", F.lit(1)).unionByName(own.withColumn("pass", F.lit(2)))
    known = both.join(chunks.select(key, document, scheme), key).groupBy(query_key, key, document, scheme).agg(F.min("pass").alias("pass"), F.max("similarity").alias("similarity"))
    rows = known.join(queries.drop("qvec"), query_key).where(in_scope(F.col(scheme).cast("string"), F.col(f"q_{scheme}").cast("string")))
    return rows.withColumn("several", F.count(F.lit(1)).over(Window.partitionBy(query_key, document)) > 1)


def overfetch(top_k: int) -> int:
    return max(6 * top_k, 36)


_models: dict[str, Callable] = {}


def embedding(text: Column, factory: Callable[[], Callable[[list[str]], np.ndarray]], dim: int = 384, batch: int = 32, name: str = "model") -> Column:
    """Vectors by a model, `batch` texts at a time. factory() gives the model, once for each worker process and name; a vector of another size is an error."""
    ship()

    @F.pandas_udf("array<double>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if name not in _models:
            _models[name] = factory()
        for texts in parts:
            out = []
            for at in range(0, len(texts), batch):
                block = [t or "" for t in texts[at : at + batch]]
                got = np.asarray(_models[name](block), np.float64)
                if got.shape != (len(block), dim):
                    raise ValueError(f"{len(block)} texts gave vectors of shape {got.shape}, not of {dim} numbers each")
                out += list(got)
            yield pd.Series(out, dtype=object)

    return embed(text)


class Hashed:
    """A deterministic stand-in for an embedding model: counts of words by a hash, as unit vectors (zeros without words)."""

    def __init__(self, dim: int = 384):
        self.dim, self.place = dim, _Places(dim)

    def __call__(self, texts: list[str]) -> np.ndarray:
        words = [text.lower().split() for text in texts]
        sizes = [len(w) for w in words]
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(words)), np.int64, sum(sizes))
        out = np.bincount(np.repeat(np.arange(len(texts)) * self.dim, sizes) + at, minlength=len(texts) * self.dim).reshape(len(texts), self.dim).astype(np.float64)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


class _Places(dict):
    """Places of words, worked out when they are first asked for."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        at = self[word] = int(md5(word.encode("utf-8", "replace")).hexdigest()[:8], 16) % self.dim
        return at


def hashed_embedding(text: Column, dim: int = 384) -> Column:
    return embedding(text, lambda: Hashed(dim), dim, name=f"hashed {dim}")
