"""What the training-data operators share: sessions, shared tables, Arrow loops."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, ship, stored, table  # noqa: F401  (the operators take them from here)

#: Rows and bytes of one Arrow batch; both bound a Python worker's memory.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Ships the package and bounds Arrow batches by rows and bytes, unless the session already has smaller bounds."""
    ship(spark)
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        now = (spark.conf.get(key) or "").lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The column as string, null as the empty text."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while wish.lower() in have:
        wish += "_"
    return wish


def draw_of(df: DataFrame, key: str = "doc_id", text: str = "text") -> Column:
    """A hash of key and text that samples are drawn by: rows of one key, or of none, fall apart by their texts, repeated rows together."""
    return F.xxhash64(df[key], df[text], df[key].isNull())


def sampled(df: DataFrame, n: int) -> DataFrame:
    """About n distinct rows of df (doc_id, text), or all; the same on every run. The number of distinct rows is estimated to some 2 %, in one scan."""
    draw = free_name(df, "_draw")
    marked = df.withColumn(draw, draw_of(df))
    every = marked.agg(F.approx_count_distinct(draw, 0.02)).first()[0]
    return marked.where(F.pmod(draw, F.lit(1 << 30)) < round(min(1.0, n / max(1, every)) * (1 << 30))).dropDuplicates([draw]).drop(draw)


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task, for one operator at a time: a worker that goes on to another drops it."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def by_batch(
    df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]]
) -> DataFrame:
    """mapInArrow where make() runs once for each task and what it returns turns a batch into columns."""
    target, owner = arrow_schema(schema), make.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(owner, dict)
        work = make()
        for batch in batches:
            if batch.num_rows:
                columns = work(batch)
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip((columns[f.name] for f in target), target, strict=True)],
                    schema=target,
                )

    prepare(df.sparkSession)
    return df.mapInArrow(run, schema)


_ARROW = {
    "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
}


def _arrow_type(name: str) -> pa.DataType:
    name = name.strip()
    if name.startswith("array<"):
        return pa.list_(_arrow_type(name[6:-1]))
    return _ARROW[name]


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string of the types above and arrays of them."""
    fields = []
    for part in ddl.split(","):
        name, kind = part.strip().split(None, 1)
        fields.append(pa.field(name.strip("`"), _arrow_type(kind)))
    return pa.schema(fields)


def fixed(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of values of `width` bytes as rows of them."""
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int32, n + 1, 4 * column.offset)
    return np.frombuffer(column.buffers()[2], np.uint8, ends[-1] - ends[0], ends[0]).reshape(n, width)


def cells(x: np.ndarray) -> pa.Array:
    """Rows of numbers as a binary column."""
    x = np.ascontiguousarray(x)
    n, width = len(x), x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(x.tobytes())])


def hashed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers, mixed one to one."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))
