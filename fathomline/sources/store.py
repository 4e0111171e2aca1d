"""The store of documents and chunks that loads are written to, and lookups in it.

Below the store's path:

* `parts/<unique>/documents` and `.../chunks`: what one attempt of a load wrote, as tables bucketed by a hash of source_id, with Bloom filters of it.
* `log/<version>.json`: one record for each commit, which names all parts that count, each with the number of its load. The highest version is the store.

A load writes its part first and its record last, by a rename that fails where the version exists, so an attempt that fails leaves nothing that counts and
nothing that blocks. Of two writers the later to commit takes the next version: its load is the later one, whichever began first. A source's rows are those of
the last load that has a document of it. compact() writes what counts as one part, and its record drops the parts that this replaces.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import dealt, scratch, shared_dir, stored  # noqa: F401  (part of this module's interface)

#: Buckets of a part, unless a load says otherwise; about one for each few hundred MB of chunks.
BUCKETS = 16
KINDS = ("documents", "chunks")


class Conflict(Exception):
    """Another writer has replaced a part that a compaction wanted to replace."""


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    return jvm, at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    _, log, fs = _files(spark, f"{path}/log")
    names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The record of a version (by default the last): version, and parts with name, load, buckets and schemas. Version -1 is the empty store."""
    if version is None:
        version = max(_versions(spark, path), default=-1)
    if version < 0:
        return {"version": -1, "parts": []}
    return json.loads(spark.read.text(f"{path}/log/{version:020d}.json", wholetext=True).first()[0])


def _recorded(spark: SparkSession, path: str, record: dict) -> bool:
    """Writes a record unless its version exists: to a name of its own, then by a rename that never replaces."""
    jvm, log, fs = _files(spark, f"{path}/log")
    fs.mkdirs(log)
    draft, final = (jvm.Path(log, n) for n in (f".{uuid.uuid4().hex}", f"{record['version']:020d}.json"))
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(record).encode()))
    out.close()
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.FileContext.getFileContext(log.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, final, none)
    except Py4JJavaError as x:
        fs.delete(draft, False)
        if "FileAlreadyExists" in x.java_exception.getClass().getName():
            return False
        raise
    return True


def _name(part: str, kind: str) -> str:
    return f"fathomline_{part}_{kind}"


def begun(buckets: int = BUCKETS) -> dict:
    """A part without tables."""
    return {"name": uuid.uuid4().hex, "buckets": buckets}


def put(df: DataFrame, path: str, part: dict, kind: str) -> DataFrame:
    """Writes a part's documents or chunks, dealt by source, and reads them back; the partition of a source with very many chunks is split again before it is written."""
    out = df.hint("rebalance", part["buckets"], "source_id").write.format("parquet").bucketBy(part["buckets"], "source_id").sortBy("source_id").option("parquet.bloom.filter.enabled#source_id", "true")
    out.option("path", f"{path}/parts/{part['name']}/{kind}").saveAsTable(_name(part["name"], kind))
    part[kind] = df._jdf.schema().toDDL()
    return df.sparkSession.table(_name(part["name"], kind))


def written(documents: DataFrame, chunks: DataFrame, path: str, buckets: int = BUCKETS) -> dict:
    """Writes documents (source_id, ...) and chunks (source_id, ...) as a part that doesn't count before commit() names it."""
    part = begun(buckets)
    chunks = chunks.join(documents.select("source_id"), "source_id", "left_semi").select(*chunks.columns)  # what has no document doesn't count
    put(documents, path, part, "documents")
    put(chunks, path, part, "chunks")
    return part


def commit(spark: SparkSession, path: str, part: dict, replaced: tuple[str, ...] = ()) -> int:
    """Makes a part count, in place of others if it is a compaction; the version. Tried again on top of what other writers commit meanwhile."""
    while True:
        now = snapshot(spark, path)
        version, gone = now["version"] + 1, [p for p in now["parts"] if p["name"] in replaced]
        if len(gone) != len(replaced):
            raise Conflict(f"of {len(replaced)} parts {len(replaced) - len(gone)} were replaced by another writer")
        load_ = max((p["load"] for p in gone), default=version)
        parts = sorted([p for p in now["parts"] if p["name"] not in replaced] + [part | {"load": load_}], key=lambda p: p["load"])
        if _recorded(spark, path, {"version": version, "parts": parts}):
            return version


def load(documents: DataFrame, chunks: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Writes a load of documents (source_id, ...) and their chunks (source_id, ...) into the store at path; its version.

    Loading twice gives what loading once gives; a source without documents in a load keeps its old rows; a load that fails leaves what was there.
    """
    return commit(documents.sparkSession, path, written(documents, chunks, path, buckets))


def _part(spark: SparkSession, path: str, part: dict, kind: str) -> DataFrame:
    name = _name(part["name"], kind)
    try:
        return spark.table(name)
    except AnalysisException as x:
        if x.getCondition() != "TABLE_OR_VIEW_NOT_FOUND":
            raise
    location = f"{path}/parts/{part['name']}/{kind}".replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({part[kind]}) USING parquet CLUSTERED BY (source_id) SORTED BY (source_id) INTO {part['buckets']} BUCKETS LOCATION '{location}'")
    return spark.table(name)


def current(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks of the store at path, each source as its latest load left it; or as a version left it.

    After compaction that is a scan of one part. Else each part loses the sources that later parts have; only these sources' names are dealt anew.
    """
    parts = snapshot(spark, path, version)["parts"]
    if not parts:
        raise ValueError(f"nothing was loaded into {path}")
    out, newer = [None, None], None
    for part in reversed(parts):
        for k, kind in enumerate(KINDS):
            rows = _part(spark, path, part, kind)
            if newer is not None:
                rows = rows.join(newer, "source_id", "left_anti")
            out[k] = rows if out[k] is None else out[k].unionByName(rows, allowMissingColumns=True)
        own = _part(spark, path, part, "documents").select("source_id")
        newer = own if newer is None else newer.unionAll(own)
    return out[0], out[1]


def compact(spark: SparkSession, path: str, buckets: int | None = None) -> int:
    """Writes what counts as one part in place of the parts that there are; the version. Loads that are committed meanwhile stay later than it."""
    parts = snapshot(spark, path)["parts"]
    if len(parts) < 2 and (not parts or buckets in (None, parts[0]["buckets"])):
        return snapshot(spark, path)["version"]
    documents, chunks = current(spark, path)
    whole = written(documents, chunks, path, buckets or max(p["buckets"] for p in parts))
    return commit(spark, path, whole, tuple(p["name"] for p in parts))


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes parts that none of the last `keep` versions names, and older records; how many parts. Not while a load or a reader of old versions runs."""
    versions = _versions(spark, path)
    kept = {p["name"] for v in versions[-keep:] for p in snapshot(spark, path, v)["parts"]}
    _, root, fs = _files(spark, f"{path}/parts")
    gone = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName() not in kept] if fs.exists(root) else []
    for v in versions[:-keep]:
        at = _files(spark, f"{path}/log/{v:020d}.json")[1]
        fs.delete(at, False)
    for p in gone:
        for kind in KINDS:
            spark.sql(f"DROP TABLE IF EXISTS {_name(p.getName(), kind)}")
        fs.delete(p, True)
    return len(gone)


# ---- lookups over the documents of a store


def source(documents: DataFrame, source_id: str) -> DataFrame:
    """The document of a source, one row at most: one bucket is opened of each part, and of it the row groups whose Bloom filter has the source."""
    return documents.where(F.col("source_id") == source_id).limit(1)


LISTED = ["source_id", "title", "scheme", "organization", "document_type", "document_date", "effective_date", "source_url", "file_name"]


def listed(documents: DataFrame) -> DataFrame:
    """The columns of a list of documents, by scheme (those without one last), then source."""
    return documents.select(*LISTED).orderBy(F.col("scheme").asc_nulls_last(), "source_id")


def names(spark: SparkSession, values) -> DataFrame:
    """Names of a rule table (topics, schemes), sorted."""
    return spark.createDataFrame([(v,) for v in sorted(values)], "name string")


def topics(chunks: DataFrame) -> DataFrame:
    """The topics that occur in stored chunks, sorted."""
    return chunks.where(F.col("topic").isNotNull()).select(F.col("topic").alias("name")).distinct().orderBy("name")


def write_json(rows: DataFrame, path: str, field: str | None = None, **about: str) -> None:
    """rows as JSON lines; with a field as one JSON document of `about`, the number of rows and an array of them (for results that fit one file)."""
    if field is None:
        rows.write.json(path)
        return
    head = [F.lit(v).alias(k) for k, v in about.items()]
    rows.agg(F.to_json(F.struct(*head, F.count("*").alias("count"), F.collect_list(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias(field))).alias("value")).write.text(path)
