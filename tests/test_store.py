"""The store's commits, and searches that workers run without a search path of their own."""

import contextlib
import io
import os
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fathomline.operators import retrieve
from fathomline.sources import shared, store

ROOT = str(Path(__file__).resolve().parent.parent)


def load_of(spark, ids, said):
    docs = spark.createDataFrame([(str(i), f"{said} {i}") for i in ids], "source_id string, title string")
    return docs, docs.select("source_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("n"), F.lit(said).alias("chunk_text"))


def said(spark, path, version=None):
    docs, chunks = store.current(spark, path, version)
    got = {r["source_id"]: r["title"].split()[0] for r in docs.collect()}
    rows = [(r["source_id"], r["n"], r["chunk_text"]) for r in chunks.collect()]
    assert sorted(rows) == sorted((i, n, s) for i, s in got.items() for n in (0, 1)) and docs.count() == len(got)
    return got


def plan(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def parts_of(path):
    return len(list(Path(path, "parts").iterdir()))


def test_failed_loads_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(ValueError):
        store.current(spark, path)
    docs, chunks = load_of(spark, range(9), "a")
    bad = F.raise_error(F.lit("lost")).cast("string")
    for x in ((docs.withColumn("title", bad), chunks), (docs, chunks.withColumn("chunk_text", bad))):
        with pytest.raises(Exception, match="lost"):
            store.load(*x, path)
        with pytest.raises(ValueError):
            store.current(spark, path)
    assert store.load(docs, chunks, path) == 0 and set(said(spark, path).values()) == {"a"}
    with pytest.raises(Exception, match="lost"):
        store.load(docs.withColumn("title", bad), chunks, path)
    assert store.load(*load_of(spark, range(5, 12), "b"), path) == 1
    assert said(spark, path) == {str(i): "a" if i < 5 else "b" for i in range(12)}
    assert said(spark, path, 0) == {str(i): "a" for i in range(9)}
    assert store.vacuum(spark, path, keep=2) == 1 and said(spark, path, 0)["7"] == "a"


def test_two_writers_and_compaction(spark, tmp_path):
    path = str(tmp_path / "store")
    a, b = (store.written(*load_of(spark, ids, name), path, 4) for ids, name in ((range(6), "a"), (range(4, 8), "b")))
    assert store.commit(spark, path, b) == 0 and store.commit(spark, path, a) == 1
    assert said(spark, path) == {str(i): "a" if i < 6 else "b" for i in range(8)}
    # a writer that has read version 1 loses version 2 to another, and takes the next
    seen = store.snapshot(spark, path)
    assert store.load(*load_of(spark, [0], "c"), path) == 2
    assert not store._recorded(spark, path, seen | {"version": 2}) and not [p for p in Path(path, "log").glob(".*") if p.suffix != ".crc"]
    # of a load that is committed while a compaction writes, rows stay the later ones
    old = tuple(p["name"] for p in store.snapshot(spark, path)["parts"])
    whole = store.written(*store.current(spark, path), path, 4)
    store.load(*load_of(spark, [1], "d"), path)
    store.commit(spark, path, whole, old)
    want = {str(i): {0: "c", 1: "d"}.get(i, "a" if i < 6 else "b") for i in range(8)}
    assert said(spark, path) == want and len(store.snapshot(spark, path)["parts"]) == 2
    with pytest.raises(store.Conflict):
        store.commit(spark, path, whole, old)
    version = store.compact(spark, path)
    assert store.compact(spark, path) == version and said(spark, path) == want
    docs, _ = store.current(spark, path)
    assert len({f.split("/parts/")[1].split("/")[0] for f in docs.inputFiles()}) == 1
    store.vacuum(spark, path)
    assert parts_of(path) == 1 and said(spark, path) == want


def test_lookups_open_one_bucket(spark, tmp_path):
    path = str(tmp_path / "store")
    store.load(*load_of(spark, range(200), "a"), path)
    store.load(*load_of(spark, range(50), "b"), path)
    store.compact(spark, path)
    for p in store.snapshot(spark, path)["parts"]:  # as another session finds the store
        for kind in store.KINDS:
            spark.sql(f"DROP TABLE {store._name(p['name'], kind)}")
    docs, chunks = store.current(spark, path)
    one = store.source(docs, "7")
    mine = docs.where("source_id = '7'").select(F.input_file_name()).first()[0]
    assert one.first()["title"] == "b 7" and "EqualTo(source_id,7)" in plan(one)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = docs.join(chunks, "source_id")
        assert joined.count() == 400 and "Exchange" not in plan(joined, "simple") and "Join" in plan(joined, "simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    others = [f for f in docs.inputFiles() if Path(f).name.split("_")[1:2] != Path(mine).name.split("_")[1:2]]
    assert len(others) > 10 and store.source(docs, "none").count() == 0
    for f in others:  # the lookup does without the other buckets' files
        Path(f.removeprefix("file:")).unlink()
    assert store.source(docs, "7").first()["title"] == "b 7"
    with pytest.raises(Exception, match="does not exist"):
        docs.where("title = 'b 7'").collect()


def test_a_source_with_most_chunks(spark, tmp_path):
    docs = spark.createDataFrame([("hot", "t"), ("x", "t")], "source_id string, title string")
    chunks = spark.range(5000).select(F.when(F.col("id") < 4990, "hot").otherwise("x").alias("source_id"), F.col("id"), F.lit("none").alias("chunk_text"))
    path = str(tmp_path / "store")
    store.load(docs, chunks.unionByName(spark.createDataFrame([("without", 1, "x")], "source_id string, id long, chunk_text string")), path)
    assert {r["source_id"]: r["count"] for r in store.current(spark, path)[1].groupBy("source_id").count().collect()} == {"hot": 4990, "x": 10}


def rows_of(spark, n=300, key="chunk_id"):
    v = F.array(*((F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 500 - 1) for k in range(6)))
    return spark.range(n).select(F.col("id").alias(key), v.alias("embedding"), F.concat(F.lit("s"), F.col("id") % 3).alias("scheme")).repartition(7)


def test_levels_give_the_same(spark):
    rows, asked = rows_of(spark), rows_of(spark, 9, "query_id").withColumnRenamed("embedding", "qvec")
    got = [sorted(map(tuple, retrieve.knn_batch(rows, asked, 5, min_similarity=-1.0, depth=d).collect())) for d in (1, 2, 3)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 45
    one = [(r["chunk_id"], round(r["similarity"], 12)) for r in retrieve.knn(rows, asked.where("query_id = 4").first()["qvec"], 5, min_similarity=-1.0).collect()]
    assert sorted(one) == [(x[1], x[2]) for x in got[0] if x[0] == 4] and [x[1] for x in one] == sorted((x[1] for x in one), reverse=True)


def test_keys_of_any_type(spark):
    asked = spark.createDataFrame([(Decimal("1.50"), [1.0, 0.0])], "`query id` decimal(10,2), qvec array<double>")
    rows = spark.createDataFrame([(Decimal(k) if k else None, (k, "x"), [1.0, k / 10.0]) for k in (3, 2, 0, 0, 7)], "a decimal(12,2), b struct<x: int, y: string>, embedding array<double>")
    found = retrieve.knn_batch(rows, asked, 3, key="a", query_key="query id")
    assert found.columns == ["query id", "a", "similarity", "rank"] and [(r["a"], r["rank"]) for r in found.orderBy("rank").collect()] == [(None, 1), (None, 2), (Decimal(2), 3)]
    found = retrieve.knn_batch(rows, asked, 0, key="b", query_key="query id").collect()
    assert [(r["b"], r["rank"]) for r in found] == [((0, "x"), 1)]
    assert retrieve.knn_batch(rows, asked.limit(0), 3, key="a", query_key="query id").columns == ["query id", "a", "similarity", "rank"]


def test_a_filter_opens_its_folders(spark, tmp_path):
    rows = retrieve.laid_out(rows_of(spark), str(tmp_path / "by"))
    asked = rows_of(spark, 2, "query_id").select("query_id", F.col("embedding").alias("qvec"), F.lit("s1").alias("q_scheme"))
    found = retrieve.knn_batch(rows, asked, 4, ("scheme",), min_similarity=-1.0)
    text = plan(found)
    assert "PartitionFilters" in text and "scheme" in text.split("PartitionFilters")[1].split("\n")[0] and "s1" in text.split("PartitionFilters")[1].split("\n")[0]
    plainly = retrieve.knn_batch(rows_of(spark), asked, 4, ("scheme",), min_similarity=-1.0)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plainly.collect())) and {r["chunk_id"] % 3 for r in found.collect()} == {1}
    mixed = asked.unionAll(asked.withColumns({"query_id": F.col("query_id") + 10, "q_scheme": F.lit(None)}))
    assert {r["chunk_id"] % 3 for r in retrieve.knn_batch(rows, mixed, 9, ("scheme",), min_similarity=-1.0).where("query_id >= 10").collect()} == {0, 1, 2}


_ALONE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
from fathomline.queries import QUERIES
for name in {names!r}:
    print(name, len(QUERIES[name](spark, {small!r}).collect()))
"""


def test_workers_need_no_search_path(small, tmp_path):
    """The driver alone knows where the package lies, and it runs in another folder."""
    names = ["knn_batch_topk", "two_pass_merge", "embeddings_hashed", "search_hits", "topic_votes", "generated_answers", "rate_limit_stream"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", _ALONE.format(root=ROOT, shared=f"file://{tmp_path}/shared", small=small, names=names)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert [line.split()[0] for line in out.stdout.splitlines() if line.split()[1:] and int(line.split()[1]) > 0] == names


def test_clean_drops_tables(spark):
    df = shared.stored(spark.range(3), "numbers")
    assert df.count() == 3


def test_load_writes_texts_once(spark, small):
    """A load's chunks are written into the store alone, and its lines without their trimmed form."""
    from fathomline.queries import QUERIES

    tables = Path(shared.shared_dir(spark).removeprefix("file://")) / "tables" / spark.sparkContext.applicationId
    before = set(tables.glob("*"))
    assert QUERIES["ingestion"](spark, small).where("status = 'ok'").count()
    new = {p.name.rsplit("-", 1)[0]: p for p in set(tables.glob("*")) - before}
    assert "chunks" not in new and {"store", "page-lines", "counts"} <= set(new)
    assert spark.read.parquet(f"file://{new['page-lines']}").schema["lines"].dataType.elementType.names == ["line_no", "line", "heading"]
