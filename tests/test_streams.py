"""Streams against the batch forms, rows in any order of arrival, some behind the watermark."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from fathomline.operators import converse
from fathomline.streaming import session

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def run(spark, tmp_path, batches, schema, operator, name):
    """One file, and so one micro-batch, for each of batches."""
    source = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source / f"{k:03d}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = operator(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.table(name)


def shuffled(rows, seed, reach):
    """Rows in an order of arrival that is at most `reach` seconds behind that of time, in batches."""
    r = random.Random(seed)
    order = sorted(rows, key=lambda x: x[2].timestamp() + r.uniform(0, reach))
    return [order[k : k + 40] for k in range(0, len(order), 40)]


def test_memory_in_any_order(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"s{r.randrange(5)}", k, at(k * 40 + r.uniform(0, 30)), r.choice([None, "", "x", "y"]), r.random() < 0.5) for k in range(160)]
    rows += [(s, 10_000 + k, at(1_000_000), None, False) for k, s in enumerate(("end", "end2"))]  # moves the watermark past all others
    schema = "session_id string, turn long, ts timestamp, scheme string, remembered boolean"
    got = run(spark, tmp_path, [*shuffled(rows[:-2], 3, 500), rows[-2:], [("end", 10_008, at(1_000_000), None, False)], [("s1", 1, at(5), "x", True)], [("end", 10_009, at(1_000_001), None, False)]], schema, lambda s: session.remembered_in_order(s, 600), "memory_in_order")
    want = converse.carried(spark.createDataFrame(rows[:-2], schema), ts="ts", ttl=600)
    same = lambda df: sorted((x["session_id"], x["turn"], x["ts"], x["scheme_used"]) for x in df.collect())
    found = [x for x in same(got) if x[1] < 10_000]
    assert [x[:3] for x in found] == [x[:3] for x in same(want)] and [x[3] or None for x in found] == [x[3] for x in same(want)]
    assert len({x[3] for x in found}) == 3


def test_admission_in_any_order(spark, tmp_path):
    r = random.Random(5)
    rows = [(f"c{r.randrange(3)}", k, at(r.uniform(0, 600))) for k in range(300)]
    rows += [("c0", 1000 + k, at(30)) for k in range(8)]  # ties
    schema = "client string, request long, ts timestamp"
    batches = [*shuffled(rows, 6, 200), [("end", 1, at(100_000))], [("end", 2, at(100_001))], [("c1", 5000, at(10))], [("end", 3, at(100_002))]]  # a watermark holds from the next batch on
    got = run(spark, tmp_path, batches, schema, lambda s: session.admitted_stream(s, 7), "admission_in_order")
    want = converse.admitted(spark.createDataFrame(rows, schema), "client", "ts", "request", 7)
    same = lambda df: sorted((x["client"], x["request"], x["ts"], x["minute"], x["admitted"]) for x in df.collect())
    found = same(got.where("client <> 'end'"))
    assert found == same(want) and {x[4] for x in found} == {True, False}
    assert got.where(F.col("request") == 5000).count() == 0


def test_gaps_count_to_the_nearest_second(spark, tmp_path):
    rows = [("a", 1, at(0.4), "x", True), ("a", 2, at(600.6), None, False), ("b", 1, at(0.6), "x", True), ("b", 2, at(601.4), None, False), ("c", 1, at(0.5), "x", True), ("c", 2, at(600.5), None, False)]
    schema, ends = "session_id string, turn long, ts timestamp, scheme string, remembered boolean", [[("end", 9, at(10_000 + k), None, False)] for k in range(3)]
    want = {(x["session_id"], x["turn"]): x["scheme_used"] for x in converse.carried(spark.createDataFrame(rows, schema), ts="ts", ttl=600).collect()}
    assert want == {("a", 1): "x", ("a", 2): None, ("b", 1): "x", ("b", 2): "x", ("c", 1): "x", ("c", 2): "x"}
    got = run(spark, tmp_path, [rows, *ends], schema, lambda s: session.remembered_in_order(s, 600), "memory_seconds")
    assert {(x["session_id"], x["turn"]): x["scheme_used"] for x in got.where("session_id <> 'end'").collect()} == want


def test_admission_runs_no_python(spark, tmp_path):
    got = session.admitted_stream(spark.readStream.schema("client string, request long, ts timestamp").parquet(str(tmp_path)))
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "State" not in plan and "PySpark" not in plan


def test_pending_rows_stay_until_they_are_due(spark, tmp_path):
    got = run(spark, tmp_path, [[("a", 1, at(0))], [("a", 2, at(30))]], "client string, request long, ts timestamp", session.admitted_stream, "admission_pending")
    assert got.count() == 0


@pytest.mark.parametrize("name", ["remembered_in_order", "admitted_stream"])
def test_streams_are_documented(name):
    assert "watermark" in getattr(session, name).__doc__
