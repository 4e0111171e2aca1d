"""Operators, sources, plans and streams over hand-made tables."""

import datetime

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline.operators import converse, corpus, evaluate, rerank, retrieve
from fathomline.plans import lifecycle
from fathomline.sources import files
from fathomline.streaming import session

def as_of():
    return F.lit("2024-01-01").cast("date")


def test_knn_edge_vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.0, 0.0], "a"), (3, None, "a"), (4, [-1.0, 0.0], "a"), (5, [1.0, 1.0], "b"), (6, [2.0, 0.0], "a"), (7, [1.0], "a")]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, scheme string")
    assert [r["chunk_id"] for r in retrieve.knn(df, [1.0, 0.0]).collect()] == [1, 6, 5]
    assert [r["chunk_id"] for r in retrieve.knn(df, [1.0, 0.0], 0).collect()] == [1]
    assert [r["chunk_id"] for r in retrieve.knn(df, [1.0, 0.0], filters={"scheme": "b"}).collect()] == [5]
    assert retrieve.knn(df, [0.0, 0.0]).count() == 0
    q = spark.createDataFrame([(10, [1.0, 0.0], None), (11, [0.0, 1.0], "b"), (12, [0.0, 0.0], None)], "query_id long, qvec array<float>, q_scheme string")
    got = [(r["query_id"], r["chunk_id"], r["rank"]) for r in retrieve.knn_batch(df, q, 2, ("scheme",)).orderBy("query_id", "rank").collect()]
    assert got == [(10, 1, 1), (10, 6, 2), (11, 5, 1)]
    assert retrieve.knn_batch(df, q.limit(0), 2).count() == 0


def test_knn_blocks_equal_one_block(spark, monkeypatch):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 8)))], "chunk_id long, embedding array<double>")
    q = df.limit(30).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qvec"))
    whole = sorted(map(tuple, retrieve.knn_batch(df, q, 5).select("query_id", "chunk_id", "rank").collect()))
    monkeypatch.setattr(retrieve, "BLOCK", 7)
    assert sorted(map(tuple, retrieve.knn_batch(df, q, 5).select("query_id", "chunk_id", "rank").collect())) == whole and len(whole) == 150


def test_a_search_holds_scores_of_few_rows_at_once(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(retrieve.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 0})()))
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(12_000, 3)), 1)  # with ties
    q = x[:300]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["chunk_id", "embedding"])
    search = retrieve.Search(pa.table({"query_id": list(range(300)), "qvec": q.tolist()}), 7, 0.0, 0)
    tracemalloc.start()
    out = pa.Table.from_batches(search.nearest(iter([batch]), ["query_id", "chunk_id", "similarity", "_task"]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000 * 300 * 8
    with np.errstate(invalid="ignore"):
        s = (x / np.linalg.norm(x, axis=1)[:, None]) @ (q / np.linalg.norm(q, axis=1)[:, None]).T
    got = {}
    for row in out.to_pylist():
        got.setdefault(row["query_id"], []).append((row["similarity"], row["chunk_id"]))
    for k in range(300):
        if np.any(q[k]):
            best = sorted((v for v in s[:, k] if v >= 0), reverse=True)[:7]
            assert np.allclose(sorted((v for v, _ in got[k]), reverse=True), best, atol=1e-9) and all(abs(s[i, k] - v) < 1e-9 for v, i in got[k])


def test_passes_hand_on_as_many_hits_as_one(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "PASS", 5)
    df = spark.range(64, numPartitions=16).select(F.col("id").alias("chunk_id"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("embedding"))
    q = df.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qvec")).where("query_id % 2 = 0")
    found = retrieve.knn_batch(df, q, 3)
    assert found.count() == 96 and found.select("query_id", "chunk_id").distinct().count() == 96
    scans = [int(x) for x in __import__("re").findall(r"Coalesce (\d+)", found._jdf.queryExecution().sparkPlan().toString())]
    assert len(scans) == 7 and sum(scans) <= max(7, retrieve.WAVES * spark.sparkContext.defaultParallelism + 7)


def test_two_pass(spark):
    rows = [(k, [1.0, k / 10], s) for k, s in enumerate(["y", "y", "x", None, "x", ""])]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, scheme string")
    q = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [1.0, 0.0], None)], "query_id long, qvec array<double>, q_scheme string")

    def got(k):
        return {(r["query_id"], r["chunk_id"], r["pass"]) for r in retrieve.two_pass(df, q, k).collect()}

    assert got(2) == {(1, 2, 2), (1, 4, 2), (2, 0, 1), (2, 1, 1)}
    assert got(4) == {(1, 2, 1), (1, 3, 1), (1, 4, 2), (2, 0, 1), (2, 1, 1), (2, 2, 1), (2, 3, 1)}


def test_demotion_walks_kept_rows(spark):
    texts = ["aaa bbb ccc", "aaa bbb ccc", "aaa bbb ccc ddd", "xxx yyy zzz"]
    rows = [(1, k, "d", t, k + 1, 1 - k / 100) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, document_id string, chunk_text string, rank int, rerank_score double")
    got = [(r["chunk_id"], r["demoted"], r["rank"], r["rerank_score"]) for r in rerank.demoted(df).orderBy("chunk_id").collect()]
    assert got == [(0, False, 1, 1.0), (1, True, 3, 0.8712), (2, True, 4, 0.8624), (3, False, 2, 0.97)]


def test_freshness_and_overlap(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2025-01-01",), ("bad",), (None,), ("2010-01-01",)], "d string")
    assert [r[0] for r in df.select(rerank.freshness(F.col("d"), as_of())).collect()] == [1.0, 1.0, 0.4, 0.4, 0.0]
    df = spark.createDataFrame([("what is the lock-in period", "the lock in period is long")], "q string, t string")
    assert df.select(rerank.overlap(F.col("q"), F.col("t"))).first()[0] == pytest.approx(2 / 3)


def brute_chunks(text, target, overlap):
    import re

    text = text.strip()
    if len(text) <= target:
        return [text] if text else []
    out, buf = [], ""
    for line in text.split("\n"):
        for b in [line] if "|" in line else re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", line):
            if len(b) > target:  # words fill pieces, a longer word is cut; none starts with the end of the one before
                parts, sub = [], ""
                for w in filter(None, b.split(" ")):
                    if len(sub) + len(w) + bool(sub) <= target:
                        sub = f"{sub} {w}".strip()
                        continue
                    if sub:
                        parts.append(sub)
                    while len(w) > target:
                        parts.append(w[:target])
                        w = w[target:]
                    sub = w
                out += ([buf] if buf else []) + parts
                buf = sub
            elif b and len(buf) + len(b) + 1 <= target:
                buf = f"{buf} {b}".strip()
            elif b:
                out += [buf] if buf else []
                buf = f"{buf[-overlap:]} {b}".strip()
    return out + [buf] if buf else out


def test_chunk_packing(spark):
    import random

    rng = random.Random(1)

    def word():
        return "".join(rng.choice("abc") for _ in range(rng.choice([1, 3, 5, 9, 9, 9, 130]) if rng.random() < 0.1 else rng.randint(1, 9))).capitalize()

    texts = [rng.choice([" ", " ", "\n"]).join(word() + rng.choice([".", "", "", "!", " | x"]) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += ["a | b\nC d. E f", "x" * 500, "", " \n ", None, "row one | 1\nrow two | 2", "y" * 100 + " z", "Aa. " + "b " * 90 + "c. Dd"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", corpus.packed_chunks(F.col("t"), 100, 20).alias("c")).collect():
        text = texts[r["i"]]
        assert r["c"] == (None if text is None else brute_chunks(text, 100, 20)), text
        if text and len(text) <= 100:
            assert r["c"] == ([text.strip()] if text.strip() else [])


def test_chunks_carry_titles_and_rows(spark):
    body = "The load of one percent applies within a year of allotment."
    rows = [("d", 1, 0, "EXIT LOAD RULES", False), ("d", 2, 0, body, False), ("d", 2, 1, "RISK FACTORS HERE", False), ("d", 2, 2, "short", False)]
    df = spark.createDataFrame(rows, "doc_id string, page int, line_no int, line string, is_table boolean")
    got = [(r["title"], r["page"], r["page_end"], r["topic"], r["chunk_text"]) for r in corpus.chunks(corpus.sections(df)).collect()]
    assert got == [("EXIT LOAD RULES", 1, 2, "exit_load", f"EXIT LOAD RULES\n{body}")]
    listed = spark.createDataFrame([("r", 3, k, line) for k, line in enumerate(["12 Alpha Index Fund  Very High ", "no such thing", "Alpha"])], "doc_id string, page int, line_no int, line string")
    got = [(r["page"], r["title"], r["topic"], r["chunk_text"]) for r in corpus.row_chunks(listed, "Alpha", "Levels of risk of all", "Levels", "risk").orderBy("chunk_no").collect()]
    assert got == [(3, "Levels", "risk", "Levels of risk of all\n12 Alpha Index Fund  Very High")]


def test_sections(spark):
    rows = [("d", 1, 0, "intro", False), ("d", 1, 1, "EXIT LOAD RULES", False), ("d", 1, 2, "body one", False), ("d", 2, 0, "BENCHMARK INDEX", True), ("d", 2, 1, "row", True), ("d", 3, 0, "RISK FACTORS HERE", False)]
    df = spark.createDataFrame(rows, "doc_id string, page int, line_no int, line string, is_table boolean")
    got = [tuple(r) for r in corpus.sections(df).orderBy("section_no").collect()]
    assert got == [("d", 0, "Preamble", 1, 1, "intro"), ("d", 1, "EXIT LOAD RULES", 1, 2, "body one\nBENCHMARK INDEX\nrow")]
    late = [("d", 1, 9, "EXIT LOAD RULES", False), ("d", 2, 0, "body", False)]
    assert [tuple(r)[2:5] for r in corpus.sections(spark.createDataFrame(late, df.schema)).collect()] == [("EXIT LOAD RULES", 1, 2)]


def test_boilerplate(spark):
    rows = [("d", p, k, line, False) for p in range(6) for k, line in enumerate(["Running header", f"text {p} of page number", "middle", f"more {p} text here", "Closing line", f"p{p}"])]
    df = spark.createDataFrame(rows, "doc_id string, page int, line_no int, line string, is_table boolean")
    assert {r["line"] for r in corpus.boilerplate(df).collect()} == {"Running header", "Closing line"}
    assert corpus.boilerplate(df.where("page < 4")).count() == 0
    left = corpus.cleaned_lines(df)
    assert left.where("line in ('Running header', 'Closing line')").count() == 0 and left.where("line = 'middle'").count() == 6


def test_latest_and_replace(spark):
    d = datetime.date
    df = spark.createDataFrame([("a", d(2024, 1, 1), 1, "x"), ("a", d(2024, 1, 2), 3, "late second"), ("a", d(2024, 1, 2), 2, "late first"), ("b", None, 1, "n")], "k string, day date, row_idx int, v string")
    assert [(r["k"], r["v"]) for r in corpus.latest_per_key(df, ["k"], "day", "row_idx").collect()] == [("a", "late first")]
    old = spark.createDataFrame([("s1", 1), ("s2", 1)], "source_id string, v int")
    new = spark.createDataFrame([("s2", 2)], "source_id string, v int")
    once = corpus.replaced(old, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, corpus.replaced(once, new).collect())) == [("s1", 1), ("s2", 2)]
    q = spark.createDataFrame([("Q", 1), ("q", 2), ("r", 3)], "q string, i int")
    assert [(r["q"], r["seq"]) for r in corpus.first_by(q, F.col("q"), ["i"]).orderBy("seq").collect()] == [("Q", 1), ("r", 2)]


def turns(spark, rows):
    t0 = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(s, k, t0 + datetime.timedelta(seconds=sec), v, m) for s, k, sec, v, m in rows], "session_id string, turn long, ts timestamp, scheme string, remembered boolean")


TURNS = [("a", 0, 0, "x", True), ("a", 1, 1800, None, False), ("a", 2, 3599, None, True), ("a", 3, 3601, None, True), ("b", 0, 0, "y", False), ("b", 1, 10, None, True), ("b", 2, 20, "z", True), ("b", 3, 1820, "", True), ("b", 4, 3621, None, True)]
USED = [("a", 0, "x"), ("a", 1, "x"), ("a", 2, None), ("a", 3, None), ("b", 0, "y"), ("b", 1, None), ("b", 2, "z"), ("b", 3, "z"), ("b", 4, None)]


def test_session_ttl(spark):
    got = converse.carried(turns(spark, TURNS), ts="ts").select("session_id", "turn", "scheme_used").collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == USED


def test_session_stream(spark, tmp_path):
    source = tmp_path / "in"
    turns(spark, TURNS).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(turns(spark, TURNS).schema).parquet(str(source))
    q = session.remembered_schemes(stream).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("sessions").select("session_id", "turn", "scheme_used").collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == USED


def test_gates_and_evidence(spark):
    rows = [(1, 1, 0.2, None, "x"), (1, 2, 0.9, "x", "x"), (1, 3, 0.8, "y", "x"), (2, 1, 0.35, "x", None), (2, 2, 0.1, None, None)]
    df = spark.createDataFrame(rows, "query_id long, rank int, similarity double, scheme string, q_scheme string").withColumn("chunk_text", F.lit("t")).withColumn("title", F.lit("T")).withColumn("page_number", F.lit(3))
    assert {r["query_id"]: r["has_evidence"] for r in converse.gated(df).collect()} == {1: False, 2: True}
    found = converse.evidence(df)
    assert sorted((r["query_id"], r["place"], r["rank"]) for r in found.collect()) == [(1, 1, 2), (1, 2, 1), (2, 1, 1), (2, 2, 2)]
    assert converse.contexts(found).where("query_id = 2").first()["context"] == "T (page 3)\nt\n\n---\n\nT (page 3)\nt"


def test_outcomes(spark):
    rows = [("ADVICE", False, True, False, "a"), ("FACTUAL_SCHEME", True, True, False, "a"), ("AMBIGUOUS", False, False, False, None), ("FACTUAL_SCHEME", False, True, True, "a"), ("AMBIGUOUS", False, True, False, "It could not be found"), ("FACTUAL_SCHEME", False, True, False, "It couldn’t be found"), ("FACTUAL_SCHEME", False, True, False, "1 %")]
    df = spark.createDataFrame(rows, "intent string, hard boolean, ev boolean, mis boolean, answer string")
    o = converse.outcome(*(F.col(c) for c in ("intent", "hard")), ["ADVICE"], *(F.col(c) for c in ("ev", "mis", "answer")))
    assert [tuple(r[0]) for r in df.select(o).collect()] == [(True, "ADVICE", False, True), (True, "PII_ACCOUNT", False, True), (False, "NO_EVIDENCE", False, False), (False, "SCHEME_MISMATCH", False, False), (False, "NO_EVIDENCE", False, False), (False, None, True, True), (False, None, True, True)]


def test_evaluation(spark):
    rows = [("ADVICE", True, "MARKET_TIMING"), ("PII_ACCOUNT", True, "PII_ACCOUNT"), ("PII_ACCOUNT", False, None), ("MARKET_TIMING", True, "PERFORMANCE_PREDICTION")]
    df = spark.createDataFrame(rows, "expected string, refused boolean, refusal_type string")
    m = evaluate.passed(evaluate.guardrail(df)).first()
    answers = [("ERROR", False, "[HTTP 500]", None, None, "S"), ("FACTUAL", False, "One. Two.", "u", "S", "S"), ("FACTUAL", False, "see HTTP://x", "u", None, "S"), ("FACTUAL", False, "It couldn't be found for s", None, "", "S"), ("ADVICE", True, "no", None, None, None), ("FACTUAL", False, "A. B. C. D. E.", "", "T", "S")]
    g = spark.createDataFrame(answers, "intent string, refused boolean, answer string, source_url string, scheme string, expected_scheme string")
    own, loose = evaluate.golden(g).first(), evaluate.golden(g, errors_answered=True).first()
    assert tuple(own)[:10] == (6, 1, 3, 1, 2, 1, 2, 2, 5, 3) and own["retrieval_accuracy"] == 0.6 and loose["n_answered"] == 4 and loose["retrieval_accuracy"] == 0.8
    assert (m["n_correct"], m["refusal_accuracy"], m["pii_accuracy"], m["passed"]) == (2, 0.5, 0.5, False)
    assert evaluate.failures(df).count() == 2
    assert evaluate.guardrail(df.limit(0)).first()["refusal_accuracy"] == 0


def test_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("﻿file_name,title,extra\n a.pdf ,T,1\n,none,2\nb.pdf,,3\n".encode())
    m = files.manifest(spark, str(tmp_path / "m.csv"))
    assert [(r["file_name"], r["title"], r["scheme"]) for r in m.orderBy("file_name").collect()] == [("a.pdf", "T", ""), ("b.pdf", "", "")]
    files.write_manifest(m, str(tmp_path / "out"))
    assert sorted(map(tuple, files.manifest(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, m.collect()))
    docs = tmp_path / "docs" / "sub"
    docs.mkdir(parents=True)
    (docs / "a.TXT").write_text("hello")
    (docs / "b.xls").write_bytes(b"\xd0\xcf")
    (docs / "c.bin").write_bytes(b"1")
    (docs / "d.pdf").write_bytes(b"p1\fp2")
    assert {r["file_name"] for r in files.listing(spark, str(tmp_path / "docs"), excluded=["d.pdf"]).collect()} == {"a.TXT", "b.xls"}

    def pdf(content):
        for k, page in enumerate(content.decode().split("\f"), 1):
            yield k, page, False

    pages, rejected = files.extracted(spark, str(tmp_path / "docs"), {"pdf": pdf})
    assert sorted((r["page"], r["text"]) for r in pages.collect()) == [(1, "hello"), (1, "p1"), (2, "p2")]
    assert {r["reason"] for r in rejected.collect()} == {"not a ZIP container", "unsupported: .bin"}
    good, bad = files.validated(m, {"titled": F.col("title") != "", "named": F.length("file_name") > 2})
    assert good.count() == 1 and bad.first()["broken"] == ["titled"]
    disk = spark.createDataFrame([("a.pdf",)], "file_name string")
    assert files.preserved(m, m.limit(0), disk).count() == 1
    assert [x.count() for x in files.present(m, disk)] == [1, 1]


def test_titles_and_urls(spark):
    one = spark.createDataFrame([(["A", "", None, "B"],)], "c array<string>")
    assert one.select(files.spread_titles(F.col("c"))).first()[0] == ["A", "A", "A", "B"]
    docs = spark.createDataFrame([("s", "o"), ("", "o"), ("t", "o"), ("u", "o")], "scheme string, organization string")
    lookup = spark.createDataFrame([("scope", "s", "us")], "kind string, name string, url string")
    assert sorted(r["source_url"] for r in files.with_urls(docs, lookup, {"o": "uo", "t": "ut"}).collect()) == ["", "uo", "us", "ut"]


def test_turns_follow_their_answers(spark):
    """Against each session answered turn by turn: refusals and answers refresh the memory, turns without evidence don't, and it ends with its time."""
    import random

    r = random.Random(3)
    page = "Exit Load\nThe exit load of the flexi cap fund is one percent within one year of allotment of units.\nBenchmark\nThe benchmark of the flexi cap fund is the broad market index of five hundred stocks."
    pages = spark.createDataFrame([(1, 1, page, False), (2, 1, page.replace("flexi cap", "small cap"), False)], "doc_id int, page int, text string, is_table boolean")
    manifest = spark.createDataFrame([(k, f"{k}.pdf", "", "House", "SID", "2023-12-01", f"http://u{k}", "") for k in (1, 2)], "doc_id int, file_name string, scheme string, organization string, document_type string, document_date string, source_url string, source_id string")
    chunks = lifecycle.build_chunks(pages, manifest)
    chunks.write.mode("overwrite").saveAsTable("turn_chunks")
    chunks = spark.table("turn_chunks")
    said = ["What is the exit load of the flexi cap fund", "What is the benchmark of the small cap fund", "What is the exit load", "What is the benchmark", "Should I invest in the small cap fund", "Should I invest", "of the flexi cap fund " + " ".join(f"w{k}" for k in range(90)), "hello there xyzzy"]
    rows = [(100 * s + k, f"s{s}", k, r.choice(said), datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=k * r.choice([5, 9]) * 100)) for s in range(14) for k in range(7)]
    rows = [(*x[:4], x[4] + datetime.timedelta(seconds=x[2])) for x in rows]
    turns_ = spark.createDataFrame(rows, "query_id long, session_id string, turn long, question string, ts timestamp")
    schemes = ["HDFC FlexiCap Fund", "HDFC Small Cap Fund", None]
    variants = spark.createDataFrame([(10 * k + j, q, s) for k, q in enumerate(said) for j, s in enumerate(schemes)], "query_id long, question string, scheme_used string").withColumns({"session_id": F.lit("v"), "turn": F.lit(0)})
    got = lifecycle.classified(variants.drop("scheme_used")).join(variants.select("query_id", "scheme_used"), "query_id")
    named = {x["question"]: (x["scheme"], x["intent"]) for x in got.collect()}
    assert {s for s, _ in named.values()} == set(schemes)
    answers = {x["query_id"]: x for x in lifecycle._answered(got, chunks, as_of(), None, retrieve.hashed_embedding, lifecycle.I.REFUSED).collect()}
    for ts, ttl in ((None, None), ("ts", 1000)):
        want, cold = {}, 0
        for s in range(14):
            scheme, last = None, None
            for q, _, k, question, when in sorted((x for x in rows if x[1] == f"s{s}"), key=lambda x: (x[4] if ts else 0, x[2])):
                if ts and last is not None and (when - last).total_seconds() > ttl:
                    scheme, last = None, None
                own, intent = named[question]
                used = own or (scheme if intent in lifecycle.CARRYING else None)
                a = answers[10 * said.index(question) + schemes.index(used)]
                want[q] = (used, a["refused"], a["refusal_type"], a["remembered"], a["answer"])
                cold += bool(own) and not a["remembered"]
                if a["remembered"]:
                    scheme, last = used or scheme, when
        found = lifecycle.answer_turns(turns_, chunks, as_of(), ts=ts, **({"ttl": ttl} if ttl else {})).collect()
        assert {x["query_id"]: (x["scheme"], x["refused"], x["refusal_type"], x["remembered"], x["answer"]) for x in found} == want
        assert cold and {x[2] for x in want.values()} >= {None, "NO_EVIDENCE", "ADVICE"} or ts


def test_lifecycle(spark):
    pages = spark.createDataFrame([(1, 1, "Exit Load\nThe exit load of the flexi cap fund is one percent within one year of allotment of units.\nBenchmark\nThe benchmark of the flexi cap fund is the broad market index of five hundred stocks.", False)], "doc_id int, page int, text string, is_table boolean")
    manifest = spark.createDataFrame([(1, "sid.pdf", "HDFC FlexiCap Fund", "HDFC Mutual Fund", "SID", "2023-12-01", "http://u", "")], "doc_id int, file_name string, scheme string, organization string, document_type string, document_date string, source_url string, source_id string")
    chunks = lifecycle.build_chunks(pages, manifest).cache()
    assert sorted((r["section"], r["topic"]) for r in chunks.collect()) == [("Benchmark", "benchmark"), ("Exit Load", "exit_load")]
    queries = spark.createDataFrame([(1, "What is the exit load of the flexi cap fund"), (2, "my email is a@b.co")], "query_id long, question string")
    hits, refused = lifecycle.search(queries, chunks, as_of())
    first = hits.where("rank = 1").collect()
    assert [r["query_id"] for r in refused.collect()] == [2] and len(first) == 1 and "one percent" in first[0]["preview"]
    turns_ = spark.createDataFrame([(1, "s", 0, "What is the exit load of the flexi cap fund", True), (2, "s", 1, "What is the benchmark", True), (3, "s", 2, "Should I invest", True), (4, "t", 0, "hello", True)], "query_id long, session_id string, turn long, question string, remembered boolean")
    got = {r["query_id"]: r for r in lifecycle.answer_turns(turns_, chunks, as_of()).collect()}
    assert "one percent" in got[1]["answer"] and got[1]["citation"]["url"] == "http://u" and got[1]["last_updated"] == "December 2023"
    assert got[2]["scheme"] == "HDFC FlexiCap Fund" and got[3]["refused"] and got[3]["refusal_type"] == "ADVICE" and got[4]["refusal_type"] == "NO_EVIDENCE" and got[4]["answer"] is None


def _long_texts(spark):
    """Chunks of random words, four to a document, some near-duplicates of the one before, and turns that ask with words of theirs."""
    import random

    r = random.Random(5)
    texts = []
    for k in range(40):
        words = [f"w{r.randrange(10**9)}" for _ in range(1000)]
        texts.append(texts[-1] + f" more{k}" if k % 4 == 2 else " ".join(words))
    schemes = [None, *lifecycle.R.QUERY_SCHEMES][:3]
    rows = [(f"c{k}", k // 4, t, schemes[k % 3], "benchmark" if k % 2 else "exit_load", k % 5, "section", f"s{k}", ("org", "SID", "2023-12-01" if k % 3 else None, f"http://{k}", f"t{k}")) for k, t in enumerate(texts)]
    meta = "struct<organization:string,document_type:string,document_date:string,source_url:string,document_title:string>"
    chunks = spark.createDataFrame(rows, f"chunk_id string, document_id long, chunk_text string, scheme string, topic string, page_number int, section string, source_id string, metadata {meta}")
    chunks = chunks.withColumn("embedding", retrieve.hashed_embedding(F.col("chunk_text")))
    asked = [(k, k // 3, k % 3, "What is the exit load " + " ".join(texts[k % 40].split()[: 300 if k % 2 else 900])) for k in range(45)]
    return chunks, spark.createDataFrame(asked, "query_id long, session_id long, turn long, question string"), sum(map(len, texts))


def test_answers_write_no_text_for_each_hit(spark):
    from pathlib import Path

    chunks, turns_, size = _long_texts(spark)
    chunks = chunks.cache()
    top = Path(lifecycle.stored(spark.range(1), "top").inputFiles()[0].removeprefix("file://")).parents[1]
    before = set(top.iterdir())
    found = lifecycle.answer_turns(turns_, chunks, as_of())
    assert sum(x["answer"] is not None for x in found.collect()) > 20
    questions = sum(len(x["question"]) for x in turns_.collect())
    written = {p.name.split("-")[0]: sum(f.stat().st_size for f in p.glob("*.parquet")) for p in set(top.iterdir()) - before}
    # no more than the texts and questions themselves, though every turn has tens of hits
    assert sum(written.values()) < size + 4 * questions and max(v for k, v in written.items() if k in ("hits", "answered")) < size / 10


def test_ranked_scores_as_texts_joined_to_each_hit(spark, monkeypatch):
    """Against scores and demotions of whole texts, with hits of a chunk in rows of two and in one; chunks dealt by their id, or not."""
    from fathomline.sources.shared import dealt

    chunks, turns_, _ = _long_texts(spark)
    chunks = dealt(chunks, "chunks", "chunk_id")
    got = lifecycle.classified(turns_)
    queries = got.select("query_id", "question", F.col("question").alias("retrieval_text"), "intent", F.when(F.col("query_id") % 2 == 0, F.lit(next(iter(lifecycle.R.QUERY_SCHEMES)))).alias("q_scheme"), F.col("topic").alias("q_topic")).cache()
    vectors = queries.withColumn("qvec", retrieve.hashed_embedding(lifecycle.expanded(F.col("retrieval_text"), F.col("q_topic"), lifecycle.R.EXPANSIONS)))
    rows = retrieve.two_pass(chunks, vectors, retrieve.overfetch(8))
    value = rerank.score(F.col("similarity"), F.col("scheme"), F.col("q_scheme"), F.col("topic"), F.col("q_topic"), F.col("metadata.organization"), F.col("metadata.document_type"), F.col("intent"), F.col("metadata.document_date"), as_of(), F.col("question"), F.col("chunk_text"))
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "pass", F.col("similarity").desc(), "chunk_id")
    columns = ["query_id", "chunk_id", "pass", "rerank_score", "rank", "demoted"]
    want = sorted(map(tuple, rerank.demoted(rows.withColumn("rerank_score", value).withColumn("rank", F.row_number().over(w))).select(*columns).collect()))
    assert len(want) > 1000 and any(x[-1] for x in want)
    for together, of in ((1000, chunks), (2, chunks), (1000, chunks.repartition(3))):
        monkeypatch.setattr(lifecycle, "TOGETHER", together)
        found = lifecycle.ranked(queries, of, as_of())
        assert sorted(map(tuple, found.select(*columns).collect())) == want and "chunk_text" not in found.columns


def test_packed_words(spark):
    from fathomline.functions.text import packed, tokens, unpacked

    df = spark.createDataFrame([("The fund  THE\u00a0fund and is",), ("is a",), ("",), (None,)], "t string")
    assert all(a == b for a, b in df.select(tokens(F.col("t")), unpacked(packed(tokens(F.col("t"))))).collect())


def test_entry_lists_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pages_give_the_sections_of_their_lines(spark):
    """page_sections against cleaned_lines and sections: running lines, noise, tables, headings, empty pages, sections over pages."""
    import random


    r = random.Random(11)
    words = "the load of units within one year Page 3 | - is paid ABOUT IT".split()
    heads = ["Exit Load", "RISK FACTORS AND MORE", "2.3 Exit load", "Benchmark", "  Exit Load  "]

    def line():
        kind = r.random()
        return r.choice(heads) if kind < 0.15 else r.choice(["", " ", "12", "Page 4", "- 7 -"]) if kind < 0.35 else " ".join(r.choice(words) for _ in range(r.randrange(1, 14))) + r.choice(["", ".", ","])

    rows = []
    for doc in range(40):
        top, bottom = f"Running header of document {doc % 7}", f"running foot line {doc}"
        for page in range(r.choice([1, 2, 4, 5, 8, 12])):
            body = [line() for _ in range(r.randrange(12))]
            body = ([top] if r.random() < 0.6 else []) + body + ([bottom] if r.random() < 0.5 else [])
            rows.append((doc, page, "\n".join(body), r.random() < 0.1))
    rows += [(99, 1, None, False), (98, 1, "", False), (97, 1, "\n\n", True), (96, 2, "Exit Load", False), (96, 3, "follows on another page", True)]
    pages = spark.createDataFrame(rows, "doc_id int, page int, text string, is_table boolean").repartition(5)
    lines = pages.select("doc_id", "page", "is_table", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    columns = ["doc_id", "section_no", "title", "page", "page_end", "body"]
    want = sorted(map(tuple, corpus.sections(corpus.cleaned_lines(lines)).select(*columns).collect()))
    got = corpus.page_sections(corpus.page_lines(pages, F.col("text")))
    assert sorted(map(tuple, got.select(*columns).collect())) == want and len(want) > 100
    known = sorted(map(tuple, corpus.boilerplate(lines).collect()))
    found = corpus.running_lines(corpus.page_lines(pages, F.col("text"))).select("doc_id", F.explode("running").alias("line"))
    assert sorted(map(tuple, found.collect())) == known and known
    # documents whose lines with a token are sections of their own, where there are any
    by_row = corpus.page_sections(corpus.page_lines(pages, F.col("text")), F.col("doc_id") % 2 == 0, "units")
    rowed = {x["doc_id"] for x in corpus.cleaned_lines(lines).where("doc_id % 2 = 0 and contains(line, 'units')").select("doc_id").collect()}
    single = sorted((x["doc_id"], x["page"], -1 - x["section_no"], x["body"]) for x in by_row.where("section_no < 0").collect())
    assert single == sorted((x["doc_id"], x["page"], x["page"] * 10_000 + x["line_no"], x["line"]) for x in corpus.cleaned_lines(lines).where("doc_id % 2 = 0 and contains(line, 'units')").collect()) and rowed
    assert sorted(map(tuple, by_row.where("section_no >= 0").select(*columns).collect())) == [w for w in want if w[0] not in rowed]
