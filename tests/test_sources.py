"""Workbooks, tables of files, the store, loads, generators and searches over hand-made rows."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import converse, retrieve
from fathomline.plans import lifecycle
from fathomline.sources import files, store
from fathomline.sources.workbook import workbook_rows


def workbook(sheets):
    """A small workbook with shared, inline and plain values."""
    main, link = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    shared, out = [], io.BytesIO()

    def cell(place, v):
        if isinstance(v, str) and len(v) % 2:
            return f'<c r="{place}" t="inlineStr"><is><t>{v}</t></is></c>'
        if isinstance(v, str):
            shared.append(v)
            return f'<c r="{place}" t="s"><v>{len(shared) - 1}</v></c>'
        return f'<c r="{place}" t="b"><v>{int(v)}</v></c>' if isinstance(v, bool) else f'<c r="{place}"><v>{v}</v></c>'

    with zipfile.ZipFile(out, "w") as z:
        for k, (_, rows) in enumerate(sheets, 1):
            data = "".join(f'<row r="{i}">' + "".join(cell(f"{chr(65 + j)}{i}", v) for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {main}><sheetData>{data}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in shared) + "</sst>")
        z.writestr("xl/workbook.xml", f"<workbook {main} {link}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    rows = [["Name", "Rate", "On"], [None, None], ["Al", 1.5, True], ["Bee", None, False, "extra"]]
    (tmp_path / "a.xls").write_bytes(workbook([("First", rows), ("Empty", [])]))
    (tmp_path / "b.xls").write_bytes(b"\xd0\xcf old")
    found = workbook_rows(spark, str(tmp_path))
    assert [(r["sheet_no"], r["sheet"], r["row_idx"], r["cells"]) for r in found.orderBy("row_idx").collect()] == [(1, "First", 1, ["Name", "Rate", "On"]), (1, "First", 2, []), (1, "First", 3, ["Al", "1.5", "True"]), (1, "First", 4, ["Bee", "", "False", "extra"])]
    page = files.sheet_pages(found).collect()
    assert [(r["page"], r["label"], r["text"], r["is_table"]) for r in page] == [(1, "First", "HEADER: Name | Rate | On\nName: Al || Rate: 1.5 || On: True\nName: Bee || On: False", True)]


def test_expense_reports(spark):
    head = ["Scheme Name", "Type", "TER Date", "Base Expense Ratio", "Total TER", "Base Expense Ratio", "Total TER"]
    rows = [("d", 0, ["Title", "", "", "Regular Plan", "", "Direct Plan", ""]), ("d", 1, head), ("d", 2, ["F1", "x", "01/02/2024", "1.0", "0.1", "0.5", "0.05"]), ("d", 3, ["F1", "x", "03/02/2024", "1.1", "0.1", "0.6", "0.05"]), ("d", 4, ["F1", "x", "2024-02-03", "9", "9", "9", "9"]), ("d", 5, ["F2", "x", "bad", "1", "1", "1", "1"])]
    rows += [("e", 0, [None, " "]), ("e", 1, ["Scheme Name", "NSDL", "Date", "Base Expense", "Other", "Base Expense", "Other", "More"]), ("e", 2, ["G", "", "2024-01-05", "1", "2", "3", "4", ""]), ("e", 3, ["", "", "2024-01-06", "1"])]
    rows += [("f", 0, ["", "", "", "", "", "Direct"]), ("f", 1, head), ("f", 2, ["H", "", "05 Jan 2024", "1", "2", "3", "4"])]
    df = spark.createDataFrame([*rows, ("z", 0, ["Name"])], "doc_id string, row_idx int, cells array<string>")
    got = {r["scheme"]: r["text"] for r in files.expense_facts(df).collect()}
    row = "Scheme Name: F1 || Type: x || TER Date: 03/02/2024 || Regular Plan - Base Expense Ratio: 1.1 || Regular Plan - Total TER: 0.1 || Direct Plan - Base Expense Ratio: 0.6 || Direct Plan - Total TER: 0.05"
    assert got["F1"] == f"Total Expense Ratio (TER) Report - F1\nThe Total Expense Ratio (TER) of F1 as of 03/02/2024 is 0.1% for Regular Plan and 0.05% for Direct Plan.\n{row}"
    assert got["G"].split("\n")[1] == "The Total Expense Ratio (TER) of G as of 2024-01-05 is Scheme Name: G || Date: 2024-01-05 || Regular Plan - Base Expense: 1 || Direct Plan - Other: 2 || Direct Plan - Base Expense: 3 || Direct Plan - Other: 4"
    assert got["H"].split("\n")[2] == "Scheme Name: H || TER Date: 05 Jan 2024 || Base Expense Ratio: 1 || Total TER: 2 || Direct Plan - Base Expense Ratio: 3 || Total TER: 4" and set(got) == {"F1", "G", "H"}
    assert {r["doc_id"] for r in files.is_expense_report(df).collect()} == {"d", "f"}


def test_summary_tables(spark):
    cells = [(1, 0, 0, ["Scheme Summary Document"]), (1, 0, 1, ["1", None, "Fund Name", "Alpha"]), (1, 0, 2, ["2", " ", "Exit\nLoad", "1 %", "in a year"]), (1, 0, 3, ["", "alone"]), (2, 0, 0, ["Other", "x"])]
    df = spark.createDataFrame(cells, "doc_id int, table_no int, row_no int, cells array<string>")
    facts = ["Fund Name of Alpha: Alpha", "Exit Load of Alpha: 1 % in a year"]
    assert [r["fact"] for r in files.summary_facts(df).orderBy("row_no").collect()] == facts
    plain = spark.createDataFrame([(1, 1, " outside "), (1, 2, "only text"), (1, 3, " ")], "doc_id int, page int, text string")
    pages = {(r["doc_id"], r["page"]): (r["text"], r["is_table"]) for r in files.table_pages(plain, df.withColumn("page", F.lit(1))).collect()}
    bars = "Scheme Summary Document\n1 |  | Fund Name | Alpha\n2 |  | Exit Load | 1 % | in a year\n | alone"
    assert pages == {(1, 1): ("outside\n\n" + bars + "\n\nScheme Summary Document - Alpha\n" + "\n".join(facts), True), (1, 2): ("only text", False), (2, 1): ("Other | x", True)}


def test_store_and_ingest(spark, tmp_path):
    columns = "row_idx int, file_name string, title string, scheme string, organization string, document_type string, document_date string, effective_date string, source_url string, source_id string"
    m = spark.createDataFrame([(0, "a.txt", "", "", "O", "SID", "2024-02-03", "", "u", ""), (1, "b.txt", "B", "S", "O", "KIM", "", "", "u", "own"), (2, "gone.txt", "", "", "", "", "", "", "", ""), (3, "bad.bin", "", "", "", "", "", "", "", ""), (4, "thin.txt", "", "", "", "", "", "", "", "")], columns)
    text = "Exit Load\nThe exit load of the small cap fund is one percent within one year of allotment."
    pages = spark.createDataFrame([("a.txt", 1, text, False), ("b.txt", 1, text, False), ("thin.txt", 1, "x", False)], "file_name string, page int, text string, is_table boolean")
    rejected = spark.createDataFrame([("bad.bin", "unsupported: .bin")], "file_name string, reason string")
    path = str(tmp_path / "store")
    judged = lifecycle.ingest(spark, m, pages, rejected, path)
    assert {r["file_name"]: (r["status"], r["n_chunks"]) for r in judged.collect()} == {"a.txt": ("ok", 1), "b.txt": ("ok", 1), "gone.txt": ("missing", 0), "bad.bin": ("failed", 0), "thin.txt": ("empty", 0)}
    assert tuple(lifecycle.ingestion_summary(judged).first()) == (4, 1, 1, 2)
    again = pages.withColumn("text", F.replace("text", F.lit("one percent"), F.lit("two percent")))
    lifecycle.ingest(spark, m, again, rejected, path, only_file="b.txt")
    lifecycle.ingest(spark, m, again.limit(0), rejected, path, first=2)
    docs, chunks = store.current(spark, path)
    said = {r["source_id"]: r["chunk_text"] for r in chunks.collect()}
    assert len(said) == 2 and "two percent" in said.pop("own") and "one percent" in said.popitem()[1]
    assert store.source(docs, "own").count() == 1 and store.source(docs, "none").count() == 0
    assert {(r["title"], r["scheme"]) for r in store.listed(docs).collect()} == {("a.txt", ""), ("B", "S")}
    assert [r["name"] for r in store.names(spark, ["b", "a"]).collect()] == ["a", "b"]
    out = str(tmp_path / "json")
    store.write_json(docs.select("source_id", "title").orderBy("title"), out, "questions", description="d")
    got = files.evaluation_set(spark, out, "questions").select("source_id", "title")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.select("source_id", "title").collect()))
    store.write_json(docs.select("title"), out + "2")
    assert spark.read.json(out + "2").count() == 2


def test_disclosures_have_a_chunk_for_each_row(spark):
    pages = spark.createDataFrame([("r", 1, "Levels\n1 HDFC Alpha Fund Very High\n2 other\n3 HDFC Beta Fund Low", True), ("s", 1, "RISK LEVELS\nno row of the house is in here, so it is cut up like any other text", False)], "doc_id string, page int, text string, is_table boolean")
    manifest = spark.createDataFrame([(d, f"{d} Riskometer.pdf", "", "", "", "", "", "") for d in "rs"], "doc_id string, file_name string, scheme string, organization string, document_type string, document_date string, source_url string, source_id string")
    got = [(r["document_id"], r["section"], r["topic"], r["chunk_text"].split("\n")[-1]) for r in lifecycle.build_chunks(pages, manifest).orderBy("document_id", "chunk_text").collect()]
    assert got == [("r", "Risk-o-meter Disclosure", "riskometer", "1 HDFC Alpha Fund Very High"), ("r", "Risk-o-meter Disclosure", "riskometer", "3 HDFC Beta Fund Low"), ("s", "RISK LEVELS", "riskometer", "no row of the house is in here, so it is cut up like any other text")]


def test_words_of_pages_are_met_in_rows_of_pages(spark):
    sides = "text string, x0 double, x1 double, top double, bottom double"
    rows = [(d, p, [(f"w{k}", float(k % 7 * 40), float(k % 7 * 40 + 30), float(k // 7 * 10), float(k // 7 * 10 + 8)) for k in range(40)] + [("w", None, 1.0, 2.0, 3.0)]) for d in (1, 2) for p in (0, 1)]
    pages = spark.createDataFrame(rows, f"doc_id long, page long, words array<struct<{sides.replace(' ', ':').replace(',:', ',')}>>")
    boxes = spark.createDataFrame([(1, 0, 35.0, 0.0, 100.0, 25.0), (1, 0, None, 0.0, 500.0, 500.0)] + [(2, 1, k * 9.0, k * 2.0, k * 9.0 + 5, k * 2.0 + 9) for k in range(files.FEW + 8)] + [(7, 7, 0.0, 0.0, 1.0, 1.0)], "doc_id long, page long, x0 double, top double, x1 double, bottom double")
    same = lambda df: sorted(map(tuple, df.select("doc_id", "page", "line_no", "line").collect()), key=repr)
    want = same(files.outside_tables(pages.select("doc_id", "page", F.explode("words").alias("w")).select("doc_id", "page", "w.*"), boxes))
    assert same(files.outside_tables_of_pages(pages, F.col("words"), boxes)) == want and len(want) > 20


def test_rows_of_disclosures_are_kept_whole(spark):
    row = "1 HDFC Alpha Fund " + "Very High " * 1000 + "the end"
    pages = spark.createDataFrame([("r", 1, f"Levels\n{row}", True)], "doc_id string, page int, text string, is_table boolean")
    manifest = spark.createDataFrame([("r", "Riskometer.pdf", "", "", "", "", "", "")], "doc_id string, file_name string, scheme string, organization string, document_type string, document_date string, source_url string, source_id string")
    assert [r["chunk_text"].split("\n")[-1] for r in lifecycle.build_chunks(pages, manifest).collect()] == [row]


def test_manifests(spark, tmp_path):
    assert files.manifest(spark, str(tmp_path / "none.csv")).count() == 0
    rows = spark.createDataFrame([(k, f"f{k % 3}") for k in range(6)], "row_idx int, file_name string")
    assert [r["row_idx"] for r in files.selected(rows, "f1", 1).collect()] == [1] and files.selected(rows).count() == 6 and files.selected(rows, first=4).count() == 4
    (tmp_path / "a.txt").write_bytes(b"ab\xffc")
    assert files.extracted(spark, str(tmp_path))[0].first()["text"] == "ab�c"
    reports = spark.createDataFrame([(0, "TER_01-02-2024.xls", "TER_DATA", "t", "o", "u", ""), (1, "TER_03-02-2024.xls", "TER_DATA", "t", "o", "u", ""), (2, "x", "SID", "t", "o", "u", "")], "row_idx int, file_name string, document_type string, title string, organization string, source_url string, document_date string")
    patch = {"organization": "House", "source_url": "new"}
    got = {r["row_idx"]: tuple(r)[3:] for r in files.newest_report(reports, patch=patch).collect()}
    assert got == {1: ("House TER Report  (TER_DATA)", "House", "new", "2024-02-03"), 2: ("t", "o", "u", "")}
    assert files.newest_report(reports.where("row_idx > 0"), patch=patch).where("row_idx = 1").first()["title"] == "t"
    placed = files.placed(spark.createDataFrame([("/x/Small Cap/a.pdf", "a.pdf"), ("/x/b.pdf", "flexi b.pdf"), ("/x/c", "c")], "path string, file_name string"), {"S": ["small cap"]}, {"F": ["flexi"]})
    assert [r["scheme"] for r in placed.collect()] == ["S", "F", ""]


def test_generators_and_smoke(spark):
    def call(model, context, question):
        if model == "busy":
            raise converse.RateLimited(0)
        if "boom" in question:
            raise ValueError("x")
        return f"{model}: {context}"

    df = spark.createDataFrame([("c", "q"), ("c", "boom")], "c string, q string")
    got = [tuple(r[0]) for r in df.select(converse.generated(F.col("c"), F.col("q"), call, ["busy", "calm"])).collect()]
    assert got == [("calm: c", "calm", None), (None, "calm", "ValueError")]
    assert converse._asked(call, ["busy"], "c", "q", 2, 0) == (None, None, "RateLimited")
    rows = [(True, "ADVICE", "no", None), (False, None, "It couldn't be found", "u"), (False, None, "1 %", "u"), (False, None, "1 %", None), (False, None, None, "u")]
    df = spark.createDataFrame(rows, "refused boolean, kind string, answer string, url string")
    assert [r[0] for r in df.select(converse.smoke_status(*(F.col(c) for c in df.columns))).collect()] == ["REFUSED/ADVICE", "NOT_FOUND", "OK", "NO-SOURCE", "FAILED"]


def test_embeddings_check_their_size(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "t string")
    v = [r[0] for r in df.select(retrieve.hashed_embedding(F.col("t"), 16)).collect()]
    assert sum(x * x for x in v[0]) == pytest.approx(1) and v[1] == v[2] == [0.0] * 16
    with pytest.raises(Exception, match="not of 8 numbers"):
        df.select(retrieve.embedding(F.col("t"), lambda: retrieve.Hashed(4), 8, name="wrong")).collect()


@pytest.mark.parametrize("block, most", [(1000, 16000), (7, 16000), (5, 12)])
def test_search_of_strings_ties_and_passes(spark, monkeypatch, block, most):
    rng = np.random.default_rng(3)
    rows = [(f"c{i:04d}", rng.integers(-2, 3, 4).astype(float).tolist(), [None, "a", "b"][int(rng.integers(3))]) for i in range(700)]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<double>, scheme string").repartition(5)
    asked = [(f"q{i}", [float(x) for x in rng.integers(-2, 3, 4)], [None, "a", "b"][i % 3]) for i in range(40)]
    q = spark.createDataFrame(asked, "query_id string, qvec array<double>, q_scheme string")
    x = np.array([v for _, v, _ in rows])
    norm = np.linalg.norm(x, axis=1)
    want = {}
    for name, vec, scheme in asked:
        a = np.array(vec)
        if a.any():
            s = np.divide(x @ (a / np.linalg.norm(a)), norm, out=np.full(len(x), -1.0), where=norm > 0)
            hits = sorted((-round(c, 9), k) for c, (k, _, own) in zip(s.tolist(), rows, strict=True) if c >= 0 and scheme in (None, own))
            want[name] = [c for c, _ in hits[:6]]
    monkeypatch.setattr(retrieve, "BLOCK", block)
    monkeypatch.setattr(retrieve, "PASS", most)
    got = {}
    for r in retrieve.knn_batch(df, q, 6, ("scheme",)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(-round(r["similarity"], 9) or 0.0)
    assert {k: [v or 0.0 for v in w] for k, w in want.items() if w} == got


def test_generators_ask_at_once(spark):
    def counting():
        going = []

        def call(model, context, question):
            import time

            going.append(question)
            seen = len(going)
            time.sleep(0.05)
            going.pop()
            return str(seen)

        return call

    df = spark.range(40).coalesce(1).select(F.lit("c").alias("c"), F.col("id").cast("string").alias("q"))
    most = [max(int(r[0]["answer"]) for r in df.select(converse.generated(F.col("c"), F.col("q"), counting(), ["m"], at_once=n)).collect()) for n in (1, 6)]
    assert most[0] == 1 and 3 <= most[1] <= 6


def test_rounds_ask_open_rows_alone(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def call(model, context, question):
        import os
        import uuid

        before = len([f for f in os.listdir(asked) if f.startswith(f"{question}-")])
        (asked / f"{question}-{model}-{uuid.uuid4().hex}").write_text("")
        n = int(question)
        if n % 5 == 4:
            raise ValueError("x")
        if n % 5 == 3 or before < n % 5:  # of 3 every question is limited
            raise converse.RateLimited(0.01)
        return f"{model} {context} {question}"

    rows = spark.range(20).select("id", F.lit("c").alias("context"), F.col("id").cast("string").alias("question"), F.lit(1).alias("extra"))
    path = str(tmp_path / "said")
    one = {r["id"]: r for r in converse.generated_in_rounds(rows, "id", call, ["a", "b"], path, attempts=2, rounds=1).collect()}
    assert [one[k]["error"] for k in range(5)] == [None, "RateLimited", "RateLimited", "RateLimited", "ValueError"] and one[0]["answer"] == "a c 0"
    every = {r["id"]: tuple(r)[1:] for r in converse.generated_in_rounds(rows, "id", call, ["a", "b"], path, attempts=2).collect()}
    assert every[0] == ("a c 0", "a", None) and every[6] == ("a c 6", "a", None) and every[7] == ("b c 7", "b", None) and every[8] == (None, None, "RateLimited") and every[9] == (None, "a", "ValueError")
    counts = [len(list(asked.glob(f"{k}-*"))) for k in range(20)]
    assert counts == [{0: 1, 1: 2, 2: 3, 3: 4, 4: 1}[k % 5] for k in range(20)]
    assert converse.generated_in_rounds(rows.limit(0), "id", call, ["a"], str(tmp_path / "none")).count() == 0


def test_words_and_thousands_of_boxes(spark):
    import random

    r = random.Random(9)
    size = lambda: r.choice([0, 1, 5, 20, 31, 33, 70, 400, 3000])
    boxes = [(d, p, x, y, x + size(), y + size()) for d in range(2) for p in range(2) for _ in range(700) for x, y in [(r.randrange(-200, 6000) + 0.0, r.randrange(-200, 6000) + 0.0)]]
    boxes = [(d, p, *map(float, (x, t, x1 if r.random() < 0.97 else x + 2, b))) for d, p, x, t, x1, b in boxes] + [(0, 0, 50.0, 50.0, 40.0, 60.0), (0, 0, 1e12, 0.0, 1e12, 1e13)]
    words = [(d, p, f"w{k}", x, x + 10, y, y + 6) for d in range(3) for p in range(2) for k in range(400) for x, y in [(r.randrange(-300, 7000) + 0.5, float(r.randrange(-300, 7000)))]] + [(0, 0, "null", None, 3.0, 1.5, 2.0), (0, 0, "half", 6500.0, 6510.0, 4.5, 5.0)]
    out = [w for w in words if w[3] is None or not any(b[:2] == w[:2] and b[2] <= (w[3] + w[4]) / 2 <= b[4] and b[3] <= (w[5] + w[6]) / 2 <= b[5] for b in boxes)]
    lines = {}
    for w in out:
        lines.setdefault((w[0], w[1], round(w[5] / 3)), []).append((w[3] is not None, w[3] or 0, w[2]))
    want = sorted((*k, " ".join(x[2] for x in sorted(v))) for k, v in lines.items())
    got = files.outside_tables(spark.createDataFrame(words, "doc_id int, page int, text string, x0 double, x1 double, top double, bottom double"), spark.createDataFrame(boxes, "doc_id int, page int, x0 double, top double, x1 double, bottom double"))
    assert sorted(map(tuple, got.collect())) == want and 100 < len(out) < len(words) - 100
