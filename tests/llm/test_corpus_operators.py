"""Operators over pairs, lines and the benchmark, and the pipeline, against brute force."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from fathomline.llm import components, decontaminate, line_dedup, simhash
from fathomline.llm.common import stored

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def window_hits(items, text, window):
    words, hit, found = re.findall(WORD, lower(text)), set(), set()
    for item, t in items:
        w = re.findall(WORD, lower(t))
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            for k in range(len(words) - n + 1):
                if words[k : k + n] == w[s : s + n]:
                    hit.update(range(k, k + n))
                    found.add(item)
    return hit, found


def cases(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        words = ["a", "b", "c", "É", "Dd"][: rng.randint(1, 5)]
        items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(rng.randint(0, 5))]
        yield rng.randint(1, 5), items, " ".join(rng.choice([*words, "zz"]) for _ in range(rng.randint(0, 30)))


def test_automaton_equals_brute_force():
    for window, items, text in cases(3, 600):
        a = decontaminate.Automaton(items, window)
        ranges, found = a.hits(decontaminate.words(text))
        hit, want = window_hits(items, text, window)
        assert {k for x, y in ranges for k in range(x, y)} == hit and found == want
        assert not window_hits(items, decontaminate.without(text, lambda s: a.hits(s)[0])[0], window)[1]


@pytest.mark.parametrize("most", [decontaminate.AUTOMATON_WORDS, 12])
def test_hits_and_clean(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate.automata, "__defaults__", (decontaminate.WINDOW, most))
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item"), (3, None), (4, "..."), (5, "one two three four five six seven eight nine ten other")]
    texts = ["x one two three four five six seven eight nine TEN y", "short, ITEM and more words around it to keep", None, "", "clean words", "clean words", "one " * 40_000]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, _lost long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.hits(docs, bench).collect():
        text = texts[r["doc_id"]] or ""
        hit, found = window_hits([(i, t or "") for i, t in items], text, 10) if r["doc_id"] != 6 else (set(), set())
        assert {k for a, b in zip(r["starts"], r["ends"], strict=True) for k in range(a, b)} == hit and set(r["items"]) == found and r["n_words"] == len(re.findall(WORD, lower(text)))
    out = {r["doc_id"]: r for r in decontaminate.clean(docs, bench).collect()}
    assert 0 not in out and out[1]["text"] == " and more words around it to keep" and out[2]["text"] is None and out[4]["text"] == "clean words" and out[4]["_lost"] == 4
    assert decontaminate.hits(docs, bench.limit(0)).where("size(items) > 0").count() == 0
    assert decontaminate.clean(docs.limit(0), bench).count() == 0


def test_clean_does_not_depend_on_how_items_are_dealt(spark, monkeypatch):
    rng = random.Random(11)
    first, second, third = (" ".join(f"{x}{k}" for k in range(10)) for x in "abc")
    over = " ".join([*(f"a{k}" for k in range(5, 10)), *(f"d{k}" for k in range(5))])
    items = [first, second, third, over, *(" ".join(rng.choice("xyz") for _ in range(12)) for _ in range(6)), "short one"]
    most = " ".join(f"own{k}" for k in range(5))
    texts = [f"{first} {most} {second}", f"{first} {most} {most}", f"{first} d0 d1 d2 d3 d4 " + " ".join(f"w{k}" for k in range(40)), None, "", most]
    # a window that shows after another has been cut, twice
    texts.append(" ".join([*(f"a{k}" for k in range(5)), *(f"b{k}" for k in range(3)), *third.split(), *(f"b{k}" for k in range(3, 10)), *(f"a{k}" for k in range(5, 10)), *(f"w{k}" for k in range(40))]))
    texts += [" ".join([*(rng.choice("xyz") for _ in range(rng.randint(0, 60))), *(f"w{k}" for k in range(rng.randint(0, 40)))]) for _ in range(40)]
    docs = spark.createDataFrame([(i % 30, t, i) for i, t in enumerate(texts)], "doc_id long, text string, _at long")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = [(i, t) for i, t in ((i, t and without_windows(items, t)) for i, t in enumerate(texts)) if t is not None or texts[i] is None]
    for words in (decontaminate.AUTOMATON_WORDS, 25, 1):
        monkeypatch.setattr(decontaminate.automata, "__defaults__", (decontaminate.WINDOW, words))
        out = decontaminate.clean(docs, bench)
        assert out.columns == docs.columns and sorted((r["_at"], r["text"]) for r in out.collect()) == want, words


def test_clean_holds_one_automaton_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} of words") for i in range(20)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(f"i{i}w{k}" for k in range(12))) for i in range(6)], "item_id long, text string")
    live, most, sc = set(), [], spark.sparkContext
    put, plan = type(sc).broadcast, lambda df: df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")

    def broadcast(self, value):
        out = put(self, value)
        if isinstance(value, decontaminate.Automaton):
            live.add(id(out))
            most.append(len(live))
            end = out.destroy
            monkeypatch.setattr(out, "destroy", lambda *a: (live.discard(id(out)), end(*a)), raising=False)
        return out

    monkeypatch.setattr(type(sc), "broadcast", broadcast)
    assert plan(decontaminate.clean(docs, bench)) == 1
    live.clear()
    monkeypatch.setattr(decontaminate.automata, "__defaults__", (decontaminate.WINDOW, 12))
    out = decontaminate.clean(docs, bench)
    assert plan(out) == 0 and max(most) == 1 and len(most) == 7 and out.count() == 20


def test_line_dedup(spark):
    passage = "a passage of more than five words that sites share"
    rows = [(5, f"own line of the fifth document here\n{passage}", "s1"), (2, f"{passage}\nhead of two is long enough too", "s2"), (3, f"x\n  {passage.upper()} ", "s3"), (4, passage, None), (6, passage, "s1"), (7, None, "s4"), (8, "", "s5"), (9, "of few words\n" * 3, "s6"), (10, "of few words", "s7"), (11, "of few words", "s8"), (None, f"{passage}\nz", "s9"), (12, "twice on two sites but not on three", "s1"), (13, "twice on two sites but not on three", "s2"), (12, "twice on two sites but not on three", "s1")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, _gone int")
    out = line_dedup.deduplicated(docs, counts=True)
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()), key=str)
    want = {5: "own line of the fifth document here", 2: rows[1][1], 3: "x", 4: "", 6: "", None: "z"}  # "of few words" on three sites stays
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    assert got == sorted(((i, want.get(i, t), 0 if t is None else t.count("\n") + 1, int(i in (5, 3, 4, 6, None))) for i, t, _ in rows), key=str)
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0


def test_hll_band_decides_exactly(spark):
    rng = random.Random(6)
    rows, sites = [], {}
    for k in range(300):
        for _ in range(rng.randint(1, 9)):
            s = f"s{rng.randint(0, 9)}"
            rows.append((len(rows), f"line number {k} has words enough", s))
            sites.setdefault(k, set()).add(s)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for least in (2, 4, 6):
        assert line_dedup.boilerplate(line_dedup.keyed(docs), sites=least).count() == sum(len(s) >= least for s in sites.values())


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(13)
    passages = [" ".join(f"p{k}w{j}" for j in range(50 + k)) for k in range(6)]
    usual = [f"usual line {k} of some words" for k in range(6)] + ["日本語の長い行" * 8]
    short = ["Home", "All rights reserved.", "日本語の行", " \t ", "", "\t", "a  b\tc"]
    rows = []
    for i in range(260):
        lines = [rng.choice([*passages, *usual, *short, *short, f"own words {rng.random()} of this very line", f"Own {rng.random()}"]) for _ in range(rng.randint(0, 7))]
        lines = [x.upper() if rng.random() < 0.2 else f" {x} " if rng.random() < 0.2 else x for x in lines]
        rows.append((rng.choice([None, *range(200)]), rng.choice([None, *["\n".join(lines)] * 12]), rng.choice([None, "s0", "s0", "s0", "s0", *(f"s{k}" for k in range(13))])))
    rows += [rows[0]] * 3 + [(None, "\n".join([passages[0], "rest"]), "s1"), (None, "\n".join([passages[0], "other rest " * 40]), "s2"), (900, "\n" * 5000, "s3"), (901, "\n".join([usual[0]] * 3000), "s4")]
    docs = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], "doc_id long, text string, source string, n int, row string")
    out = line_dedup.deduplicated(docs, counts=True)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = {r["n"]: (r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()}
    want = without_boilerplate(rows)
    assert len(got) == len(rows) and sum(x[2] for x in want) > 300
    for k, r in enumerate(rows):
        assert got[k] == want[k], (r, got[k], want[k])


def brute_components(fps):
    values = sorted(fps)
    a, parent = np.array(values, np.uint64), list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[k]) <= 4):
            x, y = sorted((find(k), find(int(j))))
            parent[y] = x
    groups = {}
    for k, v in enumerate(values):
        groups.setdefault(find(k), set()).add(v)
    return {frozenset(g) for g in groups.values()}


def near_values(seed, groups, members):
    rng = random.Random(seed)
    out = {0, 1, (1 << 64) - 1}
    for _ in range(groups):
        v = rng.getrandbits(64)
        for _ in range(members):
            w = v
            for _ in range(rng.randint(0, 6)):
                w ^= 1 << rng.randrange(64)
            out.add(w)
            v = w if rng.random() < 0.5 else v
    return out


@pytest.mark.parametrize("block", [4096, 3])
def test_links_lose_no_component(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    values = near_values(7, 25, 12)
    nodes = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    edges = simhash.links(nodes)
    groups = {frozenset([v]) for v in values}
    star = components.components(edges).collect()
    by = {}
    for r in star:
        by.setdefault(r["root"], {r["root"]}).add(r["node"])
    joined = {frozenset(int(np.int64(x).astype(np.uint64)) for x in g) for g in by.values()}
    seen = set().union(*joined) if joined else set()
    assert joined | {g for g in groups if not g & seen} == brute_components(values)


def test_components(spark):
    rng = random.Random(8)
    chain = [(k, k + 1) for k in range(300)] + [(1000 + rng.randrange(50), 1000 + rng.randrange(50)) for _ in range(60)] + [(2000, x) for x in range(2001, 2100)] + [(7, 7)]
    df = spark.createDataFrame(chain, "a long, b long")
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in chain:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components.components(df.limit(0)).count() == 0


def test_near_duplicates(spark):
    base = " ".join(f"w{k}" for k in range(400))
    rows = [(4, base), (2, base), (9, base + " tail"), (5, None), (6, ""), (7, " \n"), (8, "One two"), (3, "one TWO"), (None, "null id of its own text here"), (None, "null id of its own text here"), (None, base), (11, "x " * 20_000), (4, base)]
    docs = spark.createDataFrame([(*r, 0, "c") for r in rows], "doc_id long, text string, fp int, component_id string")
    got = simhash.near_duplicates(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert len(got) == len(rows) and by[4] == by[2] == by[9] == {2} and by[5] == by[6] == by[7] == {5} and by[8] == by[3] == {3} and by[None] == {None, 2}
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == [11, 2, 3, 5, None]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_representatives_of_rows_that_share_a_doc_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(400)) for x in "abc")
    rows = [(5, a), (5, b), (3, a + " tail"), (5, a), (7, c), (7, c + " tail"), (7, c), (8, b), (9, ""), (9, None), (9, "of its own"), (2, "apart"), (2, "other words"), (None, "nameless"), (None, a)]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id int, text string, _fp int, _root int")
    out = simhash.representatives(docs)
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    same = {c + " tail": c, None: ""}
    assert out.columns == docs.columns
    assert sorted(((i, same.get(t, t)) for i, t in got), key=str) == sorted([(3, a + " tail"), (5, b), (7, c), (9, ""), (9, "of its own"), (2, "apart"), (2, "other words"), (None, "nameless")], key=str)


def test_pipeline_runs_and_keeps_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, small), name)
        assert docs.columns == columns, name
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= ids and len(now) > 0.6 * len(ids), name
        ids = now
    assert docs.where("n_chars <> length(text)").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == ids


def without_boilerplate(rows):
    """rows (doc_id, text, source) -> (text, lines, lines removed) of each."""
    sites, owner = {}, {}

    def key(line):
        return lower(line.strip(" "))

    def need(line):
        words = len([w for w in re.split("[ \t]+", line) if w])
        return None if not words else 2 if words >= 50 else 3 if words >= 5 or len(line.strip(" ")) >= 40 else 10

    last = 1 << 63
    for i, text, source in rows:
        for line in (text or "").split("\n"):
            if need(line):
                sites.setdefault(key(line), set()).add(source)
                owner[key(line)] = min(owner.get(key(line), last), last if i is None else i)
    out = []
    for i, text, _ in rows:
        if text is None:
            out.append((None, 0, 0))
            continue
        lines = text.split("\n")
        going = [bool(need(x)) and len(sites[key(x)]) >= need(x) and owner[key(x)] != (last if i is None else i) for x in lines]
        weak = [need(x) == 2 and len(sites[key(x)]) < 3 for x in lines]
        major = 2 * sum(len(x) for x, g, w in zip(lines, going, weak, strict=True) if g and w) >= len(text)
        kept = [x for x, g, w in zip(lines, going, weak, strict=True) if not g or w and major]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def simple_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    parts = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def without_windows(items, text):
    """The text without windows, or None if they cover more than half of it."""
    windows = set()
    for t in items:
        w = re.findall(WORD, lower(t))
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    sizes, total, lost = {len(w) for w in windows}, None, 0
    while True:
        spans = [m.span() for m in re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)]
        words = [lower(text[a:b]) for a, b in spans]
        total = len(words) if total is None else total
        hit = sorted({j for n in sizes for k in range(len(words) - n + 1) if tuple(words[k : k + n]) in windows for j in range(k, k + n)})
        if not hit:
            return None if total and lost / total > 0.5 else text
        lost += len(hit)
        out, at, k = [], 0, 0
        while k < len(hit):
            e = k
            while e + 1 < len(hit) and hit[e + 1] == hit[e] + 1:
                e += 1
            out.append(text[at : spans[hit[k]][0]])
            at, k = spans[hit[e]][1], e + 1
        text = "".join([*out, text[at:]])


def test_pipeline_equals_brute_force(spark, small):
    import public_tokenizers
    from tokenizers import Tokenizer

    from fathomline.llm import toxicity

    table = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.learnt(spark, table, small)
    restorer = toxicity.Restorer(model[0])
    docs = {r["doc_id"]: (r["text"], r["source"]) for r in table.collect()}
    docs = {i: d for i, d in docs.items() if model[1].score(restorer.restore(d[0])[1]) < toxicity.THRESHOLD}
    texts = dict(enumerate(without_boilerplate([(i, *d) for i, d in docs.items()])))
    texts = {i: texts[k][0] for k, i in enumerate(docs)}
    fps = {i: simple_fingerprint(t) for i, t in texts.items()}
    first = {}
    for group in brute_components(set(fps.values())):
        members = [i for i, f in fps.items() if f in group]
        first[min(members)] = texts[min(members)]
    items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    final = {i: t for i, t in ((i, without_windows(items, t)) for i, t in first.items()) if t is not None}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in final.items()}
    got = {}
    for p in sorted(corpus_pipeline.run(spark, small).collect(), key=lambda p: (p["doc_id"], p["start"])):
        assert p["start"] == len(got.setdefault(p["doc_id"], []))
        got[p["doc_id"]] += p["ids"]
    assert got == want
