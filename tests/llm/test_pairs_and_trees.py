"""Operators 11 to 13 against brute force, over odd rows, several blocks and chunks, and empty tables."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import entry, hard_negatives, linking, merkle, minhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, tmp_path, name, rows, schema, **more):
    df = spark.createDataFrame(rows, schema).withColumns({k: F.lit(v) for k, v in more.items()})
    df.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# ---- operator 11


def brute_negatives(rows):
    fit = set()
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in v):
            continue
        fit.add((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)))
    out, last = [], lambda i: (i is None, i or 0)
    for a in fit:
        if a[0] is None or a[0] % 50:
            continue
        scored = sorted(((sum(x * y for x, y in zip(a[2], b[2], strict=True)), b) for b in fit if b != a and len(b[2]) == len(a[2])), key=lambda s: (-s[0], last(s[1][0])))
        for score, p in [s for s in scored if s[1][1] == a[1]][:5]:
            good = [(s, b) for s, b in scored if b[1] != a[1] and 50 * score <= 100 * s <= 95 * score][:3]
            out += [(a[0], p[0], k, b[0], score, s) for k, (s, b) in enumerate(good, 1)]
    return sorted(out, key=repr)


def odd_vectors(n, seed, huge=False):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        centre = i % 4
        rows.append((i, [round(r.gauss(0.2 if k == centre else 0.05, 0.1), 2) for k in range(6)], r.randrange(3)))
    rows += [rows[50], rows[50], (50, rows[3][1], 1), (None, rows[7][1], 1), (None, rows[8][1], None), (9001, None, 1), (9002, [0.1, None] * 3, 1), (9003, [float("nan")] * 6, 1), (9004, [float("inf")] * 6, 1)]
    rows += [(9005, [], 1), (9050, [], 1), (9100, [0.5, 0.5], 2), (9101, [0.4, 0.5], 2), (9102, [0.3, 0.5], 1), (9103, [0.0] * 6, 1), (9150, [0.0] * 6, 1), (-50, rows[1][1], 2), (-7, rows[2][1], 2)]
    if huge:
        rows += [(9200, [1e9] * 6, 1), (9201, [1e9, -1e9] * 3, 1), (9202, [9e8] * 6, 2), (9203, [8e8] * 6, 2), (9204, [1e308] * 6, 2), (9205, [2e9, 1.0, 0.0, 0.0, 0.0, 1e-9], 1)]
    return rows


@pytest.mark.parametrize("huge", [False, True])
def test_hard_negatives(spark, tmp_path, monkeypatch, huge):
    monkeypatch.setattr(hard_negatives, "CHUNK", 40)
    rows = odd_vectors(620, 5, huge)
    d = written(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<double>, label int", score=1, row=2, cell="x")
    df = entry.QUERIES["op11_hard_negatives"](spark, d)
    got = sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()), key=repr)
    want = brute_negatives(rows)
    top = (1 << 63) - 1
    assert len(want) > 100 and got == [tuple(min(top, x) if k > 3 else x for k, x in enumerate(w)) for w in want]
    assert dict(df.dtypes)["rank"] == "int"


def test_hard_negatives_empty(spark, tmp_path):
    d = written(spark, tmp_path, "embeddings", [(50, None, 1)], "vec_id long, embedding array<float>, label int")
    assert entry.QUERIES["op11_hard_negatives"](spark, d).collect() == []


def test_brackets_hold_all_scores():
    r = np.random.default_rng(3)
    x = np.floor(256 * r.normal(0, 0.1, (300, 8)))
    norm2 = (x * x).sum(1)
    p = hard_negatives.Pivots(x[:100].tolist(), norm2.max(), 8)
    assert len(p.p) == 8
    d, q = p.distances(x, norm2, True), p.distances(x, norm2, False)
    scores, sums = x @ x.T, norm2[:, None] + norm2.max()
    gap, reach = np.abs(q[:, None] - d).max(2), (q[:, None] + d).min(2)
    assert (scores <= (sums - gap**2) / 2 + 1e-9 * sums + 1).all() and (scores >= (sums - reach**2) / 2 - 1e-9 * sums - 1).all()


# ---- operator 12


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """Levels of a tree, and each leaf's siblings as (left, digest or None)."""
    levels, paths = [list(nodes)], [[] for _ in nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        for k, path in enumerate(paths):
            at = k >> (len(levels) - 1)
            path.append((at % 2 == 1, now[at ^ 1] if at ^ 1 < len(now) else None))
        levels.append([h(*now[k : k + 2]) for k in range(0, len(now), 2)])
    return levels[-1][0], paths


def fold(x, path):
    for left, s in path:
        x = h(x) if s is None else h(s, x) if left else h(x, s)
    return x


def brute_manifest(rows):
    by = {}
    for doc_id, text, lang, source, n in rows:
        own = h(*map(field, (doc_id, source, lang, n, text)))
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n is not None
        by.setdefault(lang, []).append((doc_id, own, h(*map(field, (doc_id, source, lang, n + 1, text))) if bad else own))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in names:
        by[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = tree([x[1] for x in by[lang]])
    root, crown = tree([trees[x][0] for x in names])
    out = []
    for lang, more in zip(names, crown, strict=True):
        for (doc_id, own, now), path in zip(by[lang], trees[lang][1], strict=True):
            whole = path + more
            end = fold(now, whole)
            out.append((doc_id, own, trees[lang][0], root, h(*(s for _, s in whole if s)), end, end == root))
            assert fold(own, whole) == root
    return sorted(out, key=repr)


def test_merkle(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, f"text {i} é", r.choice(["en"] * 8 + ["de"]), r.choice(["s", None]), i % 90) for i in range(1500)]
    rows += [(5000 + i, "t", f"lang {i}", "s", 3) for i in range(300)] + [(7000, None, None, None, None), (7001, "", None, "", 0), (None, "a", "en", "s", 1), (None, "b", "en", "s", 1), (3, "again", "en", "s", 1), rows[9], rows[9], (8000, "x", "", "s", -1), (8001, "日本", "日本", "ñ", 1)]
    d = written(spark, tmp_path, "documents", rows, DOCS, place=1, digest="x", group="g", about=2)
    df = entry.QUERIES["op12_merkle"](spark, d)
    got = sorted((tuple(x[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for x in df.collect()), key=repr)
    assert got == brute_manifest(rows)
    assert {True, False} == {x[6] for x in got}


def test_merkle_few_leaves(spark, tmp_path):
    for k, rows in enumerate(([], [(4, "a", "en", "s", 1)], [(4, "a", "en", "s", 1), (5, "a", None, "s", 1)])):
        d = written(spark, tmp_path / str(k), "documents", rows, DOCS)
        got = sorted((tuple(x) for x in entry.QUERIES["op12_merkle"](spark, d).collect()), key=repr)
        assert got == (brute_manifest(rows) if rows else [])


def test_proofs_show_changes(spark, tmp_path):
    leaves = spark.range(700).select((F.col("id") % 2).alias("group"), F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("digest")).withColumn("about", F.struct("k", "digest"))
    root, proven = merkle.manifest(leaves, f"{tmp_path}/m", ["k"])
    good = proven.select((merkle.folded(F.col("about.digest"), F.col("path")) == root).alias("own"), (merkle.folded(F.sha2(F.lit("x"), 256), F.col("path")) == root).alias("other"))
    assert good.groupBy("own", "other").count().collect()[0].asDict() == {"own": True, "other": False, "count": 700}
    assert sorted(p.name for p in (tmp_path / "m/trees").iterdir()) == ["level=0", "level=8"]


# ---- operator 13


def sets_of(rows):
    out = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out.append((doc_id, frozenset(tuple(words[k : k + 3]) for k in range(len(words) - 2)) if len(words) > 2 else frozenset([tuple(words)] if words else [])))
    return out


def brute_near(rows):
    sets = sets_of(rows)
    up = list(range(len(sets)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least.setdefault(find(k), []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    return sorted(((i, len(s), least[find(k)], least[find(k)] == i) for k, (i, s) in enumerate(sets)), key=repr)


def odd_texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    texts = []
    for group in range(12):
        base = [word() for _ in range(r.randrange(5, 160))]
        for _ in range(r.choice([1, 2, 5, 40])):
            new = base[:]
            for _ in range(r.randrange(4)):
                new[r.randrange(len(new))] = word()
            texts.append(" ".join(new))
    texts += [None, None, "", " \n ", "one", "ONE", "one\ttwo", "One two", "one two three", "é É", "É é", "x " * 5000, "x " * 4000, "a\x0bb\x0cc d", "a b c d", "a b c d"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, "another text of id three"), (None, texts[0]), (None, "only null ids here please"), (None, "only null ids here please")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("posted,held", [(4096, 2048), (8, 4)])
def test_minhash(spark, tmp_path, monkeypatch, posted, held):
    monkeypatch.setattr(minhash, "POSTED", posted)
    monkeypatch.setattr(minhash, "HELD", held)
    rows = odd_texts(8)
    d = written(spark, tmp_path, "documents", [(i, t, "en", "s", 0) for i, t in rows], DOCS, node=1, key="k", n=3)
    got = sorted((tuple(x[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for x in entry.QUERIES["op13_minhash"](spark, d).collect()), key=repr)
    assert got == brute_near(rows)


def test_minhash_empty(spark, tmp_path):
    assert entry.QUERIES["op13_minhash"](spark, written(spark, tmp_path, "documents", [], DOCS)).collect() == []


def test_pairs_at_the_limit_agree():
    """Sets of similarity 0.85 pass both thresholds by far."""
    r = np.random.default_rng(4)
    indexed, signed = [], []
    for _ in range(400):
        x = r.integers(0, 1 << 63, 2300, np.uint64)
        a, b = minhash.signature(x[:2138]), minhash.signature(np.concatenate([x[:1966], x[2138:]]))  # 1966 of 2300 in common
        agree = a == b
        indexed.append(agree[: minhash.INDEXED].sum())
        signed.append(agree.sum())
    assert min(indexed) >= minhash.MATCHES + 5 and min(signed) >= minhash.AGREE + 10
    assert abs(np.mean(signed) / minhash.SIGNED - 1966 / 2300) < 0.01 and np.std(signed) < 3.6


def test_links_of_a_chain_and_a_star(spark):
    """Groups of many blocks whose links are few: a chain, and copies that only their original is linked with."""
    base = np.arange(0, 2000, dtype=np.uint64)
    chain = [base[10 * k : 10 * k + 400] for k in range(60)]  # neighbours share 390 of 410
    star = [base[:200]] + [np.sort(np.concatenate([np.delete(base[:200], range(7 * k % 180, 7 * k % 180 + 14)), base[300 + 14 * k : 314 + 14 * k]])) for k in range(60)]
    rows = [(g, 1000 * g + k, x.tobytes()) for g, group in ((1, chain), (2, star)) for k, x in enumerate(group)]
    from fathomline.llm.components import components

    edges = linking.linked(spark.createDataFrame(rows, "key long, node long, body binary").repartition(4), minhash.Sets, 7, 1 << 20)
    near = lambda x, y: 100 * len(set(x) & set(y)) >= 85 * len(set(x) | set(y))
    sets = {node: np.frombuffer(b, np.uint64).tolist() for _, node, b in rows}
    assert all(near(sets[e.a], sets[e.b]) for e in edges.collect())
    assert not near(star[1].tolist(), star[2].tolist()) or not near(star[1].tolist(), star[9].tolist())
    assert {r.node: r.root for r in components(edges).collect()} == {1000 * g + k: 1000 * g for g in (1, 2) for k in range(1, 61 if g == 2 else 60)}


# ---- long lists of operator 9, hot ids of operator 10


@pytest.mark.parametrize("spread", [0, 40])
def test_long_lists_cost_rows_in_proportion(spark, monkeypatch, spread):
    """20,000 fingerprints of which all share four bytes: near copies of one, or unlinked ones; blocks of 256."""
    from pyspark.sql import DataFrame

    from fathomline.llm import simhash
    from fathomline.llm.components import components

    monkeypatch.setattr(simhash, "BLOCK", 256)
    r = random.Random(6)
    values = set()
    while len(values) < 20_000:
        v = 0x12345678
        for b in r.sample(range(32, 64), 3) if not spread else [k for k in range(32, 64) if r.random() < 0.5]:
            v ^= 1 << b
        values.add(v)
        if not spread and len(values) > 4500:  # 32 over 3 is 4960
            break
    made = []
    real = linking.stored

    def stored(df: DataFrame, name: str):
        out = real(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(linking, "stored", stored)
    nodes = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in sorted(values)], "fp long").repartition(4)
    monkeypatch.setattr(simhash, "CHOICES", simhash.CHOICES[:1])  # the list of the four bytes that they share
    monkeypatch.setattr(simhash, "postings", lambda n: n.select(F.lit(0).cast("long").alias("key"), "fp"))
    edges = simhash.links(nodes)
    found = {x.node: x.root for x in components(edges).collect()}
    x = np.array(sorted(values), np.uint64)
    roots = np.arange(len(x))

    def find(k):
        while roots[k] != k:
            roots[k] = roots[roots[k]]
            k = roots[k]
        return k

    for k, v in enumerate(x):
        if spread:
            near = np.flatnonzero(np.bitwise_count(x[k + 1 :] ^ v) <= 4) + k + 1
            for j in near:
                roots[find(int(j))] = find(k)
    want = {}
    for k, v in enumerate(x):
        want.setdefault(find(k), []).append(int(np.int64(v)))
    if not spread:
        assert len(set(found.values())) == 1 and len(found) == len(values) - 1
    else:
        assert {a: b for a, b in found.items() if a != b} == {v: min(g) for g in want.values() for v in g if v != min(g)}
    assert max(n for name, n in made if name in ("links", "groups", "finer-groups")) <= 12 * len(values), made


def test_one_doc_id_fills_many_ranges(spark, tmp_path):
    import public_tokenizers

    from fathomline.llm import token_files

    bpe = public_tokenizers.path("byte_bpe_50k.json")
    rows = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("same start of a text that is longer than sixty-four characters are, and "), F.when(F.col("id") < 1500, 0).otherwise(F.col("id"))).alias("text"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_token_files(rows.repartition(3), str(tmp_path / "t"), bpe)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    parts = {r["part"]: r["n"] for r in spark.read.parquet(str(tmp_path / "t")).groupBy("part").agg(F.sum(F.size("doc_ids")).alias("n")).collect()}
    assert len(parts) == 4 and max(parts.values()) < 1500 and sum(parts.values()) == 3000
    got = sorted((r["start"], r["n_tokens"]) for r in token_files.read_token_files(spark, str(tmp_path / "t")).collect())
    assert [a for a, _ in got] == list(itertools.accumulate([n for _, n in got[:-1]], initial=0))
