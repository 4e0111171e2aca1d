"""The fitted models of operators 4 and 8 against plain sets, dictionaries and direct solutions."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from fathomline.llm import entry, ngrams, toxicity

from .test_queries import tables  # noqa: F401  (the fixture)


def plain_grams(c):
    """The set of (size, n-gram) of framed classes, as tuples."""
    framed = [0, *c, 0]
    return {(n, tuple(framed[k : k + n])) for n in toxicity.SIZES for k in range(len(framed) - n + 1)}


def code(gram):
    n, values = gram
    out = 0
    for v in values:
        out = out << ngrams.BITS | int(v)
    return out << 3 | n


def bucket(number):
    return (number * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - toxicity._BUCKET_BITS)


def test_trigram_counts(spark, tables):  # noqa: F811
    d, docs = tables
    want = Counter()
    parts = [0, 0]
    got = Counter({r["gram"]: r["n"] for r in toxicity.trigram_counts(spark.read.parquet(f"{d}/documents.parquet").coalesce(1)).collect()})
    for r in spark.read.parquet(f"{d}/documents.parquet").coalesce(1).select("text").collect():
        parts += [*(int(x) for x in ngrams.classes(r["text"] or "")), 0, 0]
    squeezed = [c for k, c in enumerate(parts) if c or k < 2 or parts[k - 1] or parts[k - 2]]
    for a, b, c in zip(squeezed, squeezed[1:], squeezed[2:], strict=False):
        want[(a << ngrams.BITS | b) << ngrams.BITS | c] += 1
    # what lies at the edges of batches may count its two signs otherwise
    letters = lambda n: n & 63 and n >> 6 & 63 or n >> 12 and n >> 6 & 63
    assert {k: v for k, v in got.items() if letters(k)} == {k: v for k, v in want.items() if letters(k)} and len(want) > 500


def test_toxicity_equals_plain_sets(spark, tables):  # noqa: F811
    """The query's scores from n-grams as sets of tuples, counted in dictionaries, for every document."""
    d, docs = tables
    table = spark.read.parquet(f"{d}/documents.parquet")
    lm = toxicity.language(table)
    restorer = toxicity.Restorer(lm)
    grams = {i: plain_grams(restorer.restore(r["text"] or "")[1].tolist()) for i, r in docs.items()}
    labels = {}
    for r in spark.read.parquet(f"{d}/labels.parquet").collect():
        if r["toxic"] in (0, 1):
            labels[r["doc_id"]] = max(r["toxic"], labels.get(r["doc_id"], 0))
    known = {i: y for i, y in labels.items() if i in docs and zlib.crc32(str(i).encode()) % 4 != 2}
    seen = [sum(y == k for y in known.values()) for k in (0, 1)]
    assert min(seen) >= 5
    tally = {0: Counter(), 1: Counter()}
    for i, y in known.items():
        tally[y].update({bucket(code(g)) for g in grams[i]})
    gain = {}
    for b in {*tally[0], *tally[1]}:
        lift = math.log((tally[1][b] + 0.1) / (seen[1] + 0.1)) - math.log((tally[0][b] + 0.5) / (seen[0] + 1))
        if tally[1][b] >= min(3, seen[1]) and lift > 1.5:
            gain[b] = tally[1][b] * lift
    chosen = set(sorted(gain, key=lambda b: (-gain[b], b))[: toxicity.FEATURES])
    per = {i: sorted(code(g) for g in grams[i] if bucket(code(g)) in chosen) for i in known}
    counts = Counter(c for v in per.values() for c in v)
    codes = sorted(c for c, n in counts.items() if n >= min(2, len(per)))
    place = {c: k for k, c in enumerate(codes)}
    ids = sorted(known)
    w, b = toxicity.logistic([np.array([place[c] for c in per[i] if c in place], np.int64) for i in ids], np.array([known[i] for i in ids], float), len(codes))
    want = {i: 1 / (1 + math.exp(-(b + sum(w[place[code(g)]] for g in grams[i] if code(g) in place)))) for i in docs}
    got = {r["doc_id"]: r["score"] for r in entry.QUERIES["op8_toxicity"](spark, d).collect()}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1e-6
    assert len(codes) > 20 and len({round(x, 4) for x in want.values()}) > 10


@pytest.mark.parametrize("seed", range(4))
def test_found_equals_plain_sets(seed):
    r = np.random.default_rng(seed)
    texts = [r.integers(0, 4, r.integers(0, 60)).astype(np.uint8) for _ in range(200)]
    every = sorted({code(g) for c in texts[:100] for g in plain_grams(c.tolist())})
    codes = np.array(r.permutation(every)[: len(every) // 3], np.int64)
    model = toxicity.Model(codes, r.normal(size=len(codes)), 0.3)
    weight = dict(zip(model.codes.tolist(), model.weights.tolist(), strict=True))
    for c in texts:
        want = {code(g) for g in plain_grams(c.tolist())} & set(weight)
        assert set(model.codes[model.found(c)].tolist()) == want
        assert model.score(c) == pytest.approx(1 / (1 + math.exp(-(0.3 + sum(weight[x] for x in want)))))


@pytest.mark.parametrize("seed", range(3))
def test_logistic_is_near_the_least_loss(seed):
    """Against Newton's method on the same loss: mean log loss is as low to a hundredth, and predictions agree."""
    r = np.random.default_rng(seed)
    n, m = 40, 400
    x = (r.random((m, n)) < r.uniform(0.02, 0.2, n)).astype(float)
    truth = r.normal(0, 2, n)
    y = (r.random(m) < 1 / (1 + np.exp(-(x @ truth - 1)))).astype(float)
    penalty = 0.5
    w, b = toxicity.logistic([np.flatnonzero(row) for row in x], y, n, penalty=penalty, rounds=1000)
    full = np.hstack([x, np.ones((m, 1))])
    best, reg = np.zeros(n + 1), np.append(np.full(n, penalty), 0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ best))
        best -= np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + np.diag(reg + 1e-9), full.T @ (p - y) + reg * best)

    def loss(v):
        z = full @ v
        return float(np.sum(np.logaddexp(0, z) - y * z) + (reg * v * v).sum() / 2)

    mine = np.append(w, b)
    assert loss(mine) <= loss(best) + 0.01 * m * 0.1
    assert np.abs(1 / (1 + np.exp(-full @ mine)) - 1 / (1 + np.exp(-full @ best))).max() < 0.02
