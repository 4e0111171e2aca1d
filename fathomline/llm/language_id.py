"""Language identification by string kernels.

Kernel: the blended-spectrum presence kernel of two texts is the number of distinct character n-grams (of all SIZES) they share, over the geometric mean
of the numbers that each has. Nyström: LANDMARKS texts, as many of each language, span the feature space. One kernel ridge regression for each language
against the rest is fitted there. As the kernel is linear in a text's presence vector, landmarks and weights multiply out to one matrix (n-grams x
languages); batches of presence vectors are scored by a product with it.

At most about TRAIN distinct rows of each language and LANDMARKS in all are learnt from, taken by a hash of doc_id and text; memory is bounded by
these and by the 2**18 n-grams that there can be.

Nulls and edge cases: a null text or one without a letter is `und` with score 0; rows with a null lang teach nothing; with no row to learn from all
are `und`; with one language all texts with a letter are of it; repeated rows are learnt from once; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, draw_of, stored, table, text_of
from .ngrams import BITS, classes, grams

SIZES = (1, 2, 3)
#: Rows of each language to learn from, and landmarks of all.
TRAIN, LANDMARKS = 1000, 192
RIDGE = 1e-3
#: What the decision values are multiplied with before the softmax that makes the score.
SHARPNESS = 6.0
_AT = np.cumsum([0, *(1 << BITS * n for n in SIZES)])


class Presence:
    """Distinct n-grams of a text, as numbers below _AT[-1]."""

    def __init__(self):
        self.flags = np.zeros(_AT[-1], bool)

    def __call__(self, c: np.ndarray) -> np.ndarray:
        c = c[(c > 0) | np.concatenate([[True], c[:-1] > 0])]  # signs and blanks between words are one
        c = np.concatenate([[0], c, [0]]).astype(np.uint8)
        for n, at in zip(SIZES, _AT, strict=False):
            self.flags[at + grams(c, n)] = True
        found = np.flatnonzero(self.flags)
        self.flags[found] = False
        return found


class Model:
    def __init__(self, languages: list[str], vocabulary: np.ndarray, weights: np.ndarray, base: np.ndarray):
        """weights: of the vocabulary's n-grams for each language."""
        self.languages, self.vocabulary, self.weights, self.base = languages, vocabulary, weights.astype(np.float32), base
        self.place = np.full(_AT[-1], -1, np.int32)
        self.place[vocabulary] = np.arange(len(vocabulary), dtype=np.int32)

    def decisions(self, sets: list[np.ndarray], block: int = 64) -> np.ndarray:
        """A row of values for each presence set."""
        out = []
        for k in range(0, len(sets), block):
            part = sets[k : k + block]
            matrix = np.zeros((len(part), len(self.vocabulary)), np.float32)
            for row, s in enumerate(part):
                at = self.place[s]
                matrix[row, at[at >= 0]] = 1 / np.sqrt(len(s))
            out.append(matrix @ self.weights + self.base)
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))


def kernel(sets: list[np.ndarray], landmarks: np.ndarray, place: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Of each set with each landmark; landmarks: their presence (rows) of n-grams (columns)."""
    matrix = np.zeros((len(sets), landmarks.shape[1]), np.float32)
    for row, s in enumerate(sets):
        at = place[s]
        matrix[row, at[at >= 0]] = 1 / np.sqrt(max(1, len(s)))
    return matrix @ landmarks.T / norms


def fit(docs: DataFrame, train: int = TRAIN, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """docs (doc_id, text, lang): the rows to learn from; None if there are none."""
    rows = docs.select(docs["doc_id"], text_of(docs).alias("text"), docs["lang"].cast("string").alias("lang")).where("lang is not null and text is not null")
    rows = rows.withColumn("hash", draw_of(rows))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("hash", 0.02).alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    each = -(-landmarks // len(languages))
    draw = F.pmod("hash", F.lit(1 << 30)) / float(1 << 30)
    n = F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair))[F.col("lang")]

    def sets():
        find = Presence()

        def work(batch: pa.RecordBatch) -> dict:
            return {"lang": batch.column(1), "mark": batch.column(2), "grams": [find(classes(t.as_py())).tolist() for t in batch.column(0)]}

        return work

    sample = rows.withColumn("draw", draw * n).where(F.col("draw") < train).dropDuplicates(["hash", "lang"]).select("text", "lang", (F.col("draw") < each).alias("mark"))
    found = stored(by_batch(sample, "lang string, mark boolean, grams array<int>", sets), "presence")
    marks = [np.asarray(r["grams"], np.int64) for r in found.where("mark").select("grams").toLocalIterator()]
    marks = [m for m in marks if len(m)]
    if not marks:
        marks = [np.zeros(1, np.int64)]
    vocabulary = np.unique(np.concatenate(marks))
    place = np.full(_AT[-1], -1, np.int32)
    place[vocabulary] = np.arange(len(vocabulary), dtype=np.int32)
    matrix = np.zeros((len(marks), len(vocabulary)), np.float32)
    for row, m in enumerate(marks):
        matrix[row, place[m]] = 1
    norms = np.sqrt(matrix.sum(1))
    shared = docs.sparkSession.sparkContext.broadcast((matrix, place, norms))

    def values():
        def work(batch: pa.RecordBatch) -> dict:
            k = [kernel([np.asarray(g.as_py(), np.int64)], *shared.value)[0].tolist() for g in batch.column(1)]
            return {"lang": batch.column(0), "k": k}

        return work

    frame = by_batch(found.select("lang", "grams"), "lang string, k array<float>", values).toPandas()
    k = np.stack([np.asarray(v, np.float64) for v in frame["k"]])
    y = np.where(frame["lang"].to_numpy()[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    own = kernel(marks, matrix, place, norms).astype(np.float64)
    values_, vectors = np.linalg.eigh((own + own.T) / 2)
    good = values_ > 1e-6 * values_.max()
    root = vectors[:, good] / np.sqrt(values_[good])
    phi = k @ root
    # rows weigh so that each language has the same weight; the base is the weighted mean's
    share = 1 / (y > 0).sum(0)
    weight = (np.where(y > 0, share, 0)).sum(1) / len(languages)
    mean, target = weight @ phi, weight @ y
    x = phi - mean
    w = np.linalg.solve((x * weight[:, None]).T @ x + ridge * np.eye(x.shape[1]), (x * weight[:, None]).T @ (y - target))
    return Model(languages, vocabulary, (matrix / norms[:, None]).T @ (root @ w), target - mean @ w)


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        found, find = shared.value, Presence()

        def work(batch: pa.RecordBatch) -> dict:
            arrays = [classes(t.as_py()) for t in batch.column(1)]
            lettered = [k for k, c in enumerate(arrays) if c.any()] if found else []
            names, scores = ["und"] * len(arrays), [0.0] * len(arrays)
            if lettered:
                f = SHARPNESS * found.decisions([find(arrays[k]) for k in lettered]).astype(np.float64)
                p = np.exp(f - f.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                for k, best, score in zip(lettered, p.argmax(1), p.max(1), strict=True):
                    names[k], scores[k] = found.languages[best], float(score)
            return {"doc_id": batch.column(0), "lang_pred": names, "score": scores}

        return work

    return by_batch(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")), "doc_id long, lang_pred string, score double", make)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    docs = table(spark, sf_dir, "documents")
    out = identified(docs, fit(docs.where(~held_out(docs["doc_id"]))))
    return out.select("doc_id", held_out(out["doc_id"]).alias("held_out"), "lang_pred", "score")
