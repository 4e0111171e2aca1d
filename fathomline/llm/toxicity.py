"""Toxicity by a noisy channel: decode obfuscated words by Viterbi, then score the restored text.

Language model: counts of character trigrams over all documents. Channel: a look-alike sign stands for one of a few letters, a star for any, a run
of three or more equal letters for one or two of them, and single letters with separators between them for the letters. The stretches of a text
where the channel may have acted form lattices; the best path replaces the stretch.

Score: logistic regression over the presence of character n-grams (4 to 6, word ends included) in the restored text. It is fitted on at most about
SAMPLE distinct labelled rows, taken by a hash of doc_id and text; features are chosen by their lift in that sample.

Nulls and edge cases: a null or empty text has no features and gets the base score; labels without a document or a 0/1 value are left out; with no
label of one kind the score is the share of the other; doc_ids that repeat in labels count once (label 1 if any is); repeated documents are learnt from
once, and documents that share a doc_id each have its label; extra columns are left out.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache, cached_property, lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, by_batch, draw_of, free_name, held, prepare, stored, table, text_of
from .ngrams import BITS, classes, code_points, grams

#: Labelled rows that the classifier is fitted on, at most (but for the chance of the hash).
SAMPLE = 20_000
THRESHOLD = 0.3
SIZES = (4, 5, 6)
#: Features that the classifier keeps.
FEATURES = 512
_BUCKET_BITS = 22
#: Labelled rows of one task of the fit.
_PART_ROWS = 1000

# Signs and the letters that they stand for.
LOOK_ALIKE = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c",
}
INVISIBLE = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
_INVISIBLE = [chr(c) for c in INVISIBLE]
LETTERS = "abcdefghijklmnopqrstuvwxyz"

_SIGNS = "".join(re.escape(s) for s in LOOK_ALIKE)
_MIXED = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{_SIGNS}*](?=[{_SIGNS}*]*[^\W\d_])|[0-9$@])*|[{_SIGNS}]+[^\W\d_](?:[^\W\d_]|[{_SIGNS}*](?=[{_SIGNS}*]*[^\W\d_])|[0-9$@])*")
_SPREAD = re.compile(rf"(?<!\w)(?:[^\W_]|[{_SIGNS}])(?:([ ._*-])(?:[^\W_]|[{_SIGNS}]))(?:\1(?:[^\W_]|[{_SIGNS}])){{2,}}(?!\w)")
_RUN = re.compile(r"([^\W\d_])\1{2,}")
#: Stretches of up to this many characters are remembered when decoded; longer ones are decoded each time, so that no worker keeps them.
REMEMBERED = 40
#: Steps of as many paths (say, through stars) are taken in arrays.
_WIDE = 256
_COST = {"sign": -1.0, "star": -4.0, "run": -0.7, "join": -0.5, "keep": -2.0}


class Language:
    """Trigram model of character classes, with half a count added to each."""

    def __init__(self, counts: np.ndarray):
        """counts: of the trigrams, as long as there are trigrams."""
        n = 1 << BITS
        c = counts.reshape(n, n, n).astype(np.float64)
        self.log = np.log((c + 0.5) / (c.sum(2, keepdims=True) + 0.5 * n)).astype(np.float32).ravel()

    @cached_property
    def table(self) -> list[float]:
        return self.log.tolist()

    def __getstate__(self) -> dict:
        return {"log": self.log}


def trigram_counts(docs: DataFrame) -> DataFrame:
    """docs (text) -> gram, n: the counts of all character trigrams of all texts, stretches of other signs taken as one."""
    prepare(docs.sparkSession)
    schema = arrow_schema("gram long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(__name__, dict)
        counts = np.zeros(1 << 3 * BITS, np.int64)
        edge = np.zeros(2, np.uint8)
        for batch in batches:
            parts = [edge]
            for text in batch.column(0):
                parts += [classes(text.as_py()), edge]
            c = np.concatenate(parts)
            c = c[(c > 0) | np.concatenate([[True], c[:-1] > 0]) | np.concatenate([[True, True], c[:-2] > 0])]  # two signs at most between words
            counts += np.bincount(grams(c, 3), minlength=len(counts))
        seen = np.flatnonzero(counts)
        for k in range(0, len(seen), 10_000):
            part = seen[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(counts[part], pa.int64())], schema=schema)

    return docs.select(text_of(docs).alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language(docs: DataFrame) -> Language:
    """The table has at most 2**18 rows, whatever the documents."""
    counts = np.zeros(1 << 3 * BITS, np.float64)
    rows = trigram_counts(docs).toPandas()
    counts[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return Language(counts)


@cache
def _class(letter: str) -> int:
    return int(classes(letter)[0])


def lattice(stretch: str) -> Iterator[list[tuple[str, float]]]:
    """For each place the strings it may stand for, with their costs."""
    spread = bool(_SPREAD.fullmatch(stretch))
    k = 0
    while k < len(stretch):
        ch = stretch[k]
        low = ch.lower()
        if spread and k % 2:
            yield [("", _COST["join"]), (" ", _COST["keep"])]
        elif ch.isalpha():
            run = k + 1
            while run < len(stretch) and stretch[run].lower() == low:
                run += 1
            if run - k >= 3:
                yield [(low, _COST["run"]), (low * 2, _COST["run"])]
                k = run
                continue
            yield [(low, 0.0)]
        elif ch in LOOK_ALIKE:
            yield [*((x, _COST["sign"]) for x in LOOK_ALIKE[ch]), (" ", _COST["keep"] * 3)]
        elif ch == "*":
            yield [*((x, _COST["star"]) for x in LETTERS), (" ", _COST["keep"] * 3)]
        else:
            yield [(" ", 0.0)]
        k += 1


def _wide(states: dict[int, tuple[float, int]], options: list[tuple[str, float]], lm: Language) -> tuple[dict[int, tuple[float, int]], array, array]:
    """A step whose options are single signs: what decode() does for each state and option, in arrays for each class that the states end with."""
    ends = np.array([_class(string) for string, _ in options])
    costs = np.array([cost for _, cost in options])
    codes, scores = np.fromiter(states, np.int64, len(states)), np.array([score for score, _ in states.values()])
    new: dict[int, tuple[float, int]] = {}
    came, chose = array("H"), array("B")
    last = codes & (1 << BITS) - 1
    for c in dict.fromkeys(last.tolist()):
        at = np.flatnonzero(last == c)
        paths = scores[at, None] + costs + lm.log[codes[at, None] << BITS | ends]
        best = paths.argmax(0)
        for k, (i, end) in enumerate(zip(best.tolist(), ends.tolist(), strict=True)):
            new[c << BITS | end] = (float(paths[i, k]), len(came))
            came.append(int(at[i]))
            chose.append(k)
    return new, came, chose


def decode(stretch: str, lm: Language) -> str:
    """The best path through the stretch's lattice, by back-pointers; where all paths meet in one state, what lies before is settled."""
    log = lm.table
    states: dict[int, tuple[float, int]] = {0: (0.0, 0)}  # by the last two classes: score, and number among the step's states
    settled: list[str] = []
    steps: list[tuple[list[tuple[str, float]], array, array]] = []  # since then: options, and for each state the one it came from and its option

    def path(k: int) -> str:
        out = []
        for options, came, chose in reversed(steps):
            out.append(options[chose[k]][0])
            k = came[k]
        return "".join(reversed(out))

    for options in chain(lattice(stretch), [[(" ", 0.0)]]):
        if len(states) * len(options) > _WIDE and all(len(string) == 1 for string, _ in options):
            states, came, chose = _wide(states, options, lm)
        else:
            new: dict[int, tuple[float, int]] = {}
            came, chose = array("H"), array("B")
            for before, (state, (score, _)) in enumerate(states.items()):
                for option, (string, cost) in enumerate(options):
                    x, s = state, score + cost
                    for ch in string:
                        c = _class(ch)
                        s += log[x << BITS | c]
                        x = (x << BITS | c) & 0xFFF
                    if x not in new:
                        new[x] = (s, len(came))
                        came.append(before)
                        chose.append(option)
                    elif new[x][0] < s:
                        k = new[x][1]
                        new[x] = (s, k)
                        came[k], chose[k] = before, option
            states = new
        steps.append((options, came, chose))
        if len(states) == 1:
            settled.append(path(0))
            steps.clear()
    top = max(score for score, _ in states.values())
    return ("".join(settled) + max(path(k) for score, k in states.values() if score == top)).strip()


class Restorer:
    def __init__(self, lm: Language):
        self.decode, self.remembered = lambda s: decode(s, lm), lru_cache(50_000)(lambda s: decode(s, lm))
        self.sign, self.trailing = np.zeros(0x20AD, bool), np.zeros(0x20AD, bool)
        self.sign[[*map(ord, LOOK_ALIKE), ord("*")]] = True
        self.trailing[[*map(ord, "0123456789@$")]] = True

    def _one(self, m: re.Match) -> str:
        s = m.group()
        if s.isalpha() and not _RUN.search(s.lower()) or not any(c.isalpha() for c in s):
            return s
        return self.remembered(s) if len(s) <= REMEMBERED else self.decode(s)

    def restore(self, text: str) -> tuple[str, np.ndarray]:
        """The text without disguises, and its classes. Only words with a trace of a disguise are decoded."""
        if not text.isascii() and any(map(text.__contains__, _INVISIBLE)):
            text = text.translate(INVISIBLE)
        points = np.minimum(code_points(text), 0x20AC)
        c = classes(text)
        if len(c) < 3:
            return text, c
        letter, sign = c > 0, self.sign[points]
        alone = letter | sign
        alone[1:] &= ~letter[:-1]
        alone[:-1] &= ~letter[1:]
        if len(c) > 6 and (alone[4:] & alone[2:-2] & alone[:-4] & ~letter[1:-3] & ~letter[3:-1]).any():
            new = _SPREAD.sub(self._one, text)
            if new != text:
                text = new
                points, c = np.minimum(code_points(text), 0x20AC), classes(text)
                letter, sign = c > 0, self.sign[points]
        if len(c) < 3:
            return text, c
        # a sign before a letter, one or two after a letter (three and more are ornament), three equal letters
        trace = np.zeros(len(c), bool)
        trace[:-1] |= sign[:-1] & letter[1:]
        three = np.zeros(len(c), bool)
        three[:-2] = (points[:-2] == points[1:-1]) & (points[1:-1] == points[2:])
        trace[1:] |= self.trailing[points[1:]] & letter[:-1] & ~three[1:]
        trace[2:] |= letter[2:] & (c[2:] == c[1:-1]) & (c[1:-1] == c[:-2])
        at = np.flatnonzero(trace)
        if not len(at):
            return text, c
        blanks = np.concatenate([[-1], np.flatnonzero(points <= 0x20), [len(c)]])
        words = np.unique(np.searchsorted(blanks, at, "right"))
        out, done = [], 0
        for k in words.tolist():
            a, b = int(blanks[k - 1]) + 1, int(blanks[k])
            out += [text[done:a], _MIXED.sub(self._one, text[a:b])]
            done = b
        text = "".join([*out, text[done:]])
        return text, classes(text)


def features(c: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """The distinct n-grams (in a bucket of mask, if given) of a restored text's classes, framed by word ends, with their size in the low bits."""
    c = np.concatenate([[0], c, [0]]).astype(np.uint8)
    out = []
    for n in SIZES:
        g = grams(c, n) << 3 | n
        out.append(np.unique(g if mask is None else g[mask[_bucket(g)]]))
    return np.concatenate(out)


def _bucket(codes: np.ndarray) -> np.ndarray:
    return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BUCKET_BITS)).view(np.int64)


class Model:
    """Weights of n-grams, each of at least SIZES[0] characters; the first so many of them tell where to look."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, base: float):
        order = np.argsort(codes)
        self.codes, self.weights, self.base = codes[order], weights[order], base

    @cached_property
    def heads(self) -> np.ndarray:
        """For each n-gram of SIZES[0] characters whether one of the codes begins with it."""
        out = np.zeros(1 << BITS * SIZES[0], bool)
        size = self.codes & 7
        out[(self.codes >> 3) >> BITS * (size - SIZES[0])] = True
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "heads"}

    def found(self, c: np.ndarray) -> np.ndarray:
        """Places in codes of the n-grams that occur."""
        if not len(self.codes):
            return np.zeros(0, np.int64)
        c = np.concatenate([[0], c, [0] * SIZES[-1]]).astype(np.uint8)
        end = len(c) - SIZES[-1] + 1  # the frame's end
        at = np.flatnonzero(self.heads[grams(c[:end], SIZES[0])])
        g, out = grams(c, SIZES[0])[at] if len(at) else np.zeros(0, np.int64), []
        for n in SIZES:
            if n > SIZES[0]:
                g = g << BITS | c[at + n - 1]
            inside = at + n <= end
            code = g[inside] << 3 | n
            place = np.searchsorted(self.codes, code)
            place[place == len(self.codes)] = 0
            out.append(place[self.codes[place] == code])
        return np.unique(np.concatenate(out))

    def score(self, c: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.base + self.weights[self.found(c)].sum()))))


def logistic(rows: list[np.ndarray], y: np.ndarray, n: int, penalty: float = 0.005, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and base of n features by accelerated gradient descent; rows: the features of each row."""
    size = np.array([len(r) for r in rows])
    at, who = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64), np.repeat(np.arange(len(rows)), size)
    w, b = np.zeros(n), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    seen = np.maximum(1, np.bincount(at, minlength=n))
    moved, pace = np.zeros(n), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(who, w[at], len(y)), -30, 30)))
        g = np.bincount(at, (p - y)[who], n) + penalty * w
        # steps scaled by how often a feature occurs and how many share a row
        step = -g / (0.25 * seen * max(1.0, size.mean()) ** 0.5 + penalty)
        moved = 0.8 * moved + step
        pace = 0.8 * pace - (p - y).mean() / max(1e-3, (p * (1 - p)).mean()) * 0.2
        w, b = w + 0.3 * moved, b + 0.3 * pace
    return w, b


def fit(docs: DataFrame, labels: DataFrame, lm: Language, sample: int = SAMPLE) -> Model:
    """labels (doc_id, toxic): those to learn from."""
    spark = prepare(docs.sparkSession)
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    texts = docs.select("doc_id", text_of(docs).alias("text"))
    draw = draw_of(texts)
    # labelled rows are told by their hash alone; only texts of the sample are shuffled
    n = texts.select("doc_id", draw.alias("draw")).join(marks, "doc_id").agg(F.approx_count_distinct("draw", 0.02)).first()[0]
    drawn = texts.withColumn("draw", draw).where(F.pmod("draw", F.lit(1 << 30)) < round(min(1.0, sample / max(1, n)) * (1 << 30)))
    parts = max(1, -(-min(n, sample) // _PART_ROWS))
    rows = stored(drawn.join(marks, "doc_id").dropDuplicates(["draw"]).select("y", "text").repartition(parts), "labelled")
    shared = spark.sparkContext.broadcast(lm)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, seen, restorer = np.zeros((2, 1 << _BUCKET_BITS), np.uint32), [0, 0], Restorer(shared.value)
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tally[y][np.unique(_bucket(features(restorer.restore(text.as_py())[1])))] += 1
                seen[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(tally.tobytes(), 1)]), pa.array([seen[0]], pa.int64()), pa.array([seen[1]], pa.int64())], names=["tally", "n0", "n1"])

    # a row of a fixed size for each part, written by all parts at once and read one by one
    tally, seen = np.zeros((2, 1 << _BUCKET_BITS), np.uint32), np.zeros(2)
    for part, n0, n1 in stored(rows.mapInArrow(count, "tally binary, n0 long, n1 long"), "tallies").toLocalIterator():
        tally += np.frombuffer(zlib.decompress(part), np.uint32).reshape(2, -1)
        seen += n0, n1
    if not seen.all():
        return Model(np.zeros(0, np.int64), np.zeros(0), 20.0 if seen[1] else -20.0 if seen[0] else 0.0)
    lift = np.log((tally[1] + 0.1) / (seen[1] + 0.1)) - np.log((tally[0] + 0.5) / (seen[0] + 1))
    gain = np.where((tally[1] >= min(3, seen[1])) & (lift > 1.5), tally[1] * lift, 0)
    del lift
    chosen = np.argsort(-gain, kind="stable")[:FEATURES]
    chosen = np.sort(chosen[gain[chosen] > 0])
    mask = np.zeros(1 << _BUCKET_BITS, bool)
    mask[chosen] = True

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            out = []
            for text in batch.column(1):
                out.append(features(restorer.restore(text.as_py())[1], mask).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["y", "codes"])

    found = rows.mapInArrow(pick, "y long, codes array<long>").toPandas()
    y = found["y"].to_numpy(np.float64)
    per = [np.asarray(c, np.int64) for c in found["codes"]]
    codes, counts = np.unique(np.concatenate(per), return_counts=True)
    # of the n-grams that share a chosen bucket, and of nested ones, all stay: the penalty shares the weight among them
    codes = codes[counts >= min(2, len(per))]
    at = [np.searchsorted(codes, c[np.isin(c, codes)]) for c in per]
    w, b = logistic(at, y, len(codes))
    return Model(codes, w, b)


def scored(docs: DataFrame, lm: Language, model: Model, keep: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score; with keep also restored, the text that was scored."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((lm, model))

    def make():
        restorer, weigh = Restorer(shared.value[0]), shared.value[1].score

        def work(batch: pa.RecordBatch) -> dict:
            texts = [restorer.restore(t.as_py()) for t in batch.column(1)]
            return {"doc_id": batch.column(0), "score": [weigh(c) for _, c in texts], "restored": [t for t, _ in texts] if keep else [None] * len(texts)}

        return work

    out = by_batch(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")), "doc_id long, score double, restored string", make)
    return out if keep else out.drop("restored")


def filtered(docs: DataFrame, lm: Language, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((lm, model))
    mark = free_name(docs, "_score")

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held(__name__, dict)
        restorer, weigh = Restorer(shared.value[0]), shared.value[1].score
        for texts in parts:
            yield pd.Series([weigh(restorer.restore(t)[1]) for t in texts], dtype=float)

    return docs.withColumn(mark, score(text_of(docs))).where(F.col(mark) < threshold).select(*(F.col(f"`{c}`") for c in docs.columns))


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def learnt(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[Language, Model]:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    lm = language(docs)
    return lm, fit(docs, labels.where(~held_out(labels["doc_id"])), lm)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score."""
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, *learnt(spark, docs, sf_dir))
    return out.select("doc_id", F.coalesce(held_out(out["doc_id"]), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
