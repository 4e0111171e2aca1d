"""Benchmark decontamination by a generalised suffix automaton of the test items' normalised words.

Training words stream through the automaton, which tracks the longest match that ends at each word. Where it reaches WINDOW words, those words are
hit; an item of fewer words is hit where all of it occurs. clean() removes the words of hits from the text, or the document where hits cover more
than a limit of it.

The automaton goes to the executors as a broadcast only up to AUTOMATON_WORDS words. More items are dealt into automata of that size, each a pass
that reads the documents and writes keys and hits, no text: memory doesn't grow with the benchmark. clean() merges the hits of all automata before it
judges or cuts a text, so its result doesn't depend on how the items are dealt.

Nulls and edge cases: a null text (of a document or an item) and one without words have no hits and no windows; items of the same words count each;
a null item_id is left out; an empty benchmark hits nothing; empty tables give no rows; extra columns are kept by clean(), left out by hits().
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, cut_lineage, free_name, held, prepare, stored, table, text_of

WINDOW = 10
AUTOMATON_WORDS = 500_000
#: A document whose hit words exceed this share goes as a whole.
COVERAGE = 0.5

_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text: str) -> list[bytes]:
    """Runs of letters, digits and anything beyond ASCII, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class Automaton:
    """Suffix automaton of several word sequences, in arrays: about 50 bytes for each word of the items, and 200 for each distinct one.

    Most states have one move, which lies in `word` and `to`; `more` has the others of the states that branch. No move leads to the root, so 0 is none.
    """

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.word, self.to, self.more = array("i", [-1]), array("i", [0]), {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        sequences = [(item, array("i", [self.ids.setdefault(w, len(self.ids)) for w in words(text)])) for item, text in items]
        for _, sequence in sequences:
            last = 0
            for w in sequence:
                last = self._extend(last, w)
        n = len(self.link)
        order = np.argsort(np.asarray(self.length), kind="stable")[1:].tolist()
        # the state of the last window words, for every state that matches as many
        self.of_window = array("i", bytes(4 * n))
        for v in order:
            if self.length[v] >= window:
                up = self.link[v]
                self.of_window[v] = self.of_window[up] if self.length[up] >= window else v
        at, who = array("i"), array("q")
        self.short: dict[int, list[tuple[int, int]]] = {}
        self.shortest = window
        for item, sequence in sequences:
            v = 0
            for k, w in enumerate(sequence):
                v = self._move(v, w)
                # v's longest text may be longer than this prefix, but of_window is the same for all that reach the window
                if k + 1 >= window:
                    at.append(self.of_window[v])
                    who.append(item)
            if 0 < len(sequence) < window:
                self.short.setdefault(v, []).append((len(sequence), item))
                self.shortest = min(self.shortest, len(sequence))
        # the items of a window's state lie from first[state] on
        pairs = np.unique(np.stack([np.asarray(at, np.int64), np.asarray(who, np.int64)], 1), axis=0)
        self.owners = array("q", pairs[:, 1].tobytes())
        self.first = array("i", np.searchsorted(pairs[:, 0], np.arange(n + 1)).astype("i").tobytes())
        # the nearest state, itself first, of the suffix links at which a short item ends
        self.of_short = array("i", bytes(4 * n))
        if self.short:
            for v in order:
                self.of_short[v] = v if v in self.short else self.of_short[self.link[v]]

    def _move(self, v: int, w: int) -> int:
        if self.word[v] == w:
            return self.to[v]
        more = self.more.get(v)
        return more.get(w, 0) if more else 0

    def _set(self, v: int, w: int, q: int) -> None:
        if self.word[v] == w or self.word[v] < 0:
            self.word[v], self.to[v] = w, q
        else:
            self.more.setdefault(v, {})[w] = q

    def _new(self, length: int, link: int, like: int | None = None) -> int:
        """A state, with the moves of another if given."""
        new = len(self.link)
        self.length.append(length)
        self.link.append(link)
        self.word.append(-1 if like is None else self.word[like])
        self.to.append(0 if like is None else self.to[like])
        if like is not None and like in self.more:
            self.more[new] = dict(self.more[like])
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        """A state for the texts of q that p and w make."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], q)
        self.link[q] = clone
        while p >= 0 and self._move(p, w) == q:
            self._set(p, w, clone)
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if q := self._move(last, w):
            return self._split(last, w, q)
        new, p = self._new(self.length[last] + 1, 0), last
        while p >= 0 and not self._move(p, w):
            self._set(p, w, new)
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self._move(p, w))
        return new

    def hits(self, sequence: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Ranges of words that are hit (from, to; apart and in order), and the items whose windows occur."""
        known = np.fromiter(map(self.ids.get, sequence, repeat(-1)), np.int64, len(sequence))
        edge = np.diff(np.concatenate([[0], known >= 0, [0]]).astype(np.int8))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = ends - begins >= self.shortest
        ranges: list[tuple[int, int]] = []
        items: set[int] = set()
        for begin, end in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
            self._walk(known[begin:end].tolist(), begin, ranges, items)
        return ranges, items

    def _walk(self, ids: list[int], begin: int, ranges: list[tuple[int, int]], items: set[int]) -> None:
        word, to, more, link, length, window, of_short = self.word, self.to, self.more, self.link, self.length, self.window, self.of_short
        v = matched = 0
        seen = -1
        for k, w in enumerate(ids, begin + 1):
            while word[v] != w:
                if v in more and (step := more[v].get(w)):
                    break
                if not v:
                    raise ValueError("a word of the items without a move from the root")
                v = link[v]
                matched = length[v]
            else:
                step = to[v]
            v, matched = step, matched + 1
            reach = 0
            if matched >= window:
                reach = window
                u = self.of_window[v]
                if u != seen:
                    items.update(self.owners[self.first[u] : self.first[u + 1]])
                    seen = u
            s = of_short[v]
            while s:
                for n, item in self.short[s]:
                    if n <= matched:
                        items.add(item)
                        reach = max(reach, n)
                s = of_short[link[s]]
            if reach:
                start = k - reach
                while ranges and ranges[-1][1] >= start:
                    start = min(start, ranges.pop()[0])
                ranges.append((start, k))


def automata(benchmark: DataFrame, window: int = WINDOW, most: int = AUTOMATON_WORDS) -> Iterator[Automaton]:
    """Automata of at most `most` words each (or of one item), read part by part so that the driver holds one at a time."""
    items = benchmark.where("item_id is not null").select(benchmark["item_id"].cast("long").alias("item_id"), text_of(benchmark).alias("text"))
    held: list[tuple[int, str]] = []
    size = 0
    for item, text in items.toLocalIterator():
        n = len(words(text))
        if held and size + n > most:
            yield Automaton(held, window)
            held, size = [], 0
        held.append((item, text))
        size += n
    if held:
        yield Automaton(held, window)


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_HITS = "doc_id long, n_words long, starts array<long>, ends array<long>, items array<long>"
_KEYS = ["key", "check"]


def _keys(docs: DataFrame) -> list[Column]:
    """128 bits that rows share exactly if they have the same doc_id and text (but for chance)."""
    text = text_of(docs)
    return [F.xxhash64(docs["doc_id"], text).alias("key"), F.xxhash64(text, docs["doc_id"]).alias("check")]


def _passed(rows: DataFrame, shared) -> DataFrame:
    """rows (doc_id, text, and the keys or none) -> keys, _HITS of one automaton; no text goes on."""
    keys = [c for c in _KEYS if c in rows.columns]

    def make():
        found = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            out: dict = {"doc_id": batch.column("doc_id"), "n_words": [], "starts": [], "ends": [], "items": []} | {c: batch.column(c) for c in keys}
            for text in batch.column("text"):
                sequence = words(text.as_py())
                ranges, items = found.hits(sequence)
                out["n_words"].append(len(sequence))
                out["starts"].append([r[0] for r in ranges])
                out["ends"].append([r[1] for r in ranges])
                out["items"].append(sorted(items))
            return out

        return work

    return by_batch(rows, ", ".join([*(f"{c} long" for c in keys), _HITS]), make)


def _every_hit(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame | None, DataFrame | None, object]:
    """All rows with their hits of the first automaton, the hits of all others (distinct keys of each; None if there is one automaton), and the last broadcast.

    With several automata each is a pass that reads the documents and writes keys and hits, no text; one automaton is alive at a time.
    """
    spark = prepare(docs.sparkSession)
    keys = _keys(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    keyed = docs.select(*keys, docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    first = others = shared = None
    for automaton in automata(benchmark, window):
        if shared is not None:
            if first is None:
                first = stored(_passed(keyed, shared), "hits")
            else:
                part = stored(_passed(keyed, shared).where(F.size("items") > 0).dropDuplicates(_KEYS), "hits")
                others = part if others is None else others.unionByName(part)
            shared.destroy()
        shared = spark.sparkContext.broadcast(automaton)
        del automaton
    if shared is None:
        return None, None, None
    if first is None:
        return _passed(rows, shared), None, shared
    part = stored(_passed(keyed, shared).where(F.size("items") > 0).dropDuplicates(_KEYS), "hits")
    shared.destroy()
    return first, part if others is None else others.unionByName(part), None


def _joined(first: DataFrame, others: DataFrame) -> DataFrame:
    """first with the hits of the others merged in: a join on keys, of as many arrays for a row as there are automata that hit it."""
    more = others.groupBy(*_KEYS).agg(*(F.flatten(F.collect_list(c)).alias(f"more_{c}") for c in ("starts", "ends", "items")))
    none = F.array().cast("array<bigint>")
    every = first.join(more, _KEYS, "left").select(*_KEYS, "doc_id", "n_words", *(F.concat(c, F.coalesce(f"more_{c}", none)).alias(c) for c in ("starts", "ends", "items")))

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out: dict = {c: batch.column(c) for c in (*_KEYS, "doc_id", "n_words")} | {"starts": [], "ends": [], "items": []}
            for a, b, items in zip(*(batch.column(c).to_pylist() for c in ("starts", "ends", "items")), strict=True):
                ranges = _merged(list(zip(a, b, strict=True)))
                out["starts"].append([r[0] for r in ranges])
                out["ends"].append([r[1] for r in ranges])
                out["items"].append(sorted(set(items)))
            return out

        return work

    return by_batch(every, f"key long, check long, {_HITS}", make)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, starts and ends (array of long: hit ranges of words), items (sorted array of long)."""
    first, others, _ = _every_hit(docs, benchmark, window)
    if first is None:
        first = _passed(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")), docs.sparkSession.sparkContext.broadcast(Automaton([], window)))
    return first if others is None else _joined(first, others).drop(*_KEYS)


def _cut(text: str, ranges: list[tuple[int, int]]) -> tuple[str, int]:
    """text without the words of ranges (and what lies between them); the words it lost."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in ranges:
        out.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return "".join([*out, text[at:]]), sum(b - a for a, b in ranges)


def without(text: str, find) -> tuple[str, int, int]:
    """text without the words of hits, until none is left; the words it had and lost. find: words -> ranges."""
    sequence = words(text)
    total, lost = len(sequence), 0
    while ranges := find(sequence):
        text, n = _cut(text, ranges)
        lost += n
        sequence = words(text)
    return text, total, lost


def _cleaned(docs: DataFrame, shared, coverage: float) -> DataFrame:
    """clean() by one automaton that holds all items."""
    names = docs.columns
    mark = free_name(docs, "_lost")

    @F.pandas_udf("text string, share double")
    def cut(texts):
        import pandas as pd

        held(__name__, dict)
        found, out = shared.value, []
        for text in texts:
            if text is None:
                out.append((None, 0.0))
                continue
            new, total, lost = without(text, lambda s: found.hits(s)[0])
            out.append((new, lost / total if total else 0.0))
        return pd.DataFrame(out, columns=["text", "share"])

    # not to be pushed below the condition: that would run it twice, each time in a worker with the automaton
    docs = docs.withColumn(mark, cut.asNondeterministic()(docs["text"])).where(F.col(f"{mark}.share") <= coverage)
    return docs.select(*(F.col(f"{mark}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in names))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """docs without hit words; without the documents of which hits cover more than coverage. Documents without hits stay as they are.

    With more than one automaton, the hits of all are merged before any word is cut; the documents that were cut go round again until no automaton
    hits them. So neither the result nor the memory depends on how many automata there are. Hits meet their texts by a join on keys.
    """
    names = docs.columns
    key, check, lost, total, new = (free_name(docs, x) for x in ("_key", "_check", "_lost", "_total", "_new"))
    at = free_name(docs, "_at")

    @F.pandas_udf("text string, n long, words long")
    def cut(texts, starts, ends):
        import pandas as pd

        out = []
        for text, a, b in zip(texts, starts, ends, strict=True):
            less, n = _cut(text, list(zip(a.tolist(), b.tolist(), strict=True)))
            out.append((less, n, len(words(text))))
        return pd.DataFrame(out, columns=["text", "n", "words"])

    todo = docs.withColumns({"text": docs["text"].cast("string"), lost: F.lit(0).cast("long"), total: F.lit(None).cast("long")})
    done: DataFrame | None = None
    while True:
        first, others, shared = _every_hit(todo, benchmark, window)
        if first is None:
            return docs
        if done is None and others is None:
            return _cleaned(docs, shared, coverage)
        marks = stored(_joined(first, others).where(F.size("items") > 0).dropDuplicates(_KEYS).select(F.col("key").alias(key), F.col("check").alias(check), F.struct("starts", "ends").alias(at)), "marks")
        keys = _keys(todo)
        marked = todo.withColumns({key: keys[0], check: keys[1]})
        whole = marked.join(marks, [key, check], "left_anti").select(*(F.col(f"`{c}`") for c in names))
        done = whole if done is None else done.unionByName(whole)
        hit = marked.join(marks, [key, check]).withColumn(new, cut.asNondeterministic()(F.col("text"), F.col(f"{at}.starts"), F.col(f"{at}.ends")))
        hit = hit.withColumns({"text": F.col(f"{new}.text"), lost: F.col(lost) + F.col(f"{new}.n"), total: F.coalesce(F.col(total), F.col(f"{new}.words"))}).drop(new, at, key, check)
        todo = cut_lineage(hit.where(F.col(lost) / F.col(total) <= coverage))
        if todo.isEmpty():
            return done


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's hits against all items of benchmark."""
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(F.zip_with("ends", "starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    text = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(text, 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH items AS (
  SELECT item_id, {_WORDS_SQL} AS words FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least({WINDOW}, len(words)) AS n, array_to_string(words[i:i + least({WINDOW}, len(words)) - 1], ' ') AS k FROM items, unnest(range(1, len(words) - least({WINDOW}, len(words)) + 2)) AS t(i) WHERE len(words) > 0
), docs AS (
  SELECT doc_id, {_WORDS_SQL} AS words FROM documents
), places AS (
  SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS k FROM docs, (SELECT DISTINCT n FROM windows), unnest(range(1, len(words) - n + 2)) AS t(i)
), met AS (
  SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, k)
), hit AS (
  SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM met, unnest(range(n)) AS t(o) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""
