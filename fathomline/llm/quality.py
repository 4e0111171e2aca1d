"""Quality rules as a short-circuit cascade.

Each rule looks at one text and rejects it or not. On a sample of at most about SAMPLE distinct documents, taken by a hash of doc_id and text, every
rule is run alone and timed; rules then run in the order of rejections per second, and the first that rejects a document ends its cascade. Only the
cost depends on the order and so on the clock: verdicts, and reasons, which are in declared order, don't.

Nulls and edge cases: a null text has no words (as has an empty one) and is rejected for its length; repeated rows are judged alike and count once in
the sample, whatever their doc_id; with an empty sample the declared order stands; extra columns pass through filtered() and are left out by judged().
"""

from __future__ import annotations

import operator
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, free_name, prepare, sampled, table, text_of

SAMPLE = 500
WINDOW = 5
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


class Text:
    """A text's measures, each found when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, _SYMBOLS))

    @cached_property
    def _lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(_BLANKS)]

    @cached_property
    def n_lines(self) -> int:
        return len(self._lines)

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self._lines) - len(set(self._lines))

    @cached_property
    def n_stutter(self) -> int:
        """Words equal to the word before them."""
        return sum(map(operator.eq, self.words, self.words[1:]))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of WINDOW words that occur twice or more."""
        n = len(self.words)
        if n <= WINDOW:
            return 0
        first: dict[bytes, int] = {}
        ids = np.fromiter(map(first.setdefault, self.words, range(n)), np.int64, n)
        if len(first) == n:
            return 0
        if float(n) ** WINDOW < 2**62:
            code = ids[: n - WINDOW + 1].copy()
            for k in range(1, WINDOW):
                code = code * n + ids[k : n - WINDOW + 1 + k]
        else:
            code = ids
            for k in range(1, WINDOW):  # each step numbers the windows of one word more
                code = np.unique(code[:-1] * n + ids[k:], return_inverse=True)[1]
        _, number, count = np.unique(code, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(count[number] > 1)
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + WINDOW, -1)
        return int(np.count_nonzero(np.cumsum(edge[:n])))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: The first two are the base. A star or bar after many words, shouting, lines over and over, and words of odd length are signs of junk.
RULES = (
    Rule("few_words", lambda t: t.n_words < 10),
    Rule("repeats", lambda t: 100 * t.n_repeat_words > 20 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.word_chars),
    Rule("bars", lambda t: 20 * t.text.count("|") > 3 * t.n_words),
    Rule("shouting", lambda t: 2 * t.text.count("!") > t.n_words),
    Rule("dup_lines", lambda t: t.n_dup_lines >= 3 and 10 * t.n_dup_lines > 3 * t.n_lines),
    Rule("stutter", lambda t: 4 * t.n_stutter > t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> tuple[Rule, ...]:
    """rules by rejections per second on a sample of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    picked = sampled(docs.select("doc_id", text_of(docs).alias("text")), sample)

    def run(batches):
        spent, gone = [0.0] * len(rules), [0] * len(rules)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for k, rule in enumerate(rules):
                    t = Text(text)
                    began = time.perf_counter()
                    gone[k] += bool(rule.rejects(t))
                    spent[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(spent, pa.float64()), pa.array(gone, pa.int64())], names=["rule", "spent", "gone"])

    measured = picked.select("text").mapInArrow(run, "rule int, spent double, gone long").groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("gone").alias("gone")).collect()
    worth = {r["rule"]: r["gone"] / max(r["spent"], 1e-9) for r in measured}
    return tuple(rules[k] for k in sorted(range(len(rules)), key=lambda k: -worth.get(k, 0.0)))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, measures: tuple[str, ...] = (), reasons: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, the measures asked for, kept; with reasons also rejected_by: the first of RULES (then of other rules) that rejects, or null.

    A reason costs the rules declared before it once more, for rejected documents only.
    """
    declared = sorted(rules, key=lambda r: RULES.index(r) if r in RULES else len(RULES))

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out: dict = {"doc_id": batch.column(0), "kept": []} | {m: [] for m in measures} | ({"rejected_by": []} if reasons else {})
            for text in batch.column(1):
                t = Text(text.as_py())
                kept = not any(r.rejects(t) for r in rules)
                out["kept"].append(kept)
                if reasons:
                    out["rejected_by"].append(None if kept else next(r.name for r in declared if r.rejects(t)))
                for m in measures:
                    out[m].append(getattr(t, m))
            return out

        return work

    ddl = ", ".join(["doc_id long", *(f"{m} long" for m in measures), "kept boolean", *(["rejected_by string"] if reasons else [])])
    return by_batch(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")), ddl, make)


def filtered(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """The rows of docs that no rule rejects, in the order measured on docs unless rules are given."""
    prepare(docs.sparkSession)
    rules = rules or order(docs)
    mark = free_name(docs, "_kept")

    @F.pandas_udf("boolean")
    def keep(texts):
        import pandas as pd

        return pd.Series([not any(r.rejects(t) for r in rules) for t in map(Text, texts)], dtype=bool)

    return docs.withColumn(mark, keep(text_of(docs))).where(F.col(mark)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and verdict."""
    docs = table(spark, sf_dir, "documents")
    out = judged(docs, order(docs), MEASURES)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("doc_id", *MEASURES, failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS k FROM w, unnest(range(1, len(words) - 3)) AS t(i)
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM twice, unnest(range(5)) AS t(o) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, length(text) - length(replace(text, '|', '')) AS bars, length(text) - length(replace(text, '!', '')) AS shouts,
    len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS stutter FROM w LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 10 * n_symbols > word_chars OR 20 * bars > 3 * n_words OR 2 * shouts > n_words
  OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines) OR 4 * stutter > n_words OR NOT (word_chars BETWEEN 2 * n_words AND 15 * n_words)) AS kept FROM f
"""
