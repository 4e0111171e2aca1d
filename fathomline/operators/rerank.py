"""Weighted rerank and the demotion of near-duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import jaccard, tokens, unpacked

NEAR, FACTOR, SPAN_DAYS = 0.55, 0.88, 1095


def freshness(raw: Column, as_of: Column) -> Column:
    """1 for today down to 0 after three years, 0.4 without a date; as_of stands for today."""
    day = F.substring(raw, 1, 10)
    # of other shapes each would be an exception
    age = F.datediff(as_of, F.when(day.rlike(r"^[+-]?\d{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"), F.try_to_date(day, "yyyy-MM-dd")))
    return F.when(age.isNull(), 0.4).otherwise(F.greatest(1 - F.greatest(age, F.lit(0)) / SPAN_DAYS, F.lit(0.0)))


def terms(question: Column, stopwords: list[str] = R.STOPWORDS) -> Column:
    """The question's words: no stopwords; those with hyphens in their parts."""
    parts = F.flatten(F.transform(F.filter(tokens(question), lambda t: ~t.isin(stopwords)), lambda t: F.split(t, "-")))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def share(words: Column, have: Column) -> Column:
    """The share of words that are in `have`."""
    return F.when(F.size(words) > 0, F.size(F.array_intersect(have, words)) / F.size(words)).otherwise(0.0)


def overlap(question: Column, text: Column, stopwords: list[str] = R.STOPWORDS) -> Column:
    """The share of the question's terms that the text has."""
    return share(terms(question, stopwords), tokens(text))


def score(similarity: Column, scheme: Column, q_scheme: Column, topic: Column, q_topic: Column, organization: Column, document_type: Column, intent: Column, raw_date: Column, as_of: Column, question: Column | None = None, text: Column | None = None, weights: dict[str, float] = R.WEIGHTS, preferred: dict = R.PREFERRED, related: dict = R.RELATED_TOPICS, ranks: dict = R.ORGANIZATION_RANK, met: Column | None = None) -> Column:
    """met: the overlap, where it is known and question and text are not at hand."""
    given, own = F.nullif(q_scheme, F.lit("")), F.nullif(scheme, F.lit(""))
    s = F.when(given.isNotNull() & (own == given), 1.0).when(given.isNotNull() & own.isNotNull(), -0.5).otherwise(0.3)
    near = F.coalesce(F.array_contains(R.lookup({k: F.array(*map(F.lit, v)) for k, v in related.items()}, q_topic), topic), F.lit(False)) if related else F.lit(False)
    t = F.when(q_topic.isNotNull() & (topic == q_topic), 1.0).when(q_topic.isNotNull() & near, 0.8).otherwise(0.2)
    orgs = R.lookup({k: F.array(*map(F.lit, v[0])) for k, v in preferred.items()}, intent)
    kinds = R.lookup({k: F.array(*map(F.lit, v[1])) for k, v in preferred.items()}, intent)
    source = F.when(F.coalesce(F.array_contains(orgs, organization), F.lit(False)), 1.0).otherwise(F.coalesce(R.lookup(ranks, organization), F.lit(0.4)))
    source = source + F.when(F.coalesce(F.array_contains(kinds, document_type), F.lit(False)), 0.25).otherwise(0.0)
    total = (
        weights["similarity"] * F.coalesce(similarity, F.lit(0.0)) + weights["scheme"] * s + weights["topic"] * t + weights["source"] * F.least(source, F.lit(1.25)) / 1.25
        + weights["freshness"] * freshness(raw_date, as_of) + weights["overlap"] * (overlap(question, text) if met is None else met)
    )
    return F.round(total, 4)


def demoted(ranked: DataFrame, query_key: str = "query_id", document: str = "document_id", text: str = "chunk_text", score_: str = "rerank_score", near: float = NEAR, factor: float = FACTOR, words: str | None = None) -> DataFrame:
    """Walks each query's rows by rank; one whose words are near those of a kept earlier row of its document has its score cut and is not kept.

    A query's rows are those of an overfetch (a few hundred at most), so they fold within one row of the JVM, which carries them whole: ranked is read once.

    words: a column with the words of the text, packed(), instead of the text; it isn't handed on, and may be null where a query has no other row of the document.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in ranked.columns if c != words))
    said = tokens(F.col(text)) if words is None else unpacked(F.col(words))
    every = F.collect_list(F.struct(F.col("rank"), F.col(document).alias("doc"), said.alias("words"), row.alias("row")))
    items = ranked.groupBy(query_key).agg(F.array_sort(every, lambda a, b: F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).otherwise(0)).alias("items"))
    kind = "array<struct<doc:{0},words:array<string>>>".format(dict(ranked.dtypes)[document])
    start = F.struct(F.array().cast(kind).alias("kept"), F.array().cast("array<boolean>").alias("flags"))

    def step(s: Column, x: Column) -> Column:
        dup = F.exists(s["kept"], lambda k: (k["doc"] == x["doc"]) & (jaccard(k["words"], x["words"]) > near))
        kept = F.when(dup, s["kept"]).otherwise(F.concat(s["kept"], F.array(F.struct(x["doc"].alias("doc"), x["words"].alias("words")))))
        return F.struct(kept.alias("kept"), F.concat(s["flags"], F.array(dup)).alias("flags"))

    flags = items.select("items", F.aggregate("items", start, step, lambda s: s["flags"]).alias("dups")).select(F.explode(F.arrays_zip("items", "dups")).alias("f"))
    joined = flags.select("f.items.row.*", F.col("f.dups").alias("demoted"))
    new = F.when(F.col("demoted"), F.round(F.col(score_) * factor, 4)).otherwise(F.col(score_))
    w = Window.partitionBy(query_key).orderBy(F.col(score_).desc(), "_was")
    return joined.withColumn(score_, new).withColumnRenamed("rank", "_was").withColumn("rank", F.row_number().over(w)).drop("_was")
