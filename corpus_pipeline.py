"""From raw documents to packed token sequences: five stages, each written as Parquet and reread by the next.

1. toxicity: documents that the classifier scores 0.3 or more go.
2. line_dedup: boilerplate lines stay in one document and go from all others.
3. simhash: of each group of near-duplicates the document with the smallest doc_id stays.
4. decontamination: words of benchmark passages go, or the document that consists of them by more than half.
5. packing: sequences of 1024 tokens, a row for each piece, with its ids.

All but the last return the columns of documents, and any others that there are, whatever their names; where a text changes, n_chars follows it.

Nulls and edge cases: a null text passes every stage and is packed as an empty one; null and empty texts, and those of white space alone, are near-duplicates
of each other, so one document of them stays; a null doc_id counts as larger than any other, and rows without one stay unless their text repeats; of rows
that share a doc_id and are near-duplicates one stays, others each; very long texts pass whole; an empty table gives an empty one in every stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import decontaminate, line_dedup, packing, simhash, toxicity
from fathomline.llm.common import shared_dir, table


def _counted(df: DataFrame) -> DataFrame:
    """n_chars, if there is such a column, of the text as it is now."""
    if "n_chars" not in df.columns:
        return df
    kind = dict(df.dtypes)["n_chars"]
    return df.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.filtered(docs, *toxicity.learnt(spark, docs, sf_dir))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_dedup.deduplicated(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: No stage but line_dedup can be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
