"""A training corpus in five stages: toxicity, near duplicates, repeated spans, benchmark copies, tokens.

Defined cases, for each stage: columns beside doc_id and text, whatever their names, are kept as they are (but
n_chars, counted anew where spans went); null and empty texts are clean and stay to the end as no tokens; rows
without an id are no copies of any document and stay; equal rows with one id stay or go together before
spans, and of their texts the first keeps its spans; empty tables give an empty result; without labels of
both kinds nothing is toxic, without a benchmark nothing is a copy.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotewise.llm import bpe, decontaminate, jaccard_join, langid, substring_dedup, toxicity
from lotewise.llm.common import prepare, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold by a model learnt from the labels."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~langid.held_out(3, 1))
    model = toxicity.train(docs.select("doc_id", "text").join(labels, "doc_id"))
    return toxicity.kept(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least id, of each component of near duplicates."""
    prepare(spark)
    return jaccard_join.one_of_each(docs)


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans of 20 words or more that start earlier in the corpus."""
    prepare(spark)
    out = substring_dedup.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    prepare(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    prepare(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("substring", drop_repeated_spans),
    ("decontaminate", drop_benchmark_copies),
    ("bpe", tokenize),
]

#: Classifiers, alignment and byte-pair encoding are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
