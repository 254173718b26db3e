"""Corpus pipeline: from raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last
return the columns of ``documents``. The classifier learns from labelled documents as they are in
``sf_dir``: after the first stage hardly any rejected examples are left to learn from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.llm import minhash, packing, quality_mil, quality_rules, suffix_dedup
from recallspark.llm.toxicity import labelled_sample
from recallspark.plans.scratch import Scratch


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_passing(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    raw, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    sample = labelled_sample(raw, labels, "quality", quality_mil.MODULUS, quality_mil.MOST_DOCS, quality_mil.MOST_BYTES)
    return quality_mil.keep_good(docs, quality_mil.train(*sample))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    return minhash.one_of_each(docs).select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur earlier, and with their new lengths."""
    return suffix_dedup.clean_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", passages),
    ("packing", packed),
]

#: Neither the classifier nor the tokens can be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder before the next reads it."""
    scratch = Scratch.of(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs)
            scratch.drop(before)
            before = docs
    return docs
