"""The corpus pipeline: each stage applies one training-data operator to what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storytide.llm import common, importance, neardup, packing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score stays below one half."""
    corpus = common.table(spark, sf_dir, "documents")
    return toxicity.keep_clean(docs, toxicity.fit(corpus, common.table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling towards the good ones selects."""
    return importance.keep_selected(docs, importance.fit(docs, common.table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept documents with their places in packed sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("quality classifier", drop_poor), ("MinHash near-dedup", drop_copies), ("best-fit packing", pack)]

#: Learned models and tokenisation have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
