"""From raw documents to a training mixture: quality, toxicity, near-duplicates, benchmark leaks, source weights.

Each stage gets what the one before has kept, written as Parquet and read again. All but the last return the columns of
documents; the last returns a row for each copy in the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionloom.llm import decontaminate, mixing, neardup, quality, toxicity
from sessionloom.llm.queries import table
from sessionloom.llm.shared import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier, trained on ``labels``, accepts. Null and empty texts are scored like others."""
    return quality.good_only(docs, table(spark, sf_dir, "labels"))


def toxicity_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier, trained on the labelled ones among them, does not call toxic."""
    return toxicity.clean_only(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group. Texts without words, and rows without doc_id, are in no group."""
    return neardup.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in which no window of a ``benchmark`` item occurs; texts without words have none."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy, numbered ``mix_copy``. A source of no words gets no copies; null is a source."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("toxicity", toxicity_classifier),
    ("minhash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_sources),
]

#: SQL cannot train the classifiers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``. An empty table gives an empty result; other columns go through."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{at}")
    return docs
