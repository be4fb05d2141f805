"""What the two classifiers share: bounded labelled samples, and training only on rows that are not held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.shared import written

#: Labelled rows that a model is fitted on at most; they are those with the least hash of their doc_id.
SAMPLE_ROWS = 12_000


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the doc_id as text leaves this remainder; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def all_labels(labels: DataFrame, label: str, modulus: int, remainder: int) -> DataFrame:
    """(_doc, _label): the greatest label of each document that is not held out. Null ids and null labels are left out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(modulus, remainder))
    return usable.groupBy(F.col("doc_id").alias("_doc")).agg(F.max(label).cast("int").alias("_label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents that are not held out, one row a doc_id.

    The ids are drawn among those that ``docs`` holds, so labels of other documents use up nothing. Of contradicting
    labels of a document the greatest counts; of several texts of a doc_id the one with the least SHA-256. Null ids and
    null labels are left out. Only the bounded list of sampled ids is broadcast; the sample is written, so further passes
    over it do not read the documents again.
    """
    usable = all_labels(labels, label, modulus, remainder)
    there = docs.select(F.col("doc_id").alias("_id")).join(usable, F.col("_id") == F.col("_doc")).groupBy("_doc").agg(F.max("_label").alias("_label"))
    picked = there.orderBy(F.xxhash64("_doc"), "_doc").limit(rows)
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    found = texts.join(F.broadcast(picked), F.col("_id") == F.col("_doc")).groupBy("_doc")
    one = found.agg(F.min(F.struct(F.sha2(F.coalesce("_text", F.lit("")), 256).alias("digest"), "_text")).alias("one"), F.first("_label").alias("label"))
    return written(one.select(F.col("one._text").alias("text"), "label"), f"sample-{label}")


def free_name(docs: DataFrame, name: str) -> str:
    """``name`` or the first of its lengthenings that is no column of ``docs``, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
