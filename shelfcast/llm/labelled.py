"""A bounded, reproducible sample of labelled documents for fitting classifiers.

Fitting reads at most ``limit`` labelled rows, drawn by hash of the id; everything that is counted or scored covers
all documents. The sample's ids are broadcast: their number is bounded by the same parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Labelled documents that a fit reads at most.
SAMPLE_ROWS = 20_000


def labelled_ids(labels: DataFrame, label: str, train: Column, limit: int = SAMPLE_ROWS, doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, label)`` with one row per id, for training rows only; rows without id or label are left out.

    Conflicting labels of one id give their rounded mean.
    """
    rows = labels.where(train & F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    one = rows.groupBy(F.col(doc_id).alias("doc_id")).agg(F.round(F.avg(label)).cast("int").alias("label"))
    # The cut is by the hash alone, so a larger table gives other rows but no other share of the labels.
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def labelled_texts(docs: DataFrame, ids: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, body, label)`` of the documents with one of ``ids``; the ids' bound is that of ``labelled_ids``."""
    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("body"))
    return body.join(F.broadcast(ids), "doc_id")
