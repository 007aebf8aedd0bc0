"""From raw documents to a training mix: quality, lines, near-duplicates, benchmark passages, source weights.

Each stage gets what its predecessor kept, written as Parquet and read again, and returns the columns of
``documents``; the last adds how much of each document the mix takes.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfcast.llm.common import table
from shelfcast.llm.decontaminate import decontaminate
from shelfcast.llm.linededup import dedup_lines
from shelfcast.llm.mixing import mix
from shelfcast.llm.neardup import keep_first
from shelfcast.llm.quality_gam import fit_quality, keep_quality
from shelfcast.session import settle

#: Documents below this quality score go.
MIN_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the additive model rejects; it is fitted on the labelled ones among them."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), train=F.lit(True))
    return keep_quality(docs, model, MIN_QUALITY)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that repeat an earlier one but for a word, and documents that lose all their lines."""
    out, names = dedup_lines(docs, min_exact=1)
    out = out.where(~F.col(names["emptied"])).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: five-word shingles, similarity 0.8 or more."""
    return keep_first(docs, width=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more are benchmark passages."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of words it takes of each."""
    out, names = mix(docs, keep=docs.columns)
    return out.where(F.col(names["taken"]) > 0)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("source mixing", mixing),
]

#: The stages learn from labels, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(spark, name.replace(" ", "-"), partial(stage, spark, docs, sf_dir))
    return docs
