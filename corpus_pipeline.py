"""Documents to training sequences: each stage works on all that its predecessor kept.

A stage's own intermediate tables are removed when the next stage begins, by which time its result has been written.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from heliograph.llm import exact_dedup, folds, host_rules, line_crf, near_dup, packing, pieces, tables
from heliograph.sources import storage


# Words that a worker remembers while it encodes: the stages before have left less memory than an operator has alone.
MEMO = 200_000


def stage(function):
    """Keep the tables of one stage at a time."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with storage.scope(spark, "pipeline"):
            return function(spark, docs, sf_dir)

    return run_stage


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field predicts good; learned from labels outside the held-out fold."""
    labels = tables.read(spark, sf_dir, "labels")
    return line_crf.keep_good(docs, line_crf.fit(docs, labels, ~folds.in_fold("doc_id", 5, 0)))


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose source passes."""
    return host_rules.keep_good(docs)


@stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with a similarity of 0.8 or more."""
    return near_dup.keep_one(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their token ids, their sequence and place in it."""
    return packing.pack(packing.cut(docs, pieces.vocabulary(), with_ids=True, memo=MEMO))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("packing", packed),
]

# The classifier's scores have no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = tables.read(spark, sf_dir, "documents")
    folder = tables.scratch_dir(spark, "pipeline")
    for number, (name, step) in enumerate(STAGES):
        path = f"{folder}/{number}-{name.replace(' ', '-')}"
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
