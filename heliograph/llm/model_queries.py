"""Queries on trained models: language, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import folds, langid, line_crf, pseudo_lm, tables
from heliograph.llm.registry import query


@query()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = tables.read(spark, sf_dir, "documents"), folds.in_fold("doc_id", 4, 2)
    predicted = langid.predict(docs, langid.fit(docs, ~held_out))
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query()
def op9_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = tables.read(spark, sf_dir, "documents"), folds.in_fold("doc_id", 5, 0)
    scored = line_crf.score(docs, line_crf.fit(docs, tables.read(spark, sf_dir, "labels"), ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query()
def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    return pseudo_lm.fit_and_score(docs)
