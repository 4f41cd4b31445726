"""Queries on token ids: record files, the merge automaton, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heliograph.llm import bpe, packing, pieces, records, tables
from heliograph.llm.registry import query


@query()
def op1_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    manifest = records.write(docs, tables.scratch_dir(spark, "records"), pieces.vocabulary())
    return records.read(spark, manifest)


@query()
def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(tables.read(spark, sf_dir, "documents"), pieces.vocabulary())


@query()
def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut(tables.read(spark, sf_dir, "documents"), pieces.vocabulary()))
