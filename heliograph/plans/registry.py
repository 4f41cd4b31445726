"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from heliograph.plans import signals
from heliograph.plans.tables_sql import with_tables


@dataclass(frozen=True)
class Inputs:
    """The derived tables of one data directory."""

    spark: SparkSession
    sf_dir: str

    @property
    def spans(self) -> DataFrame:
        return signals.spans(self.spark, self.sf_dir)

    @property
    def logs(self) -> DataFrame:
        return signals.logs(self.spark, self.sf_dir)

    @property
    def metrics(self) -> DataFrame:
        return signals.metrics(self.spark, self.sf_dir)

    @property
    def distributions(self) -> DataFrame:
        return signals.distributions(self.spark, self.sf_dir)

    @property
    def genai(self) -> DataFrame:
        return signals.genai_spans(self.spark, self.sf_dir)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None):
    """Register a query; ``sql`` may use the derived tables as if they were tables."""

    def register(function: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(Inputs(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_tables(sql)
        return function

    return register
