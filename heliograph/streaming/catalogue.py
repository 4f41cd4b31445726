"""Cardinalities of metrics and labels kept as daily sketches: the approximate form next to the exact one.

A day's row per (metric, label) holds a HyperLogLog sketch of the label's values, and under no label one of the metric's
series. Sketches of several batches and days merge without their points, so a month is answered from a few rows a day. An
estimate is off by about ``ERROR`` (one standard deviation); small counts are exact. Exact counts stay with
``operators.metrics``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import clocks, values
from heliograph.operators import filters as flt
from heliograph.operators.metrics import with_series
from heliograph.sources import storage
from heliograph.streaming.ingest import Sink

PRECISION = 12  # 2 ** 12 registers
ERROR = 1.04 / math.sqrt(2**PRECISION)
_KEYS = ["metric_name", "label"]


def daily_sketches(points: DataFrame) -> DataFrame:
    """Per day, metric and label: points, first and last time, and the sketch of values; per metric that of its series.

    A point is spread to its labels once; everything combines on the map side.
    """
    texts = F.transform_values("attributes", lambda _, v: values.any_text(v))
    series = F.struct(F.lit(None).cast("string").alias("label"), F.col("series_key").cast("string").alias("value"))
    labels = F.transform(F.map_entries(texts), lambda e: F.struct(e["key"].alias("label"), e["value"].alias("value")))
    spread = with_series(points).select("event_date", "metric_name", "time_ns", F.explode(F.array_append(labels, series)).alias("l"))
    return spread.groupBy("event_date", "metric_name", "l.label").agg(
        F.count("*").alias("point_count"),
        F.min("time_ns").alias("first_ns"),
        F.max("time_ns").alias("last_ns"),
        F.hll_sketch_agg("l.value", PRECISION).alias("sketch"),
    )


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.sum("point_count").alias("point_count"),
        F.min("first_ns").alias("first_ns"),
        F.max("last_ns").alias("last_ns"),
        F.hll_union_agg("sketch").alias("sketch"),
    )


def keep_sketches(table: str, grain: str = "day") -> Sink:
    """Land each batch's sketches under its batch id; late points add a row to their day."""
    return lambda batch, batch_id: storage.append_batch(daily_sketches(batch), table, batch_id, grain)


def compact(spark: SparkSession, table: str, grain: str = "day") -> None:
    """Merge the sketches of each day that batches touched."""
    days = ["event_date", *([storage.GRAINS[grain]] if grain != "day" else [])]
    storage.compact(spark, table, grain, merge=lambda rows: _merged(rows, [*days, *_KEYS]))


def cardinalities(spark: SparkSession, table: str, time_range: flt.TimeRange | None = None) -> DataFrame:
    """Per metric and label (none: the metric's series) over whole days: points, first and last time, distinct values.

    Days outside the range are not opened; a day that reaches into it counts whole.
    """
    rows = storage.read_facts(spark, table)
    if time_range is not None:
        days = [F.lit(b).cast("bigint") for b in (time_range.start_ns, time_range.end_ns - 1)]
        rows = rows.filter(F.col("event_date").between(*(clocks.event_date(d) for d in days)))
    return _merged(rows, _KEYS).select(
        *_KEYS, "point_count", "first_ns", "last_ns", F.hll_sketch_estimate("sketch").alias("distinct_values")
    )
