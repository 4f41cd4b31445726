"""Service figures over a sliding window, kept up to date by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import clocks
from heliograph.operators import filters as flt
from heliograph.operators import services
from heliograph.sources import storage
from heliograph.streaming.ingest import Sink

PANE_NS = 60 * clocks.NANOS_PER_SECOND
_KEYS = ["service_name"]


def panes(spans: DataFrame) -> DataFrame:
    """Per minute and service the spans, errors and a latency sketch: one row for each bucket of durations.

    A pane has at most as many rows as there are buckets, whatever it counts, and panes of several batches add up.
    Sliding windows share panes, so a span is counted once rather than once per window that holds it.
    """
    pane = (clocks.whole_div(F.col("start_ns"), PANE_NS) * F.lit(PANE_NS).cast("bigint")).alias("pane_ns")
    counted = services.red_sketch(spans.filter(F.col("service_name").isNotNull()).select("*", pane), ["pane_ns", *_KEYS])
    return counted.withColumn("event_date", clocks.event_date(F.col("pane_ns")))


def keep_panes(table: str, grain: str = "day") -> Sink:
    """Land each batch's panes under its batch id; late spans simply add to old panes."""
    return lambda batch, batch_id: storage.append_batch(panes(batch), table, batch_id, grain)


def _merged(rows: DataFrame) -> DataFrame:
    days = [c for c in storage.GRAINS.values() if c in rows.columns]
    return services.merged_red_sketch(rows, ["pane_ns", *_KEYS, *days])


def compact_panes(spark: SparkSession, table: str, grain: str = "day") -> None:
    """Add up the panes of closed batches, on the days they touch."""
    storage.compact(spark, table, grain, merge=_merged)


def red_window(spark: SparkSession, table: str, spans: str, now: str | int, minutes: float = 30) -> DataFrame:
    """Service figures of the window that ends now, on whole minutes.

    Counts come from the panes. Percentiles are exact: the merged sketch tells which durations the ranks lie
    between, and only spans of those are read from the table that the same batches landed in. Batches count
    once both tables have them.
    """
    window = flt.TimeRange.last(minutes, now)
    both = min(storage.last_batch(spark, table), storage.last_batch(spark, spans))
    kept = flt.in_range(_upto(storage.read_facts(spark, table), both).withColumnRenamed("pane_ns", "time_ns"), window)
    sketch = storage.checkpoint(services.merged_red_sketch(kept, _KEYS))
    landed = _upto(storage.read_facts(spark, spans), both).withColumnRenamed("start_ns", "time_ns")
    landed = flt.in_range(landed, window).withColumnRenamed("time_ns", "start_ns").filter(F.col("service_name").isNotNull())
    narrow = landed.select(*_KEYS, "status_code", "start_ns", "end_ns")
    return services.red_of_sketch(sketch, narrow, _KEYS).drop("last_seen")


def _upto(rows: DataFrame, batch: int) -> DataFrame:
    return rows.filter(F.col("batch_id") <= batch)
