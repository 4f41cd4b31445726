"""Joins between signals, and the references that lead nowhere.

All keys but the trace id alone include a span id, so a huge trace spreads over the join. Joins on
the trace id have one row per trace on one side, written beforehand, so that the adaptive skew join
can split the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.operators import traces
from heliograph.sources.storage import checkpoint

_SPAN_KEY = ["trace_id", "span_id"]


def trace_logs(logs: DataFrame, spans: DataFrame) -> DataFrame:
    """Logs of a trace written between its start and its end."""
    bounds = checkpoint(traces.trace_bounds(spans).select("trace_id", "trace_start_ns", "trace_end_ns"))
    return logs.filter(F.col("trace_id").isNotNull()).join(bounds, "trace_id").filter(
        F.col("time_ns").between(F.col("trace_start_ns"), F.col("trace_end_ns"))
    )


def span_logs(logs: DataFrame, spans: DataFrame) -> DataFrame:
    """Logs with the span they were written in."""
    owners = spans.select(
        *_SPAN_KEY, F.col("name").alias("span_name"), F.col("service_name").alias("span_service"), "kind"
    )
    return logs.filter(F.col("span_id").isNotNull()).join(owners, _SPAN_KEY)


def resolve_links(spans: DataFrame) -> DataFrame:
    """Span links with the span they point to, if it is there."""
    targets = spans.select(
        F.col("trace_id").alias("linked_trace_id"),
        F.col("span_id").alias("linked_span_id"),
        F.col("name").alias("linked_name"),
        F.col("service_name").alias("linked_service"),
    )
    return traces.links(spans).join(targets, ["linked_trace_id", "linked_span_id"], "left")


def orphan_logs(logs: DataFrame, spans: DataFrame) -> DataFrame:
    """Logs that point at a span which does not exist; a span id without a trace id counts."""
    return logs.filter(F.col("span_id").isNotNull()).join(spans.select(*_SPAN_KEY), _SPAN_KEY, "left_anti")


def exemplars(metrics: DataFrame) -> DataFrame:
    """One row per exemplar of a data point."""
    return metrics.select(
        "metric_name", "service_name", F.col("time_ns").alias("point_ns"), F.explode("exemplars").alias("x")
    ).select(
        "metric_name",
        "service_name",
        "point_ns",
        "x.trace_id",
        "x.span_id",
        F.col("x.time_ns").alias("time_ns"),
        F.col("x.value").alias("value"),
    )


def orphan_exemplars(metrics: DataFrame, spans: DataFrame) -> DataFrame:
    return (
        exemplars(metrics).filter(F.col("span_id").isNotNull()).join(spans.select(*_SPAN_KEY), _SPAN_KEY, "left_anti")
    )


def exemplar_spans(metrics: DataFrame, spans: DataFrame) -> DataFrame:
    """Exemplars with the span they were sampled from."""
    sources = spans.select(*_SPAN_KEY, F.col("name").alias("span_name"), F.col("service_name").alias("span_service"))
    return exemplars(metrics).join(sources, _SPAN_KEY)


def orphan_spans(spans: DataFrame) -> DataFrame:
    """Spans whose parent is missing."""
    parents = spans.select("trace_id", F.col("span_id").alias("parent_span_id"))
    return spans.filter(
        F.col("parent_span_id").isNotNull() & (F.col("parent_span_id") != traces.NO_PARENT)
    ).join(parents, ["trace_id", "parent_span_id"], "left_anti")


def timeline(spans: DataFrame, logs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Spans, logs and metric points on one clock, by service and trace.

    A point belongs to the trace of its exemplar, if it has one.
    """
    none = F.lit(None).cast("string")
    return (
        spans.select(
            F.lit("span").alias("signal"),
            F.col("start_ns").alias("at_ns"),
            "service_name",
            "trace_id",
            "span_id",
            F.col("name").alias("title"),
        )
        .unionByName(
            logs.select(
                F.lit("log").alias("signal"),
                F.col("time_ns").alias("at_ns"),
                "service_name",
                "trace_id",
                "span_id",
                F.col("body_text").alias("title"),
            )
        )
        .unionByName(
            metrics.select(
                F.lit("metric").alias("signal"),
                F.col("time_ns").alias("at_ns"),
                "service_name",
                F.coalesce(F.get("exemplars", F.lit(0))["trace_id"], none).alias("trace_id"),
                F.coalesce(F.get("exemplars", F.lit(0))["span_id"], none).alias("span_id"),
                F.col("metric_name").alias("title"),
            )
        )
    )


def system_stats(spans: DataFrame, logs: DataFrame, metrics: DataFrame, name_limit: int = 1000) -> DataFrame:
    """Totals per signal and the share of the metric name limit in use, as one row.

    One aggregate per signal, then a union of three one-row tables: nothing is joined.
    """

    def counts(**given) -> list:
        names = ("total_traces", "total_spans", "total_logs", "total_metric_points", "unique_metric_names")
        return [given.get(n, F.lit(0).cast("bigint")).alias(n) for n in names]

    parts = (
        spans.agg(*counts(total_traces=F.countDistinct("trace_id"), total_spans=F.count("*")))
        .unionByName(logs.agg(*counts(total_logs=F.count("*"))))
        .unionByName(
            metrics.agg(*counts(total_metric_points=F.count("*"), unique_metric_names=F.countDistinct("metric_name")))
        )
    )
    totals = parts.agg(*[F.sum(c).alias(c) for c in parts.columns])
    return totals.withColumn("cardinality_usage_pct", F.round(F.col("unique_metric_names") * 100.0 / name_limit, 4))
