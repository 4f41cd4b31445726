"""Service catalogue: rate, errors, duration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions import clocks, enums
from heliograph.operators import filters as flt
from heliograph.operators.quantiles import Summary, bucket_counts, exact_quantiles, merged_counts, select_ranks

QUANTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def is_error() -> Column:
    return F.col("status_code") == enums.STATUS_ERROR


def _summary(weight: str | None = None) -> Summary:
    """Requests, errors, first and last start: of rows, and of parts already summed up."""
    ones = F.col(weight) if weight else F.lit(1).cast("bigint")
    return {
        "request_count": (F.sum(ones), F.sum("request_count")),
        "error_count": (F.sum(F.when(is_error(), ones).otherwise(0)), F.sum("error_count")),
        "first_seen": (F.min("start_ns"), F.min("first_seen")),
        "last_seen": (F.max("start_ns"), F.max("last_seen")),
    }


def with_duration(spans: DataFrame) -> DataFrame:
    return spans.withColumn("_duration", F.col("end_ns") - F.col("start_ns"))


def red(spans: DataFrame, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Requests, errors, exact latency percentiles in ms and first / last start per group."""
    keys = keys or ["service_name"]
    figures = exact_quantiles(with_duration(spans), keys, "_duration", QUANTILES, _summary(weight), weight)
    return _red(figures, keys)


def red_sketch(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The counts and the latency sketch of a part of the spans, to be kept and merged."""
    return bucket_counts(with_duration(spans), keys, "_duration", _summary())


def merged_red_sketch(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return merged_counts(sketches, keys, _summary())


def red_of_sketch(sketch: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`red` from the merged sketch of all spans, and of the spans only those in the buckets of the percentiles."""
    return _red(select_ranks(sketch, with_duration(spans), keys, "_duration", QUANTILES, _summary()), keys)


def _red(figures: DataFrame, keys: list[str]) -> DataFrame:
    return figures.select(
        *keys,
        "request_count",
        "error_count",
        F.round(F.col("error_count") / F.col("request_count") * 100, 2).alias("error_rate"),
        *[F.round(F.col(q) / 1e6, 2).alias(f"{q}_latency_ms") for q in QUANTILES],
        "first_seen",
        "last_seen",
    )


def catalog(spans: DataFrame, time_range: flt.TimeRange | None = None) -> DataFrame:
    """Services by request count. Spans without a service are left out."""
    windowed = flt.in_range(spans, time_range).filter(F.col("service_name").isNotNull())
    return red(windowed).orderBy(F.desc("request_count"), "service_name")


def with_rates(services: DataFrame, time_range: flt.TimeRange) -> DataFrame:
    """Request rate per minute and second of the window; 0 for an empty window."""
    seconds = abs(time_range.end_ns - time_range.start_ns) / clocks.NANOS_PER_SECOND
    per_second = F.col("request_count") / F.lit(seconds) if seconds else F.lit(0.0)
    per_minute = F.col("request_count") / F.lit(seconds / 60) if seconds else F.lit(0.0)
    return services.withColumn("rate_per_minute", F.round(per_minute, 6)).withColumn(
        "rate_per_second", F.round(per_second, 6)
    )


SORT_COLUMNS = {
    "name": lambda: F.lower("service_name"),
    "namespace": lambda: F.lower(F.coalesce("namespace", F.lit(""))),
    "rate": lambda: F.coalesce("request_count", F.lit(0)),
    "error_rate": lambda: F.coalesce("error_rate", F.lit(0.0)),
    "p50": lambda: F.coalesce("p50_latency_ms", F.lit(0.0)),
    "p95": lambda: F.coalesce("p95_latency_ms", F.lit(0.0)),
    "p99": lambda: F.coalesce("p99_latency_ms", F.lit(0.0)),
}


def sort_services(services: DataFrame, by: str = "name", descending: bool = False) -> DataFrame:
    if by == "namespace" and by not in services.columns:
        services = services.withColumn("namespace", F.lit(None).cast("string"))
    key = SORT_COLUMNS[by]()
    return services.orderBy(key.desc() if descending else key.asc(), "service_name")


def health_bands(services: DataFrame) -> DataFrame:
    """Bands by error rate, 95th percentile and, for map nodes, error rate again."""
    rate, p95 = F.col("error_rate"), F.col("p95_latency_ms")
    return services.select(
        "*",
        F.when(rate == 0, "success").when(rate < 1, "warning").otherwise("danger").alias("error_band"),
        F.when(p95 < 100, "success").when(p95 < 500, "warning").otherwise("danger").alias("latency_band"),
        F.when(rate > 5, "red").when(rate > 0, "amber").otherwise("normal").alias("node_band"),
    )


def operations_by_kind(spans: DataFrame, time_range: flt.TimeRange | None = None) -> DataFrame:
    """Span count per kind and operation, most frequent first."""
    counts = flt.in_range(spans, time_range).groupBy("kind", "name").agg(F.count("*").alias("span_count"))
    return counts.select(
        enums.label(F.col("kind"), enums.SPAN_KINDS).alias("span_kind"), F.col("name").alias("operation"), "span_count"
    ).orderBy(F.desc("span_count"), "span_kind", "operation")


def status_share(spans: DataFrame) -> DataFrame:
    """Count and percentage of spans by status."""
    status = enums.label(F.col("status_code"), enums.STATUS_CODES).alias("status")
    return percent_of_total(spans.groupBy(status).agg(F.count("*").alias("span_count")), "span_count")


def percent_of_total(grouped: DataFrame, count: str) -> DataFrame:
    """Share of each group in the whole; the total is a scalar, not a one-partition window."""
    total = grouped.agg(F.sum(count)).scalar()
    return grouped.withColumn("percentage", F.round(F.col(count) * 100.0 / total, 4))
