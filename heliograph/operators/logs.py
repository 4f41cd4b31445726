"""Log search and presentation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions import clocks, enums, values
from heliograph.operators import filters as flt
from heliograph.operators import paging

NEWEST_LOG = [("time_ns", True), ("log_key", False)]


def with_key(logs: DataFrame) -> DataFrame:
    """Add a key that orders log records of one instant."""
    return logs.withColumn(
        "log_key", F.sha2(F.to_json(F.struct("trace_id", "span_id", "service_name", "severity_number", "body_text")), 256)
    )


def search(
    logs: DataFrame,
    time_range: flt.TimeRange | None = None,
    filters: Iterable[flt.Filter] = (),
    limit: int = paging.DEFAULT_LIMIT,
    cursor: tuple | None = None,
    time_field: str = "event_time",
    text: str = "",
) -> DataFrame:
    """A page of logs, newest first; the range may be on the event or the observed time."""
    matching = flt.apply_filters(flt.in_range(logs, time_range, flt.TIME_FIELDS[time_field]), filters)
    if text:
        matching = matching.filter(flt.free_text(matching, text))
    return paging.page(with_key(matching), NEWEST_LOG, limit, cursor)


def view(logs: DataFrame) -> DataFrame:
    """Logs in the shape the query API answers with."""
    return logs.select(
        clocks.rfc3339(F.col("time_ns")).alias("timestamp"),
        clocks.rfc3339(F.col("observed_ns")).alias("observed_timestamp"),
        "severity_number",
        "severity_text",
        F.coalesce(F.col("body")["string_value"], F.to_json("body")).alias("body"),
        F.transform(
            F.array_sort(F.map_entries("attributes")),
            lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")),
        ).alias("attributes"),
        "trace_id",
        "span_id",
        "service_name",
        "resource",
    )


def display_message(attributes_shown: int = 3, width: int = 100) -> Column:
    """Body, or the first attributes as JSON when the body is empty, cut to ``width`` characters."""
    body = F.col("body_text")
    first = F.slice(values.canonical_text_entries(F.col("attributes")), 1, attributes_shown)
    plain = F.transform(
        first, lambda e: F.struct(F.regexp_replace(e["key"], "^attributes\\.", "").alias("key"), e["value"].alias("value"))
    )
    shown = (
        F.when(~F.trim(F.coalesce(body, F.lit(""))).isin("", "{}"), body)
        .when(F.size("attributes") > 0, F.to_json(F.map_from_entries(plain)))
        .otherwise(F.lit("-"))
    )
    return F.when(F.length(shown) > width, F.concat(F.substring(shown, 1, width), F.lit("..."))).otherwise(shown)


def severity_distribution(logs: DataFrame, time_range: flt.TimeRange | None = None) -> DataFrame:
    """Log count per severity name, most severe first."""
    counts = (
        flt.in_range(logs, time_range)
        .filter(F.col("severity_number").isNotNull())
        .groupBy("severity_number")
        .agg(F.count("*").alias("log_count"))
    )
    return counts.select(
        enums.label(F.col("severity_number"), enums.SEVERITIES).alias("severity"),
        F.col("severity_number").alias("display_order"),
        "log_count",
    ).orderBy(F.desc("display_order"))
