"""The search filter language, compiled to column predicates.

A filter is (field, operator, value). Filters are combined with AND, except that several on
``trace_id``, ``span_id``, ``log_level`` or ``http_status`` are alternatives of one another.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions import clocks, enums, values, web

_SAME_AS = {"equals": "eq", "=": "eq", "==": "eq", "!=": "ne", ">": "gt", "<": "lt", ">=": "gte", "<=": "lte"}
_COMPARE = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
}
_ALTERNATIVES = ("trace_id", "span_id", "log_level", "http_status")

# Metric names that carry request rate, errors or duration.
RED_NAME_PATTERNS = (
    "request.*rate|rate.*request",
    "request.*count|count.*request",
    "request.*total|total.*request",
    "error.*rate|rate.*error",
    "error.*count|count.*error",
    "error.*total|total.*error",
    "duration",
    "latency",
    "response.*time|time.*response",
    "_seconds_bucket",
    "_seconds_sum",
    "_seconds_count",
)


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: str | float | bool | None


@dataclass(frozen=True)
class TimeRange:
    """Bounds as RFC3339 text or nanoseconds."""

    start: str | int
    end: str | int

    @property
    def start_ns(self) -> int:
        return clocks.parse_bound(self.start)

    @property
    def end_ns(self) -> int:
        return clocks.parse_bound(self.end)

    @classmethod
    def last(cls, minutes: float, now: str | int) -> TimeRange:
        """The relative window that ends now."""
        end = clocks.parse_bound(now)
        return cls(end - int(minutes * 60 * clocks.NANOS_PER_SECOND), end)


def time_column(df: DataFrame) -> str:
    return "start_ns" if "span_id" in df.columns and "start_ns" in df.columns else "time_ns"


def in_range(
    df: DataFrame, time_range: TimeRange | None, column: str | None = None, closed: bool = False
) -> DataFrame:
    """Half-open ``[start, end)``, or closed. On the event clock, day and month folders are pruned too."""
    if time_range is None:
        return df
    event_clock = time_column(df)
    column = column or event_clock
    start, end = time_range.start_ns, time_range.end_ns
    upper = F.col(column) <= end if closed else F.col(column) < end
    kept = df.filter((F.col(column) >= start) & upper)
    if column == event_clock and "event_date" in df.columns:
        first, last = (clocks.event_date(F.lit(b).cast("bigint")) for b in (start, end))
        kept = kept.filter(F.col("event_date").between(first, last))
        if "event_month" in df.columns:
            kept = kept.filter(F.col("event_month").between(F.trunc(first, "month"), last))
    return kept


def apply_filters(df: DataFrame, filters: Iterable[Filter] = ()) -> DataFrame:
    predicate = compile_filters(df, list(filters))
    return df if predicate is None else df.filter(predicate)


def compile_filters(df: DataFrame, filters: list[Filter]) -> Column | None:
    grouped: dict[str, list[Column]] = {}
    for position, item in enumerate(filters):
        predicate = _predicate(df, item)
        if predicate is None:
            continue
        alternatives = item.field in _ALTERNATIVES and _SAME_AS.get(item.operator, item.operator) == "eq"
        grouped.setdefault(item.field if alternatives else f"#{position}", []).append(predicate)
    if not grouped:
        return None
    return values.all_of([values.any_of(alternatives) for alternatives in grouped.values()])


def _is_null_word(value: object) -> bool:
    return value is None or str(value).lower() in ("", "null")


def _predicate(df: DataFrame, item: Filter) -> Column | None:
    operator = _SAME_AS.get(item.operator, item.operator)
    if operator == "eq":
        if item.field == "trace_id":
            return F.col("trace_id").isNull() if _is_null_word(item.value) else F.col("trace_id") == item.value
        if item.field == "span_id":
            return None if _is_null_word(item.value) else F.col("span_id") == item.value
    if item.field == "log_level":
        return log_level(item.value)
    if item.field == "http_status":
        return http_status_class(df, item.value)
    return compare(field_column(df, item.field), operator, _coded(item.field, item.value))


def _coded(field: str, value: object) -> object:
    """Enum names given for a coded field become their number."""
    tables = {"span.kind": enums.SPAN_KINDS, "kind": enums.SPAN_KINDS}
    tables |= {"status.code": enums.STATUS_CODES, "status_code": enums.STATUS_CODES}
    for number, name in tables.get(field, {}).items():
        if str(value).upper() == name:
            return number
    return value


def compare(column: Column, operator: str, value: object) -> Column:
    """One comparison; numbers compare as numbers, and text that is not a number never matches."""
    if operator == "contains":
        return column.cast("string").contains(str(value))
    if operator == "regex":
        return column.cast("string").rlike(str(value))
    if operator not in _COMPARE:
        raise ValueError(f"unknown filter operator {operator!r}")
    if isinstance(value, bool):
        return _COMPARE[operator](column.try_cast("boolean"), F.lit(value))
    number = _as_number(value)
    if number is not None and (operator not in ("eq", "ne") or not isinstance(value, str)):
        return _COMPARE[operator](column.try_cast("double"), F.lit(number))
    return _COMPARE[operator](column.cast("string"), F.lit(str(value)))


def _as_number(value: object) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def field_column(df: DataFrame, field: str) -> Column:
    """Resolve a field name of the query builder: a column, a resource attribute or an attribute."""
    known = {
        "service.name": "service_name",
        "resource.service.name": "service_name",
        "span.kind": "kind",
        "status.code": "status_code",
        "metric.name": "metric_name",
        "metric.type": "metric_type",
        "body": "body_text",
    }
    column = known.get(field, field.removeprefix("metrics.") if field.startswith("metrics.") else field)
    if column in df.columns:
        return F.col(f"`{column}`")
    if field == "duration_seconds":
        return clocks.duration_seconds(F.col("start_ns"), F.col("end_ns"))
    if field in ("service_namespace", "service.namespace", "resource.service.namespace"):
        return namespace(df)
    if field.startswith("resource."):
        return values.any_text(F.col("resource")[field.removeprefix("resource.")])
    return values.attribute_value(df, field.removeprefix("attributes."))


def namespace(df: DataFrame) -> Column:
    return values.any_text(F.col("resource")["service.namespace"])


def log_level(name: object) -> Column | None:
    """Severity range of a level; unknown levels filter nothing."""
    bounds = enums.SEVERITY_RANGES.get(str(name).upper())
    return F.col("severity_number").between(*bounds) if bounds else None


def http_status_class(df: DataFrame, name: object) -> Column | None:
    """``1xx`` … ``5xx``, or ``unknown`` for spans without a readable status."""
    status, name = web.http_status(df), str(name).lower()
    if name == "unknown":
        return status.isNull()
    if len(name) == 3 and name.endswith("xx") and name[0] in "12345":
        return status.between(int(name[0]) * 100, int(name[0]) * 100 + 99)
    return None


def metric_names(df: DataFrame, names: Iterable[str] = ()) -> DataFrame:
    """Only the named metrics; no name means all."""
    names = list(names)
    return df.filter(F.col("metric_name").isin(names)) if names else df


def red_metric(name: Column) -> Column:
    return name.rlike("(?i)" + "|".join(f"(?:{p})" for p in RED_NAME_PATTERNS))


def free_text(df: DataFrame, text: str) -> Column:
    """Text anywhere in the body or in an attribute value, ignoring case."""
    wanted = text.lower()
    in_attributes = F.exists(F.map_values("attributes"), lambda v: F.lower(values.any_text(v)).contains(wanted))
    return F.lower("body_text").contains(wanted) | F.coalesce(in_attributes, F.lit(False))


def in_services(df: DataFrame, namespaces: Iterable[str] = (), services: Iterable[str] = ()) -> DataFrame:
    """Multi-select of namespaces and services; an empty choice means all."""
    namespaces, services = list(namespaces), list(services)
    if namespaces:
        df = df.filter(namespace(df).isin(namespaces))
    if services:
        df = df.filter(F.col("service_name").isin(services))
    return df


TIME_FIELDS = {"event_time": "time_ns", "observed_time": "observed_ns", "db_time": "ingest_ns"}
