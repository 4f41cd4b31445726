"""Log queries and queries across signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.functions import enums, values
from heliograph.operators import correlate, dimensions, filters, logs
from heliograph.operators.filters import Filter, TimeRange
from heliograph.plans.registry import query
from heliograph.plans.tables_sql import rfc3339_sql

WINDOW = TimeRange("2024-01-05T00:00:00Z", "2024-01-20T12:00:00Z")
_IN = f"time_ns >= {WINDOW.start_ns} AND time_ns < {WINDOW.end_ns}"
_LOG = "trace_id, span_id, time_ns, severity_number, service_name, body_text"
_LOG_COLUMNS = _LOG.split(", ")
_SEVERITY_SQL = (
    "CASE severity_number " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enums.SEVERITIES.items()) + " END"
)


@query("filter_uncorrelated_logs", f"SELECT {_LOG} FROM logs WHERE trace_id IS NULL OR trace_id = md5('7')")
def _uncorrelated(t):
    chosen = [Filter("trace_id", "eq", "null"), Filter("trace_id", "eq", "8f14e45fceea167a5a36dedd4bea2543")]
    return filters.apply_filters(t.logs, chosen).select(_LOG_COLUMNS)


@query("filter_log_level", f"SELECT {_LOG} FROM logs WHERE severity_number BETWEEN 13 AND 16 OR severity_number BETWEEN 1 AND 4")
def _level(t):
    chosen = [Filter("log_level", "eq", level) for level in ("warn", "TRACE", "loud")]
    return filters.apply_filters(t.logs, chosen).select(_LOG_COLUMNS)


@query(
    "filter_free_text",
    f"""SELECT {_LOG} FROM logs WHERE contains(lower(body_text), '"k": 6') OR contains(lower(concat_ws(' ', a_event_type, a_user_id, a_span_kind, a_span_name, a_last)), 'promo')""",
)
def _free_text(t):
    either = filters.free_text(t.logs, '"K": 6') | filters.free_text(t.logs, "PROMO")
    return t.logs.filter(either).select(_LOG_COLUMNS)


@query("time_field_choice", f"SELECT {_LOG}, observed_ns FROM logs WHERE observed_ns >= {WINDOW.start_ns} AND observed_ns < {WINDOW.end_ns}")
def _time_field(t):
    return filters.in_range(t.logs, WINDOW, filters.TIME_FIELDS["observed_time"]).select(*_LOG_COLUMNS, "observed_ns")


@query(
    "log_projection",
    f"""SELECT {rfc3339_sql('time_ns')} AS timestamp, CASE WHEN observed_ns IS NOT NULL THEN {rfc3339_sql('observed_ns')} END AS observed_timestamp,
  severity_number, {_SEVERITY_SQL} AS severity_text, body_text AS body,
  CAST(CASE WHEN a_event_type IS NULL THEN 3 ELSE 2 END AS INT) AS attribute_count, trace_id, span_id, service_name, namespace FROM logs""",
)
def _view(t):
    namespace = values.any_text(F.col("resource")["service.namespace"]).alias("namespace")
    return logs.view(t.logs).select("*", F.size("attributes").alias("attribute_count"), namespace).drop("attributes", "resource")


@query(
    "log_display_message",
    """SELECT time_ns, service_name, CASE WHEN length(shown) > 60 THEN substr(shown, 1, 60) || '...' ELSE shown END AS message FROM (
  SELECT time_ns, service_name, CASE WHEN trim(body_text) NOT IN ('', '{}') THEN body_text
    ELSE '{"span.kind":"' || a_span_kind || '","span.name":"' || a_span_name || '","z.last":"' || a_last || '"}' END AS shown FROM logs)""",
)
def _display(t):
    return t.logs.select("time_ns", "service_name", logs.display_message(3, 60).alias("message"))


@query("severity_distribution", f"""SELECT {_SEVERITY_SQL} AS severity, severity_number AS display_order, CAST(count(*) AS BIGINT) AS log_count
FROM logs WHERE {_IN} GROUP BY severity_number""")
def _severity(t):
    return logs.severity_distribution(t.logs, WINDOW)


@query("log_enum_labels", f"SELECT time_ns, service_name, {_SEVERITY_SQL} AS severity_number_label FROM logs")
def _enum(t):
    coded = t.logs.select("time_ns", "service_name", "severity_number")
    return dimensions.enum_labels(coded, {"severity_number": "severity"}).drop("severity_number")


@query("newest_logs", f"SELECT {_LOG}, true AS has_more FROM logs WHERE {_IN} AND severity_number = 17 ORDER BY time_ns DESC LIMIT 100")
def _newest(t):
    page = logs.search(t.logs, WINDOW, [Filter("log_level", "eq", "ERROR")])
    return page.select(*_LOG_COLUMNS, "has_more")


@query(
    "trace_logs",
    f"""SELECT l.trace_id, l.span_id, l.time_ns, l.body_text, b.trace_start_ns, b.trace_end_ns FROM logs l JOIN bounds b USING (trace_id)
WHERE l.time_ns BETWEEN b.trace_start_ns AND b.trace_end_ns""",
)
def _trace_logs(t):
    return correlate.trace_logs(t.logs, t.spans).select(
        "trace_id", "span_id", "time_ns", "body_text", "trace_start_ns", "trace_end_ns"
    )


@query(
    "span_logs",
    """SELECT l.trace_id, l.span_id, l.time_ns, l.body_text, s.name AS span_name, s.service_name AS span_service, s.kind
FROM logs l JOIN spans s ON l.trace_id = s.trace_id AND l.span_id = s.span_id""",
)
def _span_logs(t):
    return correlate.span_logs(t.logs, t.spans).select(
        "trace_id", "span_id", "time_ns", "body_text", "span_name", "span_service", "kind"
    )


@query(
    "orphan_logs",
    """SELECT l.trace_id, l.span_id, l.time_ns FROM (SELECT * FROM logs WHERE span_id IS NOT NULL) l
ANTI JOIN spans s ON s.trace_id = l.trace_id AND s.span_id = l.span_id""",
)
def _orphans(t):
    return correlate.orphan_logs(t.logs, t.spans).select("trace_id", "span_id", "time_ns")


@query(
    "signal_union",
    """SELECT 'span' AS signal, start_ns AS at_ns, service_name, trace_id, span_id, name AS title FROM spans
UNION ALL SELECT 'log', time_ns, service_name, trace_id, span_id, body_text FROM logs
UNION ALL SELECT 'metric', p.time_ns, p.service_name, e.trace_id, e.span_id, p.metric_name
  FROM points p LEFT JOIN exemplars e USING (event_id)""",
)
def _timeline(t):
    return correlate.timeline(t.spans, t.logs, t.metrics)


@query(
    "system_stats",
    """SELECT (SELECT count(DISTINCT trace_id) FROM spans) AS total_traces, (SELECT count(*) FROM spans) AS total_spans,
  (SELECT count(*) FROM logs) AS total_logs, (SELECT count(*) FROM points) AS total_metric_points,
  (SELECT count(DISTINCT metric_name) FROM points) AS unique_metric_names,
  round((SELECT count(DISTINCT metric_name) FROM points) * 100.0 / 1000, 4) AS cardinality_usage_pct""",
)
def _stats(t):
    return correlate.system_stats(t.spans, t.logs, t.metrics)
