"""Trace, span and service queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.functions import enums, values, web
from heliograph.operators import correlate, dimensions, filters, genai, sampling, servicemap, services, spanmetrics, traces
from heliograph.operators.filters import Filter, TimeRange
from heliograph.plans.registry import query
from heliograph.plans.tables_sql import TABLES, rfc3339_sql
from heliograph.streaming.ingest import tag_source

WINDOW = TimeRange("1996-01-01T00:00:00Z", "1998-01-01T00:00:00Z")
_IN = f"start_ns >= {WINDOW.start_ns} AND start_ns < {WINDOW.end_ns}"
_KEYS = ["trace_id", "span_id"]
_SPAN = "trace_id, span_id, service_name, kind, start_ns"
_SPAN_COLUMNS = ["trace_id", "span_id", "service_name", "kind", "start_ns"]
_TRACE_7 = "8f14e45fceea167a5a36dedd4bea2543"  # md5 of 7
_TRACE_9 = "45c48cce2e2d7fbdea1afc51c7c6ad26"  # md5 of 9
_SPAN_7 = "a514839c4971406f"  # root span of 7


# -- filters ---------------------------------------------------------------------------------


@query("time_range_filter", f"SELECT {_SPAN} FROM spans WHERE {_IN}")
def _time_range(t):
    return filters.in_range(t.spans, WINDOW).select(_SPAN_COLUMNS)


@query("filter_trace_id", f"SELECT {_SPAN} FROM spans WHERE trace_id IN ('{_TRACE_7}', '{_TRACE_9}')")
def _filter_trace(t):
    chosen = [Filter("trace_id", "eq", _TRACE_7), Filter("trace_id", "equals", _TRACE_9)]
    return filters.apply_filters(t.spans, chosen).select(_SPAN_COLUMNS)


@query("filter_span_id", f"SELECT {_SPAN} FROM spans WHERE span_id = '{_SPAN_7}'")
def _filter_span(t):
    chosen = [Filter("span_id", "eq", _SPAN_7), Filter("span_id", "eq", "")]
    return filters.apply_filters(t.spans, chosen).select(_SPAN_COLUMNS)


@query(
    "filter_http_status",
    f"SELECT {_SPAN}, CAST(coalesce(http_status, -1) AS INT) AS http_status FROM spans "
    "WHERE http_status BETWEEN 400 AND 499 OR http_status IS NULL",
)
def _filter_http(t):
    chosen = [Filter("http_status", "eq", "4xx"), Filter("http_status", "eq", "unknown")]
    return filters.apply_filters(t.spans, chosen).select(
        *_SPAN_COLUMNS, F.coalesce(web.http_status(t.spans), F.lit(-1)).alias("http_status")
    )


@query("filter_service", f"SELECT {_SPAN} FROM spans WHERE service_name = 'Supplier#000000003' AND contains(service_name, '003')")
def _filter_service(t):
    chosen = [Filter("service_name", "equals", "Supplier#000000003"), Filter("service.name", "contains", "003")]
    return filters.apply_filters(t.spans, chosen).select(_SPAN_COLUMNS)


@query(
    "filter_generic",
    f"""SELECT {_SPAN} FROM spans WHERE http_method = 'GET' AND http_status >= 500 AND status_code = 2
  AND (end_ns - start_ns) / 1e9 > 0.01 AND (end_ns - start_ns) / 1e9 <= 0.04
  AND regexp_matches(service_name, '[0-4]$') AND kind <> 2 AND namespace = 'ns-1'""",
)
def _filter_generic(t):
    chosen = [
        Filter("http.method", "eq", "GET"),
        Filter("http.status_code", "gte", 500),
        Filter("status.code", "eq", "ERROR"),
        Filter("duration_seconds", "gt", 0.01),
        Filter("duration_seconds", "lte", 0.04),
        Filter("service.name", "regex", "[0-4]$"),
        Filter("span.kind", "ne", "SERVER"),
        Filter("service.namespace", "eq", "ns-1"),
    ]
    return filters.apply_filters(t.spans, chosen).select(_SPAN_COLUMNS)


@query(
    "filter_namespaces_services",
    f"SELECT {_SPAN} FROM spans WHERE namespace IN ('ns-0', 'ns-2') "
    "AND service_name IN ('Supplier#000000001', 'Supplier#000000002', 'Supplier#000000003')",
)
def _filter_multi(t):
    names = [f"Supplier#00000000{i}" for i in (1, 2, 3)]
    return filters.in_services(t.spans, ["ns-0", "ns-2"], names).select(_SPAN_COLUMNS)


@query(
    "relative_window",
    f"SELECT {_SPAN} FROM spans WHERE start_ns >= {WINDOW.end_ns - 7 * 24 * 3600 * 10**9} AND start_ns < {WINDOW.end_ns}",
)
def _relative(t):
    return filters.in_range(t.spans, TimeRange.last(7 * 24 * 60, WINDOW.end)).select(_SPAN_COLUMNS)


@query(
    "span_projection",
    f"""SELECT trace_id, span_id, parent_span_id, name, kind, {rfc3339_sql('start_ns')} AS start_time,
  {rfc3339_sql('end_ns')} AS end_time, (end_ns - start_ns) / 1e9 AS duration_seconds,
  (SELECT CAST(count(*) AS INT) FROM (SELECT unnest([CAST(http_status AS VARCHAR), http_method, http_url, http_route, http_target,
     http_scheme, server_address, db_system, db_name, peer_service, messaging_system, messaging_destination,
     messaging_source, 'd', 'o']) AS a) WHERE a IS NOT NULL) AS attribute_count,
  CAST(CASE WHEN status_code = 2 THEN 1 ELSE 0 END AS INT) AS event_count,
  CAST(CASE WHEN kind IN (0, 5) AND seq > 1 THEN 1 ELSE 0 END AS INT) AS link_count,
  status_code, status_message, namespace, service_name FROM spans""",
)
def _span_view(t):
    return traces.span_view(t.spans).select(
        "trace_id", "span_id", "parent_span_id", "name", "kind", "start_time", "end_time", "duration_seconds",
        F.size("attributes").alias("attribute_count"),
        F.when(F.col("events").isNull(), 0).otherwise(F.size("events")).alias("event_count"),
        F.when(F.col("links").isNull(), 0).otherwise(F.size("links")).alias("link_count"),
        F.col("status.code").alias("status_code"),
        F.col("status.message").alias("status_message"),
        values.any_text(F.col("resource")["service.namespace"]).alias("namespace"),
        "service_name",
    )


# -- joins -----------------------------------------------------------------------------------


# PRODUCER spans name a service that the dimension does not hold.
_SERVICE_ID = "CASE WHEN kind = 4 THEN -service_id ELSE service_id END"


def _services(t):
    return t.table("supplier").select(F.col("s_suppkey").alias("service_id"), F.col("s_name").alias("dim_name"))


def _facts(t):
    return t.spans.select(*_KEYS, F.expr(_SERVICE_ID).alias("service_id"))


@query(
    "span_service_outer",
    f"""SELECT trace_id, span_id, {_SERVICE_ID} AS service_id, s_name AS dim_name
FROM spans LEFT JOIN supplier ON {_SERVICE_ID} = s_suppkey""",
)
def _service_outer(t):
    joined = dimensions.with_service(_facts(t), _services(t))
    return joined.select(*_KEYS, "service_id", "dim_name")


@query(
    "span_service_inner",
    f"""SELECT trace_id, span_id, {_SERVICE_ID} AS service_id, s_name AS dim_name
FROM spans JOIN supplier ON {_SERVICE_ID} = s_suppkey""",
)
def _service_inner(t):
    joined = dimensions.with_service(_facts(t), _services(t), "inner")
    return joined.select(*_KEYS, "service_id", "dim_name")


_FOUND = f"""SELECT trace_id, min(start_ns) AS earliest_ns FROM spans
  WHERE {_IN} AND http_status BETWEEN 500 AND 599 GROUP BY trace_id ORDER BY earliest_ns DESC, trace_id LIMIT 50"""
_FAILING = [Filter("http_status", "eq", "5xx")]


@query("trace_semi", f"SELECT trace_id, span_id, start_ns FROM spans WHERE trace_id IN (SELECT trace_id FROM ({_FOUND}))")
def _trace_semi(t):
    found = traces.matching_traces(t.spans, WINDOW, _FAILING, 50)
    return traces.spans_of(t.spans, found).select(*_KEYS, "start_ns")


def _resent(spans):
    """Every span twice, as after a retry."""
    return spans.unionByName(spans)


@query(
    "parent_child",
    """SELECT c.trace_id, c.span_id, c.parent_span_id, c.service_name, p.service_name AS parent_service
FROM spans c JOIN spans p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id
WHERE c.kind NOT IN (3, 4, 5) AND p.kind <> 3 AND c.service_name <> p.service_name""",
)
def _parent_child(t):
    return servicemap.parent_child(_resent(t.spans)).select(*_KEYS, "parent_span_id", "service_name", "parent_service")


@query(
    "link_resolve",
    """SELECT s.trace_id, s.span_id, s.trace_id AS linked_trace_id,
  CASE WHEN s.kind = 5 THEN s.root_id ELSE repeat('f', 16) END AS linked_span_id,
  l.name AS linked_name, l.service_name AS linked_service
FROM spans s LEFT JOIN spans l ON l.trace_id = s.trace_id
  AND l.span_id = CASE WHEN s.kind = 5 THEN s.root_id ELSE repeat('f', 16) END
WHERE s.kind IN (0, 5) AND s.seq > 1""",
)
def _links(t):
    return correlate.resolve_links(t.spans).select(
        *_KEYS, "linked_trace_id", "linked_span_id", "linked_name", "linked_service"
    )


# The parents of the derived spans are all there, so each PRODUCER span gets a child whose parent is not.
_WITH_ORPHANS = """SELECT trace_id, span_id, parent_span_id FROM spans
UNION ALL SELECT trace_id, reverse(span_id), {missing} FROM spans WHERE kind = 4"""


@query(
    "orphan_spans",
    f""", whole AS ({_WITH_ORPHANS.format(missing="repeat('d', 16)")})
SELECT c.trace_id, c.span_id, c.parent_span_id FROM (SELECT * FROM whole WHERE parent_span_id IS NOT NULL) c
ANTI JOIN whole p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id""",
)
def _orphan_spans(t):
    narrow = t.spans.select(*_KEYS, "parent_span_id", "kind")
    added = narrow.filter("kind = 4").withColumns({"span_id": F.reverse("span_id"), "parent_span_id": F.lit("d" * 16)})
    return correlate.orphan_spans(narrow.unionByName(added)).select(*_KEYS, "parent_span_id")


_KIND_SQL = "CASE kind " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enums.SPAN_KINDS.items()) + " END"
_STATUS_SQL = "CASE status_code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enums.STATUS_CODES.items()) + " END"


@query(
    "enum_labels",
    f"SELECT trace_id, span_id, {_KIND_SQL} AS kind_label, {_STATUS_SQL} AS status_code_label FROM spans",
)
def _enum_labels(t):
    coded = t.spans.select(*_KEYS, "kind", "status_code")
    return dimensions.enum_labels(coded, {"kind": "span_kind", "status_code": "status_code"}).select(
        *_KEYS, "kind_label", "status_code_label"
    )


# -- services --------------------------------------------------------------------------------

_RED = "service_name, request_count, error_count, error_rate, p50_latency_ms, p95_latency_ms, first_seen, last_seen"


@query("red_service_catalog", f"SELECT {_RED} FROM red")
def _red(t):
    return services.catalog(t.spans).select(*_RED.split(", "))


_SECONDS = (WINDOW.end_ns - WINDOW.start_ns) / 1e9


@query(
    "red_rate_p99",
    f"""SELECT service_name, CAST(count(*) AS BIGINT) AS request_count,
  round(count(*) / ({_SECONDS} / 60), 6) AS rate_per_minute, round(count(*) / {_SECONDS}, 6) AS rate_per_second,
  round(quantile_cont(end_ns - start_ns, 0.99) / 1e6, 2) AS p99_latency_ms
FROM spans WHERE {_IN} GROUP BY service_name""",
)
def _red_rate(t):
    rated = services.with_rates(services.catalog(t.spans, WINDOW), WINDOW)
    return rated.select("service_name", "request_count", "rate_per_minute", "rate_per_second", "p99_latency_ms")


@query(
    "services_sorted",
    "SELECT service_name, request_count, error_rate, p95_latency_ms FROM red ORDER BY error_rate DESC, service_name",
)
def _services_sorted(t):
    return services.sort_services(services.red(t.spans), "error_rate", descending=True).select(
        "service_name", "request_count", "error_rate", "p95_latency_ms"
    )


@query(
    "health_bands",
    """SELECT service_name,
  CASE WHEN error_rate = 0 THEN 'success' WHEN error_rate < 1 THEN 'warning' ELSE 'danger' END AS error_band,
  CASE WHEN p95_latency_ms < 100 THEN 'success' WHEN p95_latency_ms < 500 THEN 'warning' ELSE 'danger' END AS latency_band,
  CASE WHEN error_rate > 5 THEN 'red' WHEN error_rate > 0 THEN 'amber' ELSE 'normal' END AS node_band
FROM red""",
)
def _health(t):
    return services.health_bands(services.red(t.spans)).select("service_name", "error_band", "latency_band", "node_band")


@query("service_map_edges", "SELECT * FROM map_edges")
def _edges(t):
    return servicemap.edges(_resent(t.spans))


# Both ends of a call must lie in the window.
@query(
    "service_map_window",
    f""", w AS (SELECT * FROM spans WHERE {_IN}), w_remote AS ({TABLES["remote_edges"].replace("FROM spans", "FROM w")}),
w_child AS ({TABLES["child_edges"].replace("FROM spans c JOIN spans p", "FROM w c JOIN w p")})
{TABLES["map_edges"].replace("remote_edges", "w_remote").replace("child_edges", "w_child")}""",
)
def _edges_in_window(t):
    return servicemap.edges(t.spans, WINDOW)


@query("service_map_nodes", "SELECT * FROM map_nodes")
def _nodes(t):
    return servicemap.nodes(_resent(t.spans))


@query(
    "service_map_node_metrics",
    """SELECT id, type, coalesce(request_count, 0) AS request_count, coalesce(error_count, 0) AS error_count,
  coalesce(error_rate, 0.0) AS error_rate, p50_latency_ms, p95_latency_ms, p99_latency_ms,
  id NOT IN (SELECT source FROM map_edges UNION ALL SELECT target FROM map_edges) AS isolated
FROM map_nodes LEFT JOIN red ON id = service_name""",
)
def _node_metrics(t):
    return servicemap.node_metrics(t.spans)


@query(
    "ops_by_kind",
    f"""SELECT {_KIND_SQL} AS span_kind, name AS operation, CAST(count(*) AS BIGINT) AS span_count
FROM spans WHERE {_IN} GROUP BY kind, name ORDER BY span_count DESC""",
)
def _ops(t):
    return services.operations_by_kind(t.spans, WINDOW)


_SHARE = f"""SELECT {_STATUS_SQL} AS status, CAST(count(*) AS BIGINT) AS span_count,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percentage FROM spans GROUP BY status_code"""


@query("status_share", _SHARE)
def _status_share(t):
    return services.status_share(t.spans)


@query(
    "percent_of_total",
    """SELECT service_name, CAST(count(*) AS BIGINT) AS span_count,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percentage FROM spans GROUP BY service_name""",
)
def _percent(t):
    return services.percent_of_total(t.spans.groupBy("service_name").agg(F.count("*").alias("span_count")), "span_count")


# -- trace search ----------------------------------------------------------------------------


@query("trace_search", f"SELECT * FROM ({_FOUND})")
def _trace_search(t):
    return traces.matching_traces(t.spans, WINDOW, _FAILING, 50).select("trace_id", "earliest_ns")


_SUMMARY = (
    "trace_id, service_name, root_span_name, root_span_method, root_span_url, root_span_route, root_span_target, "
    "root_span_host, root_span_scheme, root_span_server_name, root_span_status_code, root_status, "
    "root_status_message, start_ns, end_ns, duration_seconds, span_count"
)


@query(
    "trace_summaries",
    f"SELECT {_SUMMARY}, {rfc3339_sql('start_ns')} AS start_time, {rfc3339_sql('end_ns')} AS end_time FROM summaries",
)
def _summaries(t):
    return traces.trace_summaries(t.spans).select(*_SUMMARY.split(", "), "start_time", "end_time")


@query(
    "rank_preserving_fetch",
    f"""SELECT s.trace_id, f.earliest_ns, root_span_name, span_count, f.has_more FROM summaries s JOIN (
  SELECT *, (SELECT count(DISTINCT trace_id) FROM spans WHERE {_IN} AND http_status BETWEEN 500 AND 599) > 50 AS has_more
  FROM ({_FOUND})) f USING (trace_id) ORDER BY f.earliest_ns DESC, s.trace_id""",
)
def _search(t):
    found = traces.search_traces(t.spans, WINDOW, _FAILING, 50)
    return found.select("trace_id", "earliest_ns", "root_span_name", "span_count", "has_more")


@query(
    "newest_traces",
    """SELECT trace_id, min(start_ns) AS earliest_ns, true AS has_more FROM spans GROUP BY trace_id
ORDER BY earliest_ns DESC, trace_id LIMIT 100""",
)
def _newest_traces(t):
    return traces.matching_traces(t.spans)


@query("span_page", f"SELECT {_SPAN}, true AS has_more FROM spans WHERE kind = 3 ORDER BY start_ns DESC, span_id LIMIT 100")
def _span_page(t):
    page = traces.search_spans(t.spans, filters=[Filter("span.kind", "eq", "CLIENT")])
    return page.select(*_SPAN_COLUMNS, "has_more")


_CURSOR = (WINDOW.end_ns, "7" * 16)


@query(
    "keyset_page",
    f"""SELECT {_SPAN}, true AS has_more FROM spans
WHERE start_ns < {_CURSOR[0]} OR (start_ns = {_CURSOR[0]} AND span_id > '{_CURSOR[1]}')
ORDER BY start_ns DESC, span_id LIMIT 200""",
)
def _keyset(t):
    return traces.search_spans(t.spans, limit=200, cursor=_CURSOR).select(*_SPAN_COLUMNS, "has_more")


@query(
    "trace_detail",
    f"SELECT trace_id, span_id, parent_span_id, name, service_name, start_ns, end_ns FROM spans "
    f"WHERE trace_id IN ('{_TRACE_7}', '{_TRACE_9}') ORDER BY trace_id, start_ns, span_id",
)
def _trace_detail(t):
    return traces.trace_detail(t.spans, [_TRACE_7, _TRACE_9]).select(
        *_KEYS, "parent_span_id", "name", "service_name", "start_ns", "end_ns"
    )


@query(
    "trace_documents",
    """SELECT trace_id, (rn - 1) // 4 AS part, CAST(count(*) AS BIGINT) AS span_count, min(start_ns) AS first_start_ns,
  string_agg(span_id, ',' ORDER BY rn) AS span_ids
FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY start_ns, span_id) AS rn FROM spans)
GROUP BY trace_id, (rn - 1) // 4""",
)
def _trace_documents(t):
    documents = traces.trace_documents(t.spans.select(*_KEYS, "name", "start_ns", "end_ns"), part_size=4)
    ids = F.array_join(F.transform("spans", lambda s: s["span_id"]), ",").alias("span_ids")
    return documents.select("trace_id", "part", "span_count", "first_start_ns", ids)


@query("root_span_row", "SELECT trace_id, span_id, name, service_name, start_ns, end_ns FROM roots")
def _roots(t):
    return traces.root_spans(t.spans)


@query(
    "trace_window_aggs",
    "SELECT trace_id, span_id, trace_start_ns, trace_end_ns, b.span_count FROM spans JOIN bounds b USING (trace_id)",
)
def _window_aggs(t):
    return traces.with_trace_bounds(t.spans.select(*_KEYS, "start_ns", "end_ns")).select(
        *_KEYS, "trace_start_ns", "trace_end_ns", "span_count"
    )


@query("dedup_spans", "SELECT trace_id, span_id, name, service_name, start_ns, end_ns FROM spans")
def _dedup(t):
    columns = [*_KEYS, "name", "service_name", "start_ns", "end_ns"]
    copies = t.spans.select(columns).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return traces.dedup_spans(copies.drop("copy"))


@query(
    "dedup_span_id_last",
    """SELECT span_id, trace_id, start_ns + 2000 AS start_ns FROM spans""",
)
def _dedup_last(t):
    copies = t.spans.select(*_KEYS, "start_ns", "end_ns").withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    resent = copies.select("span_id", "trace_id", (F.col("start_ns") + F.col("copy") * 1000).alias("start_ns"), "end_ns")
    return traces.dedup_spans(resent, ("span_id",), keep="last").select("span_id", "trace_id", "start_ns")


@query(
    "span_events",
    """SELECT trace_id, span_id, 0 AS event_index, 'exception' AS name, end_ns AS time_ns, name AS exception_type
FROM spans WHERE status_code = 2""",
)
def _span_events(t):
    found = traces.events(t.spans)
    return found.withColumn("exception_type", values.attribute_value(found, "exception.type")).drop("attributes")


@query(
    "span_links",
    """SELECT trace_id, span_id, 0 AS link_index, trace_id AS linked_trace_id,
  CASE WHEN kind = 5 THEN root_id ELSE repeat('f', 16) END AS linked_span_id, 'follows' AS link_kind
FROM spans WHERE kind IN (0, 5) AND seq > 1""",
)
def _span_links(t):
    found = traces.links(t.spans)
    return found.withColumn("link_kind", values.attribute_value(found, "link.kind")).drop("attributes")


@query(
    "trace_waterfall",
    """, starts AS (SELECT trace_id, min(start_ns) AS t0 FROM spans GROUP BY trace_id),
tree AS (
  SELECT trace_id, span_id, start_ns, end_ns, name, service_name, 0 AS depth, [(start_ns, span_id)] AS path
  FROM spans WHERE parent_span_id IS NULL
  UNION ALL
  SELECT k.trace_id, k.span_id, k.start_ns, k.end_ns, k.name, k.service_name, t.depth + 1,
    list_append(t.path, (k.start_ns, k.span_id))
  FROM spans k JOIN tree t ON k.trace_id = t.trace_id AND k.parent_span_id = t.span_id)
SELECT trace_id, span_id, name, service_name, CAST(depth AS INT) AS depth,
  row_number() OVER (PARTITION BY trace_id ORDER BY path) AS position,
  start_ns - t0 AS offset_ns, end_ns - start_ns AS duration_ns,
  max(end_ns - t0) OVER (PARTITION BY trace_id) AS trace_duration_ns,
  (start_ns - t0) / nullif(max(end_ns - t0) OVER (PARTITION BY trace_id), 0) AS left_fraction,
  (end_ns - start_ns) / nullif(max(end_ns - t0) OVER (PARTITION BY trace_id), 0) AS width_fraction
FROM tree JOIN starts USING (trace_id)""",
)
def _waterfall(t):
    return traces.waterfall(t.spans)


# -- collector -------------------------------------------------------------------------------

DIMENSIONS_SQL = f"""service_name, name AS span_name, {_KIND_SQL} AS span_kind, {_STATUS_SQL} AS status, http_method,
  CAST(http_status AS VARCHAR) AS http_status_code"""
LE_SQL = ", ".join(
    f"CAST(count(*) FILTER (end_ns - start_ns <= {b * 1_000_000}) AS BIGINT) AS le_{b}" for b in spanmetrics.BUCKETS_MS
)


@query(
    "span_metrics",
    f"""SELECT {DIMENSIONS_SQL}, CAST(count(*) AS BIGINT) AS calls, CAST(sum(end_ns - start_ns) AS BIGINT) AS duration_sum_ns, {LE_SQL}
FROM spans GROUP BY ALL""",
)
def _span_metrics(t):
    return spanmetrics.span_metrics(t.spans)


MONTH_NS = 30 * 86_400 * 10**9


@query(
    "span_metrics_cumulative",
    f"""SELECT service_name, span_kind, status, flush_ns, CAST(sum(n) OVER w AS BIGINT) AS calls, CAST(sum(le) OVER w AS BIGINT) AS le_20,
  span_name, http_method, http_status_code
FROM (SELECT {DIMENSIONS_SQL}, (end_ns // {MONTH_NS} + 1) * {MONTH_NS} AS flush_ns, count(*) AS n,
    count(*) FILTER (end_ns - start_ns <= 20000000) AS le FROM spans GROUP BY ALL)
WINDOW w AS (PARTITION BY service_name, span_name, span_kind, status, http_method, http_status_code ORDER BY flush_ns)""",
)
def _span_metrics_cumulative(t):
    running = spanmetrics.cumulative(spanmetrics.interval_deltas(t.spans, MONTH_NS))
    return running.select(*spanmetrics.DIMENSIONS, "flush_ns", "calls", "le_20")


POLICY = sampling.Policy(own_services="Supplier#0000000[0-9]", keep_services=("#000000003$", "#000000007.*"))
SAMPLING_SQL = """SELECT trace_id, CAST(count(*) AS BIGINT) AS span_count,
  bool_or(status_code = 2) OR bool_or(coalesce(http_status BETWEEN 400 AND 599, false))
  OR bool_or(regexp_matches(service_name, '#000000003$') OR regexp_matches(service_name, '#000000007'))
  OR NOT bool_or(regexp_matches(service_name, 'Supplier#0000000[0-9]'))
  OR CAST('0x' || substr(md5(trace_id), 1, 8) AS BIGINT) % 10000 < 500 AS is_kept
FROM spans GROUP BY trace_id"""


@query("tail_sampling_decisions", SAMPLING_SQL)
def _decisions(t):
    return sampling.decisions(t.spans, POLICY).select("trace_id", "span_count", "is_kept")


@query("tail_sampling", f"SELECT {_SPAN} FROM spans WHERE trace_id IN (SELECT trace_id FROM ({SAMPLING_SQL}) WHERE is_kept)")
def _tail_sampling(t):
    return sampling.tail_sample(t.spans, POLICY).select(_SPAN_COLUMNS)


@query(
    "tag_source",
    "SELECT trace_id, span_id, 'browser' AS source, service_name AS resource_service FROM spans",
)
def _tag(t):
    tagged = tag_source(tag_source(t.spans, "other"))
    resource = F.col("resource")
    return tagged.select(
        *_KEYS,
        values.any_text(resource["telemetry.source"]).alias("source"),
        values.any_text(resource["service.name"]).alias("resource_service"),
    )


# -- GenAI -----------------------------------------------------------------------------------

_TOKENS = """CASE WHEN family IN (0, 1) THEN CAST(asked + answered AS DOUBLE) END"""
_CALLS = f"""SELECT trace_id, span_id, name, duration_seconds, service_name, model,
  CAST(asked AS DOUBLE) AS prompt_tokens, CAST(answered AS DOUBLE) AS completion_tokens, {_TOKENS} AS total_tokens,
  CASE WHEN is_answer AND family = 0 THEN CAST(0.5 AS DOUBLE) END AS temperature,
  CASE WHEN is_answer AND family = 1 THEN CAST(256 AS DOUBLE) END AS max_tokens, prompt, response
FROM genai"""
_AI = f"SELECT * FROM ({_CALLS}) WHERE coalesce(model, prompt, response) IS NOT NULL OR coalesce(total_tokens, 0) <> 0"


@query("genai_calls", f"SELECT * REPLACE (nullif(prompt_tokens, 0) AS prompt_tokens, nullif(completion_tokens, 0) AS completion_tokens) FROM ({_CALLS})")
def _genai_calls(t):
    found = genai.calls(t.genai).drop("start_ns")
    # A lone zero may come from either key; NULL it on both sides.
    zero = F.lit(0.0)
    return found.withColumns({c: F.nullif(F.col(c), zero) for c in ("prompt_tokens", "completion_tokens")})


@query("genai_filter", f"SELECT trace_id, span_id, name, model FROM ({_AI}) WHERE model = 'model-1' AND contains(lower(name), 'cha')")
def _genai_filter(t):
    return genai.ai_calls(t.genai, "model-1", "CHA").select(*_KEYS, "name", "model")


@query("distinct_models", f"SELECT DISTINCT model FROM ({_AI}) WHERE model IS NOT NULL")
def _models(t):
    return genai.models(t.genai)


@query(
    "genai_summary",
    f"""SELECT CAST(count(*) AS BIGINT) AS call_count, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens,
  CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens,
  CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens,
  round(avg(duration_seconds), 6) AS avg_duration_seconds, CAST(count(DISTINCT model) AS BIGINT) AS model_count FROM ({_AI})""",
)
def _genai_summary(t):
    return genai.summary(t.genai)


@query(
    "genai_session",
    """SELECT trace_id, CAST(count(*) FILTER (is_answer AND family IN (0, 2)) AS BIGINT) AS ai_spans,
  CAST(count(*) FILTER (name = 'Tool setup') AS BIGINT) AS tool_spans,
  CAST(count(*) FILTER (NOT (is_answer AND family IN (0, 2)) AND name <> 'Tool setup') AS BIGINT) AS other_spans,
  CAST(coalesce(sum(asked) FILTER (family IN (0, 2)), 0) AS BIGINT) AS prompt_tokens,
  CAST(coalesce(sum(answered) FILTER (family IN (0, 2)), 0) AS BIGINT) AS completion_tokens,
  CAST(coalesce(sum(coalesce(asked, 0) + answered) FILTER (family IN (0, 2)), 0) AS BIGINT) AS total_tokens,
  coalesce(string_agg(DISTINCT model, ',' ORDER BY model) FILTER (family = 0), '') AS models
FROM genai GROUP BY trace_id""",
)
def _genai_session(t):
    return genai.sessions(t.genai)


# -- dimensions ------------------------------------------------------------------------------


@query(
    "dim_service",
    "SELECT service_name, min(start_ns) AS first_seen_ns, max(start_ns) AS last_seen_ns FROM spans GROUP BY service_name",
)
def _dim_service(t):
    old, new = (dimensions.service_dim(t.spans.filter(half)) for half in ("kind < 3", "kind >= 3"))
    return dimensions.merge_dim(old, new, ["service_name"])


_DIM_OPERATION = """SELECT service_name, name, kind, min(start_ns) AS first_seen_ns, max(start_ns) AS last_seen_ns
FROM spans GROUP BY service_name, name, kind"""


@query("dim_operation", _DIM_OPERATION)
def _dim_operation(t):
    return dimensions.operation_dim(t.spans)


_DIM_RESOURCE = """SELECT sha256('[{"key":"service.name","value":{"string_value":"' || service_name
    || '"}},{"key":"service.namespace","value":{"string_value":"' || namespace || '"}}]') AS resource_hash,
  '{"service.name":{"string_value":"' || service_name || '"},"service.namespace":{"string_value":"' || namespace || '"}}' AS attributes_json,
  min(start_ns) AS first_seen_ns, max(start_ns) AS last_seen_ns FROM spans GROUP BY service_name, namespace"""


@query(
    "dim_resource",
    _DIM_RESOURCE,
)
def _dim_resource(t):
    return dimensions.resource_dim(t.spans)


@query(
    "batch_dims",
    f"""SELECT 'service' AS dim, service_name, NULL AS name, CAST(-1 AS INT) AS kind, min(start_ns) AS first_seen_ns,
  max(start_ns) AS last_seen_ns FROM spans GROUP BY service_name
UNION ALL SELECT 'operation', * FROM ({_DIM_OPERATION})
UNION ALL SELECT 'resource', resource_hash, attributes_json, -1, first_seen_ns, last_seen_ns FROM ({_DIM_RESOURCE})""",
)
def _batch_dims(t):
    dims = dimensions.batch_dims(t.spans)
    resource = dims["resource"].withColumnsRenamed({"resource_hash": "service_name", "attributes_json": "name"})
    named = [rows.withColumn("dim", F.lit(d)) for d, rows in (("operation", dims["operation"]), ("service", dims["service"]), ("resource", resource))]
    columns = ["dim", "service_name", "name", "kind", "first_seen_ns", "last_seen_ns"]
    whole = named[0].unionByName(named[1], allowMissingColumns=True).unionByName(named[2], allowMissingColumns=True)
    return whole.withColumn("kind", F.coalesce("kind", F.lit(-1))).select(columns)
