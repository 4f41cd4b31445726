"""Metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.functions import enums
from heliograph.operators import attributes, correlate, dimensions, distributions, filters, metrics, traces
from heliograph.operators.filters import Filter, TimeRange
from heliograph.plans.registry import query

WINDOW = TimeRange("2024-01-05T00:00:00Z", "2024-01-20T12:00:00Z")
_IN = f"time_ns >= {WINDOW.start_ns} AND time_ns < {WINDOW.end_ns}"
NOW = "2024-01-20T12:00:00Z"


@query("time_range_closed", f"SELECT metric_name, service_name, label, time_ns, value FROM points WHERE time_ns BETWEEN {WINDOW.start_ns} AND {WINDOW.end_ns} AND metric_name = 'events.view'")
def _closed(t):
    return metrics.detail(t.metrics, "events.view", WINDOW).drop("series_key")


@query("filter_metric_names", "SELECT metric_name, time_ns, value FROM points WHERE metric_name IN ('events.click', 'events.error')")
def _names(t):
    return filters.metric_names(t.metrics, ["events.click", "events.error"]).select("metric_name", "time_ns", "value")


_RED_SQL = " OR ".join(f"regexp_matches(metric_name, '(?i){p}')" for p in filters.RED_NAME_PATTERNS)
_NAMED = "(SELECT time_ns, value, metric_name || CASE event_id % 6 WHEN 0 THEN '.Request_Count' WHEN 1 THEN '.latency' WHEN 2 THEN '_seconds_sum' WHEN 3 THEN '.error.total' WHEN 4 THEN '.size' ELSE '' END AS metric_name FROM points)"


@query("red_metric_filter", f"SELECT metric_name, CAST(count(*) AS BIGINT) AS point_count FROM {_NAMED} WHERE {_RED_SQL} GROUP BY metric_name")
def _red_names(t):
    suffixes = F.array(*[F.lit(s) for s in (".Request_Count", ".latency", "_seconds_sum", ".error.total", ".size", "")])
    events = t.table("events").select(
        F.concat(F.lit("events."), "event_type", F.get(suffixes, (F.col("event_id") % 6).cast("int"))).alias("metric_name")
    )
    return events.filter(filters.red_metric(F.col("metric_name"))).groupBy("metric_name").agg(F.count("*").alias("point_count"))


@query(
    "metric_catalog",
    f"""SELECT metric_name, min_by(metric_type, time_ns) AS metric_type, min_by(unit, time_ns) AS unit,
  min_by(description, time_ns) AS description, CAST(count(DISTINCT service_name) AS BIGINT) AS resource_count,
  CAST(2 AS BIGINT) AS label_count, CAST(count(DISTINCT label) AS BIGINT) AS attribute_combinations
FROM points WHERE {_IN} GROUP BY metric_name""",
)
def _catalog(t):
    return metrics.catalog(t.metrics, WINDOW)


@query(
    "metric_catalog_page",
    f"""SELECT metric_name, CAST(count(DISTINCT service_name) AS BIGINT) AS resource_count, true AS has_more
FROM points WHERE {_IN} GROUP BY metric_name ORDER BY metric_name LIMIT 3""",
)
def _catalog_page(t):
    return metrics.catalog_page(t.metrics, WINDOW, limit=3).select("metric_name", "resource_count", "has_more")


_ATTRIBUTES = """'[{"key":"k","value":{"string_value":"' || a_k || '"}},{"key":"user","value":{"int_value":"' || a_user || '"}}]'"""
_SERIES_KEY = f"sha256(service_name || '|' || {_ATTRIBUTES})"


@query(
    "metric_detail",
    f"""SELECT metric_name, {_SERIES_KEY} AS series_key, service_name, label, time_ns, value FROM points
WHERE time_ns BETWEEN {WINDOW.start_ns} AND {WINDOW.end_ns}""",
)
def _detail(t):
    return metrics.detail(t.metrics, None, WINDOW)


@query(
    "metric_series_documents",
    f"""SELECT metric_name, {_SERIES_KEY} AS series_key, label, {_ATTRIBUTES} AS attributes,
  '[{{"key":"service.name","value":{{"string_value":"' || service_name || '"}}}}]' AS resource, CAST(0 AS BIGINT) AS part,
  CAST(count(*) AS INT) AS point_count, min(time_ns) AS first_ns, max(time_ns) AS last_ns FROM points GROUP BY ALL""",
)
def _documents(t):
    points = F.col("datapoints")
    return metrics.series_documents(t.metrics, None).select(
        "metric_name", "series_key", "label", "attributes", "resource", "part", F.size(points).alias("point_count"),
        F.element_at(points, 1)["time_ns"].alias("first_ns"), F.element_at(points, -1)["time_ns"].alias("last_ns"),
    )


@query("metric_attribute_sets", "SELECT DISTINCT metric_name, label AS attribute_set FROM points")
def _sets(t):
    return metrics.attribute_sets(t.metrics)


_LABELS = """SELECT metric_name, unnest(['user', 'k']) AS label, unnest([a_user, a_k]) AS label_value FROM points"""
_COUNTED = f"SELECT metric_name, label, label_value, count(*) AS n FROM ({_LABELS}) GROUP BY ALL"
_TOP = f"""SELECT *, row_number() OVER (PARTITION BY metric_name, label ORDER BY n DESC, label_value) AS value_rank FROM ({_COUNTED})"""


@query(
    "label_cardinality",
    f"""SELECT metric_name, label, CAST(sum(n) AS BIGINT) AS point_count, CAST(count(*) AS BIGINT) AS distinct_values,
  string_agg(label_value, ',' ORDER BY value_rank) FILTER (value_rank <= 5) AS top_values FROM ({_TOP}) GROUP BY metric_name, label""",
)
def _labels(t):
    return metrics.label_cardinality(t.metrics)


@query(
    "top_values_per_label",
    f"SELECT metric_name, label, label_value, CAST(n AS BIGINT) AS point_count, CAST(value_rank AS INT) AS value_rank FROM ({_TOP}) WHERE value_rank <= 5",
)
def _top(t):
    return metrics.top_label_values(t.metrics)


_SERIES = "SELECT metric_name, service_name, label, max(time_ns) AS last_ns FROM points GROUP BY ALL"


@query(
    "active_series",
    f"""SELECT metric_name, CAST(count(*) AS BIGINT) AS total_series,
  CAST(count(*) FILTER (last_ns > {WINDOW.end_ns} - 3600000000000) AS BIGINT) AS active_series FROM ({_SERIES}) GROUP BY metric_name""",
)
def _active(t):
    return metrics.active_series(t.metrics, NOW)


@query(
    "cardinality_analysis",
    f"""SELECT metric_name, CAST(count(*) AS BIGINT) AS series_count, CAST(2 AS BIGINT) AS label_count, 'k,user' AS labels,
  CAST(2 AS INT) AS widest_label_set, CAST(count(*) AS BIGINT) AS most_labelled, count(*) > 100 AS is_high_cardinality FROM ({_SERIES}) GROUP BY metric_name ORDER BY series_count DESC""",
)
def _analysis(t):
    return metrics.cardinality_analysis(t.metrics)


_KEPT = "SELECT metric_name FROM points GROUP BY metric_name ORDER BY min(time_ns), metric_name LIMIT 3"


@query(
    "cardinality_guard",
    f"SELECT metric_name, time_ns, value FROM points WHERE metric_name IN (SELECT metric_name FROM ({_KEPT}))",
)
def _guard(t):
    return metrics.guard_cardinality(t.metrics, 3).select("metric_name", "time_ns", "value")


@query(
    "cardinality_guard_report",
    f"""SELECT CAST(count(DISTINCT metric_name) FILTER (kept) AS BIGINT) AS kept_names,
  CAST(count(DISTINCT metric_name) FILTER (NOT kept) AS BIGINT) AS dropped_names,
  CAST(count(*) FILTER (kept) AS BIGINT) AS kept_points, CAST(count(*) FILTER (NOT kept) AS BIGINT) AS dropped_points,
  'red' AS usage_level
FROM (SELECT metric_name, metric_name IN (SELECT metric_name FROM ({_KEPT})) AS kept FROM points)""",
)
def _guard_report(t):
    return metrics.guard_report(t.metrics, 3)


@query(
    "metric_latest_and_domain",
    """SELECT metric_name, arg_max(value, time_ns) AS latest_value, min(value) AS min_value, max(value) AS max_value,
  round(greatest(0, min(value) - (max(value) - min(value)) * 0.1), 6) AS domain_low,
  round(max(value) + (max(value) - min(value)) * 0.1, 6) AS domain_high FROM points GROUP BY metric_name""",
)
def _latest(t):
    return metrics.latest_and_domain(t.metrics)


_IDENTITY = "metric_name, metric_type, unit, temporality, is_monotonic"


@query(
    "metric_dim",
    f"""SELECT sha256('{{' || j || ',"description":"' || description || '"}}') AS metric_hash, sha256('{{' || j || '}}') AS identity_hash, * EXCLUDE (j) FROM (
SELECT '"metric_name":"' || metric_name || '","metric_type":"' || metric_type || '","unit":"' || unit || '","temporality":'
  || coalesce('"' || temporality || '"', 'null') || ',"is_monotonic":' || coalesce(CAST(is_monotonic AS VARCHAR), 'null') AS j, metric_name, metric_type, unit, temporality, coalesce(is_monotonic, false) AS is_monotonic, description,
  min(time_ns) AS first_seen_ns, max(time_ns) AS last_seen_ns FROM points GROUP BY {_IDENTITY}, description)""",
)
def _metric_dim(t):
    dim = dimensions.metric_dim(t.metrics)
    return dim.withColumn("is_monotonic", F.coalesce("is_monotonic", F.lit(False)))


@query(
    "description_variants",
    f"""SELECT metric_name, description, CAST(count(*) OVER (PARTITION BY {_IDENTITY}) AS BIGINT) AS variant_count
FROM (SELECT DISTINCT {_IDENTITY}, description FROM points)""",
)
def _variants(t):
    variants = dimensions.description_variants(dimensions.metric_dim(t.metrics))
    return variants.select("metric_name", "description", "variant_count")


@query(
    "metric_alias_resolve",
    """SELECT metric_name, description, 'Number of ' || substr(metric_name, 8) AS resolved_description
FROM (SELECT DISTINCT metric_name, description FROM points)""",
)
def _aliases(t):
    # The wording "X events" is an alias of "Number of X".
    dim = dimensions.metric_dim(t.metrics)
    canonical = dim.filter(F.col("description").startswith("Number of")).select(
        "identity_hash", F.col("metric_hash").alias("canonical_hash")
    )
    aliases = (
        dim.filter(~F.col("description").startswith("Number of"))
        .select("identity_hash", F.col("metric_hash").alias("alias_hash"))
        .join(canonical, "identity_hash")
    )
    resolved = dimensions.resolve_aliases(dim, aliases.select("alias_hash", "canonical_hash"))
    named = dim.select(F.col("metric_hash").alias("resolved_hash"), F.col("description").alias("resolved_description"))
    return resolved.join(named, "resolved_hash").select("metric_name", "description", "resolved_description")


@query(
    "metric_page",
    "SELECT metric_name, service_name, time_ns, value, true AS has_more FROM points WHERE metric_name = 'events.purchase' ORDER BY time_ns DESC LIMIT 100",
)
def _page(t):
    page = metrics.search_points(t.metrics, names=["events.purchase"])
    return page.select("metric_name", "service_name", "time_ns", "value", "has_more")


@query(
    "metric_search_filtered",
    f"""SELECT metric_name, service_name, time_ns, value, true AS has_more FROM points
WHERE {_IN} AND contains(service_name, 'vc-2') AND metric_type = 'sum' ORDER BY time_ns DESC LIMIT 20""",
)
def _search(t):
    chosen = [Filter("service_name", "contains", "vc-2"), Filter("metric.type", "eq", "sum")]
    page = metrics.search_points(t.metrics, WINDOW, filters=chosen, limit=20)
    return page.select("metric_name", "service_name", "time_ns", "value", "has_more")


@query("series_time_order", "SELECT metric_name, service_name, label, time_ns, value FROM points ORDER BY metric_name, label, time_ns")
def _order(t):
    return metrics.detail(t.metrics, None, merge_services=True).drop("series_key")


@query(
    "export_series_selectors",
    """SELECT DISTINCT metric_name, '{k="' || a_k || '", user="' || a_user || '"}' AS selector FROM points""",
)
def _selectors(t):
    return metrics.series_selectors(t.metrics)


@query(
    "metric_enum_labels",
    """SELECT metric_name, CAST(CASE metric_type WHEN 'gauge' THEN 1 ELSE 2 END AS INT) AS type_id,
  upper(metric_type) AS type_id_label, CAST(count(*) AS BIGINT) AS point_count FROM points GROUP BY metric_name, metric_type""",
)
def _enum(t):
    numbers = F.create_map(*[F.lit(x) for number, name in enums.METRIC_TYPES.items() for x in (name.lower(), number)])
    coded = t.metrics.select("metric_name", numbers[F.col("metric_type")].alias("type_id"))
    counted = coded.groupBy("metric_name", "type_id").agg(F.count("*").alias("point_count"))
    return dimensions.enum_labels(counted, {"type_id": "metric_type"})


# -- distributions and exemplars ------------------------------------------------------------


@query(
    "histogram_buckets",
    """SELECT metric_name, service_name, time_ns, i AS bucket_index, ([10.0, 50.0, 100.0, 250.0, 'Infinity'::DOUBLE])[i + 1] AS le,
  (event_id + i) % 4 AS bucket_count,
  CAST(list_sum([(event_id + j) % 4 FOR j IN range(0, i + 1)]) AS BIGINT) AS cumulative_count
FROM (SELECT *, CAST(unnest(range(0, 5)) AS INT) AS i FROM dists WHERE event_id % 3 = 0)""",
)
def _histogram(t):
    return distributions.histogram_buckets(t.distributions)


# Scales run from -2 to 2: bases from 16 down to the fourth root of 2.
_SCALED = "pow(2.0, -(event_id % 5 - 2))"


@query(
    "exp_histogram_buckets",
    f"""SELECT metric_name, service_name, time_ns, round(lower, 6) AS lower, round(upper, 6) AS upper, bucket_count FROM (
  SELECT metric_name, service_name, time_ns, unnest([
    {{'lower': -pow(2, {_SCALED} * 2), 'upper': -pow(2, {_SCALED} * 1), 'bucket_count': event_id % 2}},
    {{'lower': 0.0, 'upper': 0.0, 'bucket_count': event_id % 7}},
    {{'lower': pow(2, {_SCALED} * (user_id % 5)), 'upper': pow(2, {_SCALED} * (user_id % 5 + 1)), 'bucket_count': event_id % 4}},
    {{'lower': pow(2, {_SCALED} * (user_id % 5 + 1)), 'upper': pow(2, {_SCALED} * (user_id % 5 + 2)), 'bucket_count': event_id % 5}}
  ], recursive := true) FROM dists WHERE event_id % 3 = 1)""",
)
def _exponential(t):
    return distributions.exponential_buckets(t.distributions).withColumns(
        {"lower": F.round("lower", 6), "upper": F.round("upper", 6)}
    )


@query(
    "summary_quantiles",
    """SELECT metric_name, service_name, time_ns, CAST(unnest([0.5, 0.9, 0.99]) AS DOUBLE) AS quantile,
  unnest([value, value * 1.5, value * 2.0]) AS quantile_value FROM dists WHERE event_id % 3 = 2""",
)
def _summary(t):
    quantiles = distributions.summary_quantiles(t.distributions)
    return quantiles


@query("exemplars", "SELECT metric_name, service_name, time_ns AS point_ns, trace_id, span_id, time_ns, value FROM exemplars")
def _exemplars(t):
    return correlate.exemplars(t.metrics)


@query(
    "orphan_exemplars",
    """SELECT metric_name, trace_id, span_id, time_ns FROM exemplars e
ANTI JOIN spans s ON s.trace_id = e.trace_id AND s.span_id = e.span_id""",
)
def _orphan_exemplars(t):
    return correlate.orphan_exemplars(t.metrics, t.spans).select("metric_name", "trace_id", "span_id", "time_ns")


@query(
    "exemplar_spans",
    """SELECT metric_name, trace_id, span_id, e.time_ns, s.name AS span_name, s.service_name AS span_service
FROM exemplars e JOIN spans s USING (trace_id, span_id)""",
)
def _exemplar_spans(t):
    return correlate.exemplar_spans(t.metrics, t.spans).select(
        "metric_name", "trace_id", "span_id", "time_ns", "span_name", "span_service"
    )


# -- attributes ------------------------------------------------------------------------------

_EAV = "SELECT trace_id || '/' || span_id AS owner_id, key, value_type, value FROM span_attributes WHERE value IS NOT NULL"
# Text of a double differs between engines, so doubles are compared as numbers.
_EAV_COLUMNS = """owner_id, key, value_type, CASE WHEN value_type IN ('string', 'bool') THEN value END AS text_value,
  CASE WHEN value_type IN ('int', 'double') THEN CAST(value AS DOUBLE) END AS number_value"""


def _rows(t):
    return attributes.attribute_rows(t.spans, "span", ["trace_id", "span_id"])


def _comparable(rows):
    return rows.select(
        "owner_id",
        "key",
        "value_type",
        F.coalesce("str_value", F.col("bool_value").cast("string")).alias("text_value"),
        F.coalesce(F.col("int_value").cast("double"), "double_value").alias("number_value"),
    )


@query("attribute_eav", f"SELECT {_EAV_COLUMNS} FROM ({_EAV})")
def _eav(t):
    return _comparable(_rows(t))


@query("unify_attributes", f"SELECT {_EAV_COLUMNS} FROM ({_EAV})")
def _unify(t):
    return _comparable(attributes.unify(attributes.typed_tables(_rows(t))))


@query(
    "attribute_levels",
    """SELECT 'resource' AS level, 'service.name' AS key, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT service_name) AS BIGINT) AS distinct_values FROM spans
UNION ALL SELECT 'resource', 'service.namespace', count(*), count(DISTINCT namespace) FROM spans
UNION ALL SELECT 'event', 'exception.type', count(*), count(DISTINCT name) FROM spans WHERE status_code = 2
UNION ALL SELECT 'link', 'link.kind', count(*), 1 FROM spans WHERE kind IN (0, 5) AND seq > 1
UNION ALL SELECT 'datapoint', 'user', count(*), count(DISTINCT a_user) FROM points
UNION ALL SELECT 'datapoint', 'k', count(*), count(DISTINCT a_k) FROM points
UNION ALL SELECT 'log', k, count(*), count(DISTINCT v) FROM (
  SELECT unnest(['user.id', 'event.type', 'attributes.span.kind', 'span.name', 'z.last']) AS k,
    unnest([a_user_id, a_event_type, a_span_kind, a_span_name, a_last]) AS v FROM logs) WHERE v IS NOT NULL GROUP BY k""",
)
def _levels(t):
    owner = ["trace_id", "span_id"]
    parts = [
        attributes.attribute_rows(t.spans, "resource", owner, "resource"),
        attributes.attribute_rows(traces.events(t.spans), "event", [*owner, "event_index"]),
        attributes.attribute_rows(traces.links(t.spans), "link", [*owner, "link_index"]),
        attributes.attribute_rows(t.metrics, "datapoint", ["metric_name", "time_ns"]),
        attributes.attribute_rows(t.logs, "log", ["time_ns"]),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    by_value = whole.groupBy("level", "key", attributes.value_text().alias("value")).agg(F.count("*").alias("n"))
    return by_value.groupBy("level", "key").agg(F.sum("n").alias("n"), F.count("*").alias("distinct_values"))


@query(
    "attribute_keys",
    f"""SELECT key, value_type, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT value) AS BIGINT) AS distinct_values,
  key IN ('http.method', 'db.name') AS is_indexed FROM ({_EAV}) GROUP BY key, value_type""",
)
def _keys(t):
    return attributes.key_registry(_rows(t), indexed=("http.method", "db.name"))


@query(
    "attr_key_join",
    f"SELECT owner_id, key, value_type, count(*) OVER (PARTITION BY key, value_type) AS occurrences FROM ({_EAV})",
)
def _key_join(t):
    rows = _rows(t)
    joined = attributes.with_registry(rows, attributes.key_registry(rows))
    return joined.select("owner_id", "key", "value_type", "occurrences")


@query(
    "promote_attribute",
    """SELECT trace_id, span_id, CAST(coalesce(http_status, -1) AS INT) AS promoted, kind IN (2, 3) AS was_there FROM spans""",
)
def _promote(t):
    return attributes.promote_attribute(t.spans, "http.status_code", "int").select(
        "trace_id",
        "span_id",
        F.coalesce(F.col("`http.status_code`"), F.lit(-1)).alias("promoted"),
        (F.map_contains_key("attributes", "http.method") & ~F.map_contains_key("attributes", "http.status_code")).alias(
            "was_there"
        ),
    )
