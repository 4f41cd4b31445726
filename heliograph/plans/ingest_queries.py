"""Ingest, storage and streaming queries: requests made of the derived tables, through the jobs, back to rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from heliograph.functions import clocks, identifiers, nested, values
from heliograph.operators import sampling as batch_sampling
from heliograph.operators.filters import TimeRange, in_range
from heliograph.operators import metrics, spanmetrics
from heliograph.plans import requests
from heliograph.plans.registry import query
from heliograph.plans.trace_queries import DIMENSIONS_SQL, LE_SQL, MONTH_NS, POLICY, SAMPLING_SQL
from heliograph.sources import envelopes, storage
from heliograph.streaming import catalogue, correlation, counters, ingest, live
from heliograph.streaming import sampling as stream_sampling

_SPANS_SQL = """SELECT trace_id, span_id, parent_span_id, name, kind, status_code, status_message, start_ns, end_ns,
  service_name, namespace, CAST(http_status AS VARCHAR) AS http_status, db_name,
  CAST(CASE WHEN status_code = 2 THEN 1 ELSE 0 END AS INT) AS event_count,
  CASE WHEN kind = 5 AND seq > 1 THEN root_id WHEN kind = 0 AND seq > 1 THEN repeat('f', 16) END AS linked_span_id,
  strftime(make_timestamp(start_ns // 1000), '%Y-%m-%d') AS event_date FROM spans"""


def _flat_spans(spans):
    return spans.select(
        "trace_id",
        "span_id",
        "parent_span_id",
        "name",
        "kind",
        "status_code",
        "status_message",
        "start_ns",
        "end_ns",
        "service_name",
        values.any_text(F.col("resource")["service.namespace"]).alias("namespace"),
        values.attribute_value(spans, "http.status_code").alias("http_status"),
        values.attribute_value(spans, "db.name").alias("db_name"),
        F.size("events").alias("event_count"),
        F.get("links", F.lit(0))["span_id"].alias("linked_span_id"),
        F.col("event_date").cast("string").alias("event_date"),
    )


@query("flatten_spans", _SPANS_SQL)
def _flatten_spans(t):
    return _flat_spans(envelopes.flatten_spans(envelopes.parse_requests(requests.span_requests(t.spans), "traces")))


_LOGS_SQL = """SELECT trace_id, span_id, time_ns, coalesce(observed_ns, 0) AS observed_ns, severity_number, body_text, service_name, namespace,
  'STRING' AS body_type, a_user_id AS user_id, a_span_name AS span_name FROM logs"""


def _flat_logs(logs):
    return logs.select(
        "trace_id",
        "span_id",
        "time_ns",
        F.coalesce("observed_ns", F.lit(0)).alias("observed_ns"),
        "severity_number",
        "body_text",
        "service_name",
        values.any_text(F.col("resource")["service.namespace"]).alias("namespace"),
        "body_type",
        values.attribute_value(logs, "user.id").alias("user_id"),
        values.attribute_value(logs, "span.name").alias("span_name"),
    )


@query("flatten_logs", _LOGS_SQL)
def _flatten_logs(t):
    return _flat_logs(envelopes.flatten_logs(envelopes.parse_requests(requests.log_requests(t.logs), "logs")))


# Several records to a request; every part keeps its type.
@query(
    "nested_values",
    """SELECT event_id, ['KVLIST', 'ARRAY', 'BYTES'][event_id % 3 + 1] AS body_type, CASE WHEN event_id % 3 = 0 THEN user_id END AS user_id,
  CASE WHEN event_id % 3 < 2 THEN event_type END AS tag, CASE WHEN event_id % 3 < 2 THEN event_id % 2 = 0 END AS is_even,
  CASE WHEN event_id % 3 < 2 THEN value END AS amount, CASE WHEN event_id % 3 <> 1 THEN event_type END AS raw,
  value AS attribute_amount, CAST(NULL AS BIGINT) AS wrong_type FROM events""",
)
def _nested(t):
    logs = envelopes.flatten_logs(envelopes.parse_requests(requests.nested_log_requests(t.table("events")), "logs"))
    body = logs.withColumn("v", nested.as_variant(F.col("body")))

    def part(in_pairs: str, in_array: str, kind: str):
        found = [nested.at_path(F.col("v"), path, kind) for path in (in_pairs, in_array)]
        return F.when(F.col("body_type") == "KVLIST", found[0]).when(F.col("body_type") == "ARRAY", found[1])

    raw = F.when(F.col("body_type") == "KVLIST", nested.at_path(F.col("v"), "$.raw", "string"))
    raw = raw.when(F.col("body_type") == "BYTES", nested.at_path(F.col("v"), "$", "string"))
    return body.select(
        values.attribute_value(logs, "event.id").cast("bigint").alias("event_id"),
        "body_type",
        F.when(F.col("body_type") == "KVLIST", nested.at_path(F.col("v"), "$.user", "bigint")).alias("user_id"),
        part("$.tags[0]", "$[0]", "string").alias("tag"),
        part("$.tags[1]", "$[1]", "boolean").alias("is_even"),
        part("$.tags[2]", "$[2]", "double").alias("amount"),
        F.decode(F.unbase64(raw), "utf-8").alias("raw"),
        nested.nested_attribute(logs, "event.tags", "$[2]", "double").alias("attribute_amount"),
        nested.nested_attribute(logs, "event.tags", "$[0].no", "bigint").alias("wrong_type"),
    )


_METRICS_SQL = """SELECT metric_name, metric_type, unit, description, temporality,
  coalesce(is_monotonic, false) AS is_monotonic, service_name, time_ns, value, a_user, a_k FROM points"""


def _flat_metrics(metrics):
    return metrics.select(
        "metric_name",
        "metric_type",
        "unit",
        "description",
        "temporality",
        F.coalesce("is_monotonic", F.lit(False)).alias("is_monotonic"),
        "service_name",
        "time_ns",
        "value",
        values.attribute_value(metrics, "user").alias("a_user"),
        values.attribute_value(metrics, "k").alias("a_k"),
    )


@query("flatten_metrics", _METRICS_SQL)
def _flatten_metrics(t):
    parsed = envelopes.parse_requests(requests.metric_requests(t.metrics), "metrics")
    return _flat_metrics(envelopes.flatten_metrics(parsed))


@query(
    "flatten_distributions",
    """SELECT metric_name, CASE event_id % 3 WHEN 0 THEN 'histogram' WHEN 1 THEN 'exponential_histogram' ELSE 'summary' END AS metric_type,
  time_ns, service_name, value,
  CASE WHEN event_id % 3 = 0 THEN CAST(list_sum([(event_id + j) % 4 FOR j IN range(0, 5)]) AS BIGINT) ELSE -1 END AS dp_count,
  CASE WHEN event_id % 3 = 0 THEN (event_id + 2) % 4 ELSE -1 END AS third_bucket,
  CASE WHEN event_id % 3 = 1 THEN event_id % 5 ELSE -1 END AS second_positive,
  CASE WHEN event_id % 3 = 2 THEN value * 1.5 ELSE -1 END AS second_quantile FROM dists""",
)
def _flatten_distributions(t):
    parsed = envelopes.parse_requests(requests.metric_requests(t.distributions), "metrics")
    absent = F.lit(-1).cast("bigint")
    return envelopes.flatten_metrics(parsed).select(
        "metric_name",
        "metric_type",
        "time_ns",
        "service_name",
        "value",
        F.coalesce("dp_count", absent).alias("dp_count"),
        F.coalesce(F.get("bucket_counts", F.lit(2)), absent).alias("third_bucket"),
        F.coalesce(F.get("positive_counts", F.lit(1)), absent).alias("second_positive"),
        F.coalesce(F.get("quantile_values", F.lit(1))["value"], F.lit(-1.0)).alias("second_quantile"),
    )


def _scratch(t, name: str) -> str:
    """A folder of its own for one run, on shared storage."""
    return f"{storage.shared_dir(t.spark)}/runs/{name}-{uuid.uuid4().hex}"


def _halves(frame, column: str):
    """The newer and the older half of a table's time span: fed in this order, the second comes late."""
    middle = frame.agg(clocks.whole_div(F.min(column) + F.max(column), 2)).scalar()
    return [frame.filter(F.col(column) >= middle), frame.filter(F.col(column) < middle)]


# A compressed file is read by one task, so it holds at most so many requests.
_PER_FILE = 100_000


def _ingested(t, name: str, signal: str, waves):
    """Land one wave of requests after the other; the job stops and starts again on its checkpoint between them."""
    root = _scratch(t, name)
    for wave in waves:
        wave.write.mode("append").options(**ingest.LANDED, maxRecordsPerFile=_PER_FILE).text(f"{root}/landing")
        options = ingest.Stream(f"{root}/checkpoint", grain="month")
        ingest.ingest(t.spark, signal, f"{root}/landing", f"{root}/facts", options).awaitTermination()
    return storage.read_facts(t.spark, f"{root}/facts")


@query("ingest_stream", _SPANS_SQL)
def _ingest_stream(t):
    waves = [requests.span_requests(half) for half in _halves(t.spans, "start_ns")]
    return _flat_spans(_ingested(t, "spans", "traces", waves))


@query("microbatch", _LOGS_SQL)
def _microbatch(t):
    waves = [requests.log_requests(t.logs.filter(f"time_ns % 3 = {n}")) for n in range(3)]
    return _flat_logs(_ingested(t, "logs", "logs", waves))


# The newer logs arrive first, and all before their spans: nothing is dropped as late.
@query(
    "late_data",
    """SELECT l.trace_id, l.span_id, l.time_ns, s.name AS span_name FROM logs l
JOIN spans s ON l.trace_id = s.trace_id AND l.span_id = s.span_id""",
)
def _late_data(t):
    arrived = _ingested(t, "late", "logs", [requests.log_requests(half) for half in _halves(t.logs, "time_ns")])
    owners = t.spans.select("trace_id", "span_id", F.col("name").alias("span_name"))
    return arrived.join(owners, ["trace_id", "span_id"]).select("trace_id", "span_id", "time_ns", "span_name")


# Half of the logs come before their spans, half after them. No wait is over while this runs.
@query(
    "log_span_stream",
    """SELECT l.trace_id, l.span_id, l.time_ns, s.name AS span_name, s.service_name AS span_service FROM logs l
JOIN spans s ON l.trace_id = s.trace_id AND l.span_id = s.span_id""",
)
def _log_span_stream(t):
    root = _scratch(t, "correlated")
    logs = t.logs.select("trace_id", "span_id", "time_ns", "body_text", "event_date")
    spans = t.spans.select("trace_id", "span_id", "name", "service_name")
    early, late = _halves(logs, "time_ns")
    none = logs.limit(0), spans.limit(0)
    for wave in ((early, none[1]), (none[0], spans), (late, spans.filter("span_id < '4'"))):  # some spans are sent again
        for rows, name in zip(wave, ("logs", "spans")):
            rows.write.mode("append").options(**storage.WRITTEN).parquet(f"{root}/{name}")
        streams = [
            correlation.with_arrival(t.spark.readStream.schema(rows.schema).parquet(f"{root}/{name}"))
            for rows, name in ((logs, "logs"), (spans, "spans"))
        ]
        joined = correlation.match_logs(*streams)
        sink = correlation.land_matches(f"{root}/matched", f"{root}/unmatched", "month")
        correlation.start_matching(joined, sink, ingest.Stream(f"{root}/checkpoint")).awaitTermination()
    return storage.read_facts(t.spark, f"{root}/matched").select("trace_id", "span_id", "time_ns", "span_name", "span_service")


@query("append_facts", "SELECT trace_id, span_id, start_ns, kind FROM spans")
def _append(t):
    path = _scratch(t, "append")
    rows = t.spans.select("trace_id", "span_id", "start_ns", "kind", "event_date")
    for batch_id, part in ((0, "kind < 2"), (1, "kind in (2, 3)"), (1, "kind in (2, 3)"), (2, "kind > 3")):  # 1 is replayed
        storage.append_batch(rows.filter(part), path, batch_id, "month")
    return storage.read_facts(t.spark, path).select("trace_id", "span_id", "start_ns", "kind")


def _stream(t, name: str, waves, sink):
    """Run a sink over waves of a table in its own partitions, a micro-batch and a restart each."""
    root = _scratch(t, name)
    for wave in waves:
        wave.write.mode("append").options(**storage.WRITTEN).parquet(f"{root}/in")
        source = t.spark.readStream.schema(wave.schema).parquet(f"{root}/in")
        ingest.start(source, sink(f"{root}/out"), ingest.Stream(f"{root}/checkpoint")).awaitTermination()
    return f"{root}/out"


@query(
    "dims_stream",
    """SELECT 'service' AS dim, service_name, NULL AS name, min(start_ns) AS first_seen_ns, max(start_ns) AS last_seen_ns FROM spans GROUP BY service_name
UNION ALL SELECT 'operation', service_name, name || kind, min(start_ns), max(start_ns) FROM spans GROUP BY service_name, name, kind""",
)
def _dims_stream(t):
    narrow = t.spans.select("service_name", "name", "kind", "resource", "start_ns")
    root = _stream(t, "dims", _halves(narrow, "start_ns"), ingest.keep_dimensions)
    ingest.compact_dimensions(t.spark, root)
    columns = ["dim", "service_name", "name", "first_seen_ns", "last_seen_ns"]
    none = F.lit(None).cast("string")
    service = ingest.read_dimension(t.spark, root, "service").select("*", F.lit("service").alias("dim"), none.alias("name"))
    operation = ingest.read_dimension(t.spark, root, "operation").select(
        F.lit("operation").alias("dim"), "service_name", F.concat("name", F.col("kind").cast("string")).alias("name"),
        "first_seen_ns", "last_seen_ns",
    )
    return service.select(columns).unionByName(operation.select(columns))


_WAVES = {"spans": "kind < 3", "logs": "severity_number < 9", "points": "metric_type = 'gauge'"}


@query(
    "ingest_volume",
    " UNION ALL ".join(
        f"""SELECT '{signal}' AS signal, CAST(2 AS BIGINT) AS batch_count, CAST(a + b AS BIGINT) AS row_count,
  CAST(least(a, b) AS BIGINT) AS smallest_batch, CAST(least(a, b) AS BIGINT) AS median_batch, CAST(greatest(a, b) AS BIGINT) AS largest_batch
FROM (SELECT count(*) FILTER ({wave}) AS a, count(*) FILTER (NOT ({wave})) AS b FROM {signal})"""
        for signal, wave in _WAVES.items()
    ),
)
def _volume(t):
    parts = []
    for (signal, wave), table in zip(_WAVES.items(), (t.spans, t.logs, t.metrics)):
        narrow = table.select("service_name", "event_date", F.expr(f"{wave}").alias("first"))
        waves = [narrow.filter("first"), narrow.filter("NOT first")]

        def sink(out, signal=signal):
            return ingest.keep_volume(f"{out}/volume", signal, ingest.append_to(f"{out}/facts", "month"))

        parts.append(ingest.read_volume(t.spark, f"{_stream(t, 'volume', waves, sink)}/volume"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SERIES = ", ".join(spanmetrics.DIMENSIONS)
_FIGURES = ", ".join(f"CAST(sum({c}) OVER r AS BIGINT) AS {c}" for c in spanmetrics.FIGURES)


@query(
    "span_metrics_stream",
    f""", counted AS (SELECT {DIMENSIONS_SQL}, (end_ns // {spanmetrics.FLUSH_NS} + 1) * {spanmetrics.FLUSH_NS} AS flush_ns,
  count(*) AS calls, sum(end_ns - start_ns) AS duration_sum_ns, {LE_SQL} FROM spans GROUP BY ALL),
idle AS (SELECT *, CASE WHEN flush_ns - lag(flush_ns) OVER (PARTITION BY {_SERIES} ORDER BY flush_ns) > {spanmetrics.EXPIRE_NS} THEN 1 ELSE 0 END AS restart FROM counted),
lives AS (SELECT *, sum(restart) OVER (PARTITION BY {_SERIES} ORDER BY flush_ns) AS life FROM idle)
SELECT {_SERIES}, flush_ns, {_FIGURES} FROM lives WINDOW r AS (PARTITION BY {_SERIES}, life ORDER BY flush_ns)""",
)
def _span_metrics_stream(t):
    narrow = t.spans.select(
        "service_name", "name", "kind", "status_code", "start_ns", "end_ns", "attributes", "`http.method`", "`http.status_code`"
    )
    table = _stream(t, "spanmetrics", _halves(narrow, "start_ns"), ingest.keep_span_metrics)
    ingest.compact_span_metrics(t.spark, table)
    return ingest.read_span_metrics(t.spark, table, spanmetrics.EXPIRE_NS)


_SINCE_NS, _YEAR_NS = clocks.parse_bound("1997-03-01T00:00:00Z"), 365 * counters.DAY_NS


# The newer half lands first, so the older one corrects its snapshots.
@query(
    "span_metrics_since",
    f""", counted AS (SELECT {DIMENSIONS_SQL}, (end_ns // {spanmetrics.FLUSH_NS} + 1) * {spanmetrics.FLUSH_NS} AS flush_ns,
  count(*) AS calls, sum(end_ns - start_ns) AS duration_sum_ns, {LE_SQL} FROM spans GROUP BY ALL),
running AS (SELECT {_SERIES}, flush_ns, {_FIGURES} FROM counted WINDOW r AS (PARTITION BY {_SERIES} ORDER BY flush_ns))
SELECT * FROM running WHERE flush_ns >= {_SINCE_NS}""",
)
def _span_metrics_since(t):
    narrow = t.spans.select(
        "service_name", "name", "kind", "status_code", "start_ns", "end_ns", "attributes", "`http.method`", "`http.status_code`"
    )
    sink = lambda out: counters.keep_counters(out, None, apart_ns=_YEAR_NS, grain="month")
    table = _stream(t, "counters", _halves(narrow, "start_ns"), sink)
    return counters.read_since(t.spark, table, _SINCE_NS, None, _YEAR_NS)


# Names are admitted by first sight, within a micro-batch and between them, so points come in time order.
@query(
    "cardinality_guard_stream",
    """SELECT metric_name, time_ns, value FROM points WHERE metric_name IN (
  SELECT metric_name FROM points GROUP BY metric_name ORDER BY min(time_ns), metric_name LIMIT 3)""",
)
def _guard_stream(t):
    narrow = t.metrics.select("metric_name", "time_ns", "value", "event_date")
    waves = reversed(_halves(narrow, "time_ns"))
    out = _stream(t, "guard", waves, lambda out: ingest.guarded(f"{out}/points", f"{out}/names", 3, "month"))
    return storage.read_facts(t.spark, f"{out}/points").select("metric_name", "time_ns", "value")


# Sketches are held against the exact counts: three standard errors, or one where counts are small.
@query(
    "cardinality_sketches",
    """SELECT metric_name, label, CAST(count(*) AS BIGINT) AS point_count, min(time_ns) AS first_ns, max(time_ns) AS last_ns,
  CAST(count(DISTINCT label_value) AS BIGINT) AS exact_values, true AS is_within_bound
FROM (SELECT metric_name, time_ns, unnest(['user', 'k']) AS label, unnest([a_user, a_k]) AS label_value FROM points) GROUP BY ALL
UNION ALL SELECT metric_name, NULL, sum(n), min(first_ns), max(last_ns), count(*), true
FROM (SELECT metric_name, service_name, label, count(*) AS n, min(time_ns) AS first_ns, max(time_ns) AS last_ns FROM points GROUP BY ALL) GROUP BY metric_name""",
)
def _sketches(t):
    narrow = t.metrics.select("metric_name", "service_name", "attributes", "time_ns", "event_date")
    table = _stream(t, "sketches", _halves(narrow, "time_ns"), lambda out: catalogue.keep_sketches(out, "month"))
    catalogue.compact(t.spark, table, "month")
    labels = metrics.label_cardinality(t.metrics).select("metric_name", "label", F.col("distinct_values").alias("exact_values"))
    series = metrics.active_series(t.metrics, _NOW_NS).select(
        "metric_name", F.lit(None).cast("string").alias("label"), F.col("total_series").alias("exact_values")
    )
    exact = labels.unionByName(series).withColumnsRenamed({"metric_name": "_metric", "label": "_label"})
    same = (F.col("metric_name") == F.col("_metric")) & F.col("label").eqNullSafe(F.col("_label"))
    off = F.abs(F.col("distinct_values") - F.col("exact_values"))
    within = off <= F.greatest(F.lit(1.0), 3 * catalogue.ERROR * F.col("exact_values"))
    kept = catalogue.cardinalities(t.spark, table).join(exact, same).withColumn("is_within_bound", within)
    return kept.select("metric_name", "label", "point_count", "first_ns", "last_ns", "exact_values", "is_within_bound")


_NOW_NS = clocks.parse_bound("1998-07-01T00:00:00Z")
_LIVE_MINUTES = 30 * 24 * 60


@query(
    "red_live",
    f"""SELECT service_name, CAST(count(*) AS BIGINT) AS request_count, CAST(count(*) FILTER (status_code = 2) AS BIGINT) AS error_count,
  round(count(*) FILTER (status_code = 2) / count(*) * 100, 2) AS error_rate,
  round(quantile_cont(end_ns - start_ns, 0.5) / 1e6, 2) AS p50_latency_ms,
  round(quantile_cont(end_ns - start_ns, 0.95) / 1e6, 2) AS p95_latency_ms,
  round(quantile_cont(end_ns - start_ns, 0.99) / 1e6, 2) AS p99_latency_ms, min(start_ns) AS first_seen
FROM spans WHERE start_ns >= {_NOW_NS - _LIVE_MINUTES * 60 * 10**9} AND start_ns < {_NOW_NS} GROUP BY service_name""",
)
def _red_live(t):
    narrow = t.spans.select("span_id", "service_name", "status_code", "start_ns", "end_ns", "event_date")
    sinks = lambda out: ingest.fan_out(ingest.append_to(f"{out}/spans", "month"), live.keep_panes(f"{out}/panes", "month"))
    out = _stream(t, "live", _halves(narrow, "start_ns"), sinks)
    live.compact_panes(t.spark, f"{out}/panes", "month")
    return live.red_window(t.spark, f"{out}/panes", f"{out}/spans", _NOW_NS, _LIVE_MINUTES)


@query(
    "fan_out",
    """SELECT 'fact' AS target, trace_id || '/' || span_id AS id, start_ns AS figure FROM spans
UNION ALL SELECT 'calls', service_name, count(*) FROM spans GROUP BY service_name
UNION ALL SELECT 'service', service_name, min(start_ns) FROM spans GROUP BY service_name""",
)
def _fan_out(t):
    narrow = t.spans.select(
        "trace_id", "span_id", "service_name", "name", "kind", "status_code", "start_ns", "end_ns", "event_date", "resource",
        "attributes", "`http.method`", "`http.status_code`",
    )
    out = _stream(
        t,
        "fan",
        _halves(narrow, "start_ns"),
        lambda out: ingest.fan_out(
            ingest.append_to(f"{out}/facts", "month"),
            ingest.keep_span_metrics(f"{out}/calls", MONTH_NS),
            ingest.keep_dimensions(f"{out}/dims"),
        ),
    )

    def rows(target: str, frame, figure):
        return frame.select(F.lit(target).alias("target"), "id", F.col(figure).cast("bigint").alias("figure"))

    facts = storage.read_facts(t.spark, f"{out}/facts").withColumn("id", F.concat("trace_id", F.lit("/"), "span_id"))
    calls = storage.read_facts(t.spark, f"{out}/calls").groupBy(F.col("service_name").alias("id")).agg(F.sum("calls").alias("n"))
    known = ingest.read_dimension(t.spark, f"{out}/dims", "service").withColumnRenamed("service_name", "id")
    return rows("fact", facts, "start_ns").unionByName(rows("calls", calls, "n")).unionByName(rows("service", known, "first_seen_ns"))


# The newer half comes first; then everything, so that half is a resend and the rest is late by years. What comes
# last are small batches of resends, which look their ids up.
@query("dedup_stream", "SELECT trace_id, span_id, start_ns FROM spans")
def _dedup_stream(t):
    narrow = t.spans.select("trace_id", "span_id", "start_ns", "event_date")
    newest = narrow.join(F.broadcast(narrow.agg(F.max("event_date").alias("event_date"))), "event_date", "left_semi")
    waves = [_halves(narrow, "start_ns")[0], narrow, narrow.filter("start_ns % 2 = 0"), newest]
    out = _stream(t, "dedup", waves, lambda out: ingest.keep_first(out, "month"))
    return storage.read_facts(t.spark, out).select("trace_id", "span_id", "start_ns")


# A trace is decided once the watermark, 10 s behind the newest span, is 10 s past its first second.
_DECIDED_SQL = f""", waits AS (SELECT trace_id, min(start_ns) // 1000000000 + 10 AS until FROM spans GROUP BY trace_id),
heard AS (SELECT spans.* FROM spans JOIN waits USING (trace_id) WHERE start_ns // 1000000000 < until),
decided AS (SELECT trace_id, span_count, is_kept FROM ({SAMPLING_SQL.replace("FROM spans", "FROM heard")}) JOIN waits USING (trace_id)
WHERE until * 1000 <= (SELECT max(start_ns) // 1000000 - 10000 FROM spans))"""


def _tail_wave(t, root: str, wave) -> None:
    """Land the decisions that a wave of spans brings, by a restart of the job."""
    wave.write.mode("append").parquet(f"{root}/in")
    source = t.spark.readStream.schema(wave.schema).parquet(f"{root}/in")
    decided = stream_sampling.decisions(stream_sampling.trace_flags(source, POLICY), POLICY)
    options = ingest.Stream(f"{root}/checkpoint", grain="month")
    stream_sampling.land_decisions(decided, f"{root}/decided", options).awaitTermination()


def _tail_spans(t):
    return t.spans.select("trace_id", "span_id", "service_name", "status_code", "start_ns", "`http.status_code`", "event_date")


@query("tail_sampling_stream", f"{_DECIDED_SQL} SELECT trace_id, span_count, is_kept FROM decided")
def _tail_stream(t):
    root = _scratch(t, "tail")
    for wave in reversed(_halves(_tail_spans(t), "start_ns")):
        _tail_wave(t, root, wave)
    return storage.read_facts(t.spark, f"{root}/decided").select("trace_id", "span_count", "is_kept")


# Each wave lands decisions and then the spans they keep; spans of decided traces that land later follow.
@query(
    "tail_sampling_landed",
    f"{_DECIDED_SQL} SELECT trace_id, span_id, start_ns FROM spans WHERE trace_id IN (SELECT trace_id FROM decided WHERE is_kept)",
)
def _tail_landed(t):
    root, (newer, older) = _scratch(t, "tail"), _halves(_tail_spans(t), "start_ns")
    late = older.filter("span_id >= 'c'")  # lands with the second wave, though decided with the first
    for number, (heard, landed) in enumerate(((older, older.filter("span_id < 'c'")), (newer, newer.unionByName(late)))):
        _tail_wave(t, root, heard)
        storage.append_batch(landed, f"{root}/landed", number, "month")
        stream_sampling.land_kept(t.spark, f"{root}/landed", f"{root}/decided", f"{root}/kept", "month")
    return storage.read_facts(t.spark, f"{root}/kept").select("trace_id", "span_id", "start_ns")


_HORIZON, _KEEP_DAYS = "1998-08-01", 90


@query(
    "retention",
    f"""SELECT trace_id, span_id, start_ns FROM spans
WHERE date_trunc('month', make_timestamp(start_ns // 1000)) + INTERVAL 1 MONTH > DATE '{_HORIZON}' - {_KEEP_DAYS}""",
)
def _retention(t):
    path = _scratch(t, "retention")
    storage.append_batch(t.spans.select("trace_id", "span_id", "start_ns", "event_date"), path, 0, "month")
    storage.drop_expired(t.spark, path, _HORIZON, _KEEP_DAYS, "month")
    return storage.read_facts(t.spark, path).select("trace_id", "span_id", "start_ns")


# A window over a table by month, part of it rolled in twice: folders outside the window are not opened.
_LANDED = TimeRange("1995-03-10T00:00:00Z", "1995-07-02T00:00:00Z")


@query("time_range_landed", f"SELECT trace_id, span_id, start_ns FROM spans WHERE start_ns >= {_LANDED.start_ns} AND start_ns < {_LANDED.end_ns}")
def _time_range_landed(t):
    path = _scratch(t, "window")
    rows = t.spans.select("trace_id", "span_id", "start_ns", "event_date")
    for batch_id in range(4):
        storage.append_batch(rows.filter(f"start_ns % 4 = {batch_id}"), path, batch_id, "month")
        if batch_id > 1:
            storage.compact(t.spark, path, "month")
    return in_range(storage.read_facts(t.spark, path), _LANDED).select("trace_id", "span_id", "start_ns")


_CLOCK = clocks.parse_bound("1998-06-15T12:00:00Z")


@query("retention_by_clock", f"SELECT trace_id, span_id, start_ns FROM spans WHERE start_ns >= {_CLOCK - _KEEP_DAYS * counters.DAY_NS}")
def _retention_by_clock(t):
    path = _scratch(t, "retained")
    storage.append_batch(t.spans.select("trace_id", "span_id", "start_ns", "event_date"), path, 0, "month")
    kept = storage.retain_by_clock(storage.read_facts(t.spark, path), _CLOCK, _KEEP_DAYS * counters.DAY_NS, "start_ns")
    return kept.select("trace_id", "span_id", "start_ns")


# Ids as bytes and clocks as microseconds with the nanoseconds left over, and back.
@query(
    "span_stored_form",
    """SELECT trace_id, span_id, start_ns // 1000 AS start_us, CAST(start_ns % 1000 AS SMALLINT) AS start_nanos, start_ns,
  (end_ns - start_ns) / 1e6 AS duration_ms, CAST(http_status AS DOUBLE) AS http_status FROM spans""",
)
def _stored_form(t):
    start = F.col("start_ns")
    stored = t.spans.select(
        F.unhex("trace_id").alias("trace"), F.unhex("span_id").alias("span"), clocks.to_timestamp(start).alias("at"),
        clocks.nanos_fraction(start).alias("start_nanos"), clocks.duration_ms(start, F.col("end_ns")).alias("duration_ms"),
        values.any_number(F.col("attributes")["http.status_code"]).alias("http_status"),
    )
    return stored.select(
        identifiers.bytes_hex(F.col("trace")).alias("trace_id"), identifiers.bytes_hex(F.col("span")).alias("span_id"),
        F.unix_micros("at").alias("start_us"), "start_nanos", clocks.from_timestamp(F.col("at"), F.col("start_nanos")).alias("start_ns"),
        "duration_ms", "http_status",
    )


_BOUNDS_SQL = ", ".join([*(f"{b}::DOUBLE" for b in spanmetrics.BUCKETS_MS), "'inf'::DOUBLE"])
_COUNTS_SQL = ", ".join([*(f"le_{b}" for b in spanmetrics.BUCKETS_MS), "calls"])


@query(
    "span_metric_buckets",
    f"""SELECT {_SERIES}, CAST(unnest([{_BOUNDS_SQL}]) AS VARCHAR) AS le_ms, CAST(unnest([{_COUNTS_SQL}]) AS BIGINT) AS cumulative_count
FROM (SELECT {DIMENSIONS_SQL}, count(*) AS calls, {LE_SQL} FROM spans GROUP BY ALL)""",
)
def _metric_buckets(t):
    rows = spanmetrics.bucket_rows(spanmetrics.span_metrics(t.spans))
    le = F.when(F.col("le_ms") == float("inf"), "inf").otherwise(F.col("le_ms").cast("string"))
    return rows.withColumn("le_ms", le)


_MONTHS = "SELECT CAST(date_trunc('month', make_timestamp(start_ns // 1000)) AS DATE) AS d, count(*) AS n FROM spans GROUP BY 1"


@query(
    "partition_inventory",
    f"""SELECT d AS partition_date, CAST(n AS BIGINT) AS row_count, CAST(max(d) OVER () - d AS INT) AS age_days, true AS has_size FROM ({_MONTHS})""",
)
def _inventory(t):
    path = _scratch(t, "inventory")
    storage.append_batch(t.spans.select("trace_id", "span_id", "start_ns", "event_date"), path, 0, "month")
    found = storage.partition_inventory(storage.read_facts(t.spark, path), "event_month")
    return found.select(F.col("event_month").alias("partition_date"), "row_count", "age_days", (F.col("total_bytes") > 0).alias("has_size"))


@query(
    "export_json",
    """SELECT '{"trace_id":"' || trace_id || '","span_id":"' || span_id || '","parent_span_id":' ||
  coalesce('"' || parent_span_id || '"', 'null') || ',"kind":' || kind || ',"start_ns":' || start_ns || '}' AS json FROM spans""",
)
def _export(t):
    path = f"{_scratch(t, 'export')}/json"
    storage.as_json(t.spans.select("trace_id", "span_id", "parent_span_id", "kind", "start_ns")).write.text(path)
    return t.spark.read.text(path).withColumnRenamed("value", "json")


@query(
    "remote_write_to_metrics",
    """SELECT 'events_' || event_type AS metric_name, 'svc-' || (user_id % 5) AS service_name, epoch_us(ts) // 1000 * 1000000 AS time_ns, value, CAST(user_id AS VARCHAR) AS user_label FROM events
UNION ALL SELECT metric_name, service_name, time_ns, value, a_user FROM points""",
)
def _remote_write(t):
    labels = F.create_map(
        F.lit("__name__"), F.concat(F.lit("events_"), "event_type"),
        F.lit("job"), F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")),
        F.lit("user"), F.col("user_id").cast("string"),
    )
    time_ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz '1970-01-01 00:00:00', ts)")
    samples = t.table("events").select(labels.alias("labels"), time_ms.alias("time_ms"), "value")
    joined = envelopes.remote_write_metrics(samples).unionByName(t.metrics, allowMissingColumns=True)
    return joined.select(
        "metric_name", "service_name", "time_ns", "value", values.attribute_value(joined, "user").alias("user_label")
    )


@query("tail_sampling_applied", f"""SELECT service_name, CAST(count(*) AS BIGINT) AS span_count FROM spans
WHERE trace_id IN (SELECT trace_id FROM ({SAMPLING_SQL}) WHERE is_kept) GROUP BY service_name""")
def _applied(t):
    kept = batch_sampling.keep(t.spans, batch_sampling.decisions(t.spans, POLICY))
    return kept.groupBy("service_name").agg(F.count("*").alias("span_count"))
