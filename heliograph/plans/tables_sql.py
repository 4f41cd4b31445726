"""The derived tables as DuckDB SQL, flat: attributes appear as columns or as key / value rows."""

from __future__ import annotations

import re

_EVENT_NS = "epoch_us(ts) * 1000"
_HTTP = "CASE l_returnflag WHEN 'R' THEN 500 + l_partkey % 4 WHEN 'A' THEN 404 ELSE 200 END"

TABLES = {
    "lines": """
SELECT l.*, row_number() OVER (
  PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS seq
FROM lineitem l""",
    "placed": """
SELECT l.*, s_name, p_type, p_brand,
  epoch_us(o_orderdate) * 1000 + (seq - 1) * 7000000 + l_partkey % 1000 AS start_ns,
  CASE WHEN seq = 1 THEN 2 ELSE CAST(l_partkey % 6 AS INT) END AS kind
FROM lines l JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
JOIN part ON l_partkey = p_partkey""",
    "spans": f"""
SELECT md5(CAST(l_orderkey AS VARCHAR)) AS trace_id,
  substr(md5(l_orderkey || '-' || seq), 1, 16) AS span_id,
  CASE WHEN seq > 1 THEN substr(md5(l_orderkey || '-' || (seq // 2)), 1, 16) END AS parent_span_id,
  substr(md5(l_orderkey || '-1'), 1, 16) AS root_id,
  seq, p_type AS name, kind,
  CAST(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS INT) AS status_code,
  CASE WHEN l_returnflag = 'R' THEN 'failed' END AS status_message,
  start_ns,
  start_ns + CASE WHEN l_discount = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 1000000 + l_suppkey % 1000 END AS end_ns,
  s_name AS service_name, l_suppkey AS service_id, 'ns-' || (l_suppkey % 3) AS namespace,
  CASE WHEN kind IN (2, 3) THEN {_HTTP} END AS http_status,
  CASE WHEN kind IN (2, 3) THEN CASE WHEN l_linenumber % 2 = 1 THEN 'GET' ELSE 'POST' END END AS http_method,
  CASE WHEN seq = 1 AND l_partkey % 3 = 0 THEN 'https://shop.example.com/orders/' || p_type || '?full=1'
       WHEN kind = 3 AND l_linenumber = 5 THEN 'http://' || p_type || '.example.com:8080/call' END AS http_url,
  CASE WHEN seq = 1 AND l_partkey % 3 = 1 THEN '/r/' || p_type END AS http_route,
  CASE WHEN seq = 1 AND l_partkey % 3 = 2 THEN '/t' END AS http_target,
  CASE WHEN seq = 1 THEN 'https' END AS http_scheme,
  CASE WHEN seq = 1 THEN 'shop.example.com' WHEN kind = 3 AND l_linenumber = 3 THEN p_brand || '.local:5432' END
    AS server_address,
  CASE WHEN kind = 3 AND l_linenumber % 2 = 0 THEN 'postgresql' END AS db_system,
  CASE WHEN kind = 3 AND l_linenumber % 2 = 0 THEN p_brand END AS db_name,
  CASE WHEN kind = 3 AND l_linenumber = 1 THEN p_type END AS peer_service,
  CASE WHEN kind IN (4, 5) THEN 'kafka' END AS messaging_system,
  CASE WHEN kind IN (4, 5) THEN p_type END AS messaging_destination,
  CASE WHEN kind = 5 AND l_linenumber % 2 = 0 THEN p_type || '-in' END AS messaging_source,
  l_discount AS discount, l_returnflag = 'N' AS is_open
FROM placed""",
    "logs": """
SELECT CASE WHEN event_id % 3 <> 0 THEN md5(CAST(event_id % 2000 AS VARCHAR)) END AS trace_id,
  CASE WHEN event_id % 3 <> 0 THEN substr(md5((event_id % 2000) || '-1'), 1, 16) END AS span_id,
  epoch_us(ts) * 1000 + event_id % 1000 AS time_ns, epoch_us(ts) * 1000 + 5000000 AS observed_ns,
  CAST(CASE event_type WHEN 'error' THEN 17 WHEN 'signup' THEN 13 WHEN 'purchase' THEN 9 WHEN 'view' THEN 5 ELSE 1 END
    AS INT) AS severity_number,
  event_type || ' ' || props AS body_text, 'svc-' || (user_id % 5) AS service_name,
  'ns-' || (user_id % 3) AS namespace,
  event_type AS a_event_type, CAST(user_id AS VARCHAR) AS a_user_id,
  CAST(NULL AS VARCHAR) AS a_span_kind, CAST(NULL AS VARCHAR) AS a_span_name, CAST(NULL AS VARCHAR) AS a_last
FROM events
UNION ALL
SELECT trace_id, span_id, start_ns + 1000000, NULL, CASE WHEN status_code = 2 THEN 17 ELSE 9 END,
  CASE WHEN status_code = 2 THEN '' ELSE 'span ' || name END, service_name, namespace,
  NULL, NULL, CAST(kind AS VARCHAR), name, span_id
FROM spans WHERE span_id < '8'""",
    "points": f"""
SELECT event_id, 'events.' || event_type AS metric_name,
  CASE WHEN event_type IN ('click', 'view') THEN 'gauge' ELSE 'sum' END AS metric_type,
  CASE WHEN event_type = 'purchase' THEN 'USD' ELSE '1' END AS unit,
  CASE WHEN user_id % 2 = 0 THEN 'Number of ' || event_type ELSE event_type || ' events' END AS description,
  CASE WHEN event_type NOT IN ('click', 'view') THEN 'CUMULATIVE' END AS temporality,
  CASE WHEN event_type NOT IN ('click', 'view') THEN true END AS is_monotonic,
  'svc-' || (user_id % 5) AS service_name, {_EVENT_NS} AS time_ns, value,
  CAST(user_id AS VARCHAR) AS a_user, json_extract_string(props, '$.k') AS a_k,
  'k=' || json_extract_string(props, '$.k') || ', user=' || user_id AS label
FROM events""",
    "exemplars": f"""
SELECT event_id, 'events.' || event_type AS metric_name, 'svc-' || (user_id % 5) AS service_name,
  {_EVENT_NS} AS time_ns, value, md5(CAST(event_id % 2000 AS VARCHAR)) AS trace_id,
  CASE WHEN event_id % 10 = 0 THEN repeat('e', 16) ELSE substr(md5((event_id % 2000) || '-1'), 1, 16) END AS span_id
FROM events WHERE event_id % 5 = 0""",
    "dists": f"""
SELECT event_id, user_id, 'dist.' || event_type AS metric_name, 'svc-' || (user_id % 5) AS service_name,
  {_EVENT_NS} AS time_ns, value
FROM events""",
    "turns": """
SELECT t.*, p.text AS prompt_text FROM conversations t
LEFT JOIN conversations p ON p.conv_id = t.conv_id AND p.turn = t.turn - 1""",
    "genai": """
SELECT md5('conv-' || conv_id) AS trace_id, substr(md5('conv-' || conv_id || '-' || turn), 1, 16) AS span_id,
  CASE role WHEN 'assistant' THEN 'chat' WHEN 'system' THEN 'Tool setup' ELSE 'ask' END AS name,
  1700000000000000000 + conv_id * 60000000000 + turn * 2000000000 AS start_ns,
  length(text) AS text_length, length(text) / 1000.0 AS duration_seconds, 'agent-' || (conv_id % 4) AS service_name,
  conv_id % 3 AS family, role = 'assistant' AS is_answer,
  CASE WHEN role = 'assistant' THEN 'model-' || (conv_id % 3) END AS model,
  CASE WHEN role = 'assistant' THEN length(prompt_text) // 4 END AS asked,
  CASE WHEN role = 'assistant' THEN length(text) // 4 END AS answered,
  CASE WHEN role = 'assistant' THEN nullif(prompt_text, '') END AS prompt,
  CASE WHEN role = 'assistant' THEN nullif(text, '') END AS response
FROM turns""",
    "span_attributes": """
SELECT trace_id, span_id, unnest([
  {'key': 'http.status_code', 'value_type': 'int', 'value': CAST(http_status AS VARCHAR)},
  {'key': 'http.method', 'value_type': 'string', 'value': http_method},
  {'key': 'http.url', 'value_type': 'string', 'value': http_url},
  {'key': 'http.route', 'value_type': 'string', 'value': http_route},
  {'key': 'http.target', 'value_type': 'string', 'value': http_target},
  {'key': 'http.scheme', 'value_type': 'string', 'value': http_scheme},
  {'key': 'server.address', 'value_type': 'string', 'value': server_address},
  {'key': 'db.system', 'value_type': 'string', 'value': db_system},
  {'key': 'db.name', 'value_type': 'string', 'value': db_name},
  {'key': 'peer.service', 'value_type': 'string', 'value': peer_service},
  {'key': 'messaging.system', 'value_type': 'string', 'value': messaging_system},
  {'key': 'messaging.destination', 'value_type': 'string', 'value': messaging_destination},
  {'key': 'messaging.source.name', 'value_type': 'string', 'value': messaging_source},
  {'key': 'line.discount', 'value_type': 'double', 'value': CAST(discount AS VARCHAR)},
  {'key': 'line.open', 'value_type': 'bool', 'value': CAST(is_open AS VARCHAR)}
], recursive := true) FROM spans""",
    "red_spans": "SELECT *, end_ns - start_ns AS duration_ns FROM spans",
    "remote_edges": """
SELECT * FROM (
  SELECT CASE WHEN kind = 5 THEN coalesce(messaging_source, messaging_destination) ELSE service_name END AS source,
    CASE WHEN kind = 5 THEN service_name WHEN kind = 4 THEN messaging_destination
      ELSE coalesce(db_name, peer_service, split_part(server_address, ':', 1),
        nullif(lower(regexp_extract(http_url, '//([^/:]+)', 1)), '')) END AS target,
    end_ns - start_ns AS duration_ns, status_code
  FROM spans WHERE kind IN (3, 4, 5)) WHERE source IS NOT NULL AND target IS NOT NULL""",
    "child_edges": """
SELECT p.service_name AS source, c.service_name AS target, c.end_ns - c.start_ns AS duration_ns, c.status_code
FROM spans c JOIN spans p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id
WHERE c.kind NOT IN (3, 4, 5) AND p.kind <> 3 AND c.service_name <> p.service_name""",
    "map_edges": """
SELECT source, target, CAST(count(*) AS BIGINT) AS call_count,
  round(sum(duration_ns) FILTER (duration_ns <> 0) / count(*) FILTER (duration_ns <> 0) / 1e6, 2) AS avg_duration_ms,
  CAST(count(*) FILTER (status_code = 2) AS BIGINT) AS error_count
FROM (SELECT * FROM remote_edges UNION ALL SELECT * FROM child_edges) GROUP BY source, target""",
    "map_nodes": """
SELECT id, CASE max(rank) WHEN 3 THEN 'database' WHEN 2 THEN 'messaging' ELSE 'service' END AS type,
  CASE WHEN max(rank) = 3 THEN min(db_system) END AS db_system,
  CASE WHEN max(rank) = 2 THEN min(messaging_system) END AS messaging_system
FROM (
  SELECT service_name AS id, 1 AS rank, NULL AS db_system, NULL AS messaging_system FROM spans
  UNION ALL SELECT db_name, 3, db_system, NULL FROM spans WHERE kind = 3 AND db_name IS NOT NULL
  UNION ALL SELECT target, 1, NULL, NULL FROM remote_edges
  UNION ALL SELECT messaging_destination, 2, NULL, messaging_system FROM spans WHERE kind = 4
  UNION ALL SELECT coalesce(messaging_source, messaging_destination), 2, NULL, messaging_system FROM spans WHERE kind = 5
) GROUP BY id""",
    "red": """
SELECT service_name, CAST(count(*) AS BIGINT) AS request_count,
  CAST(count(*) FILTER (status_code = 2) AS BIGINT) AS error_count,
  round(count(*) FILTER (status_code = 2) / count(*) * 100, 2) AS error_rate,
  round(quantile_cont(duration_ns, 0.5) / 1e6, 2) AS p50_latency_ms,
  round(quantile_cont(duration_ns, 0.95) / 1e6, 2) AS p95_latency_ms,
  round(quantile_cont(duration_ns, 0.99) / 1e6, 2) AS p99_latency_ms,
  min(start_ns) AS first_seen, max(start_ns) AS last_seen
FROM red_spans GROUP BY service_name""",
    "bounds": """
SELECT trace_id, min(start_ns) AS trace_start_ns, max(end_ns) AS trace_end_ns, CAST(count(*) AS BIGINT) AS span_count
FROM spans GROUP BY trace_id""",
    "roots": """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY start_ns, span_id) AS rn FROM spans) WHERE rn = 1""",
    "summaries": """
SELECT r.trace_id, r.service_name, r.name AS root_span_name, r.http_method AS root_span_method,
  r.http_url AS root_span_url, r.http_route AS root_span_route,
  CASE WHEN r.http_url IS NOT NULL THEN regexp_extract(r.http_url, '//[^/]+([^?]*)', 1)
    ELSE coalesce(r.http_route, r.http_target) END AS root_span_target,
  r.server_address AS root_span_host, r.http_scheme AS root_span_scheme, r.server_address AS root_span_server_name,
  CAST(r.http_status AS INT) AS root_span_status_code, r.status_code AS root_status,
  r.status_message AS root_status_message, r.span_id AS root_span_id,
  b.trace_start_ns AS start_ns, b.trace_end_ns AS end_ns,
  (b.trace_end_ns - b.trace_start_ns) / 1e9 AS duration_seconds, b.span_count
FROM roots r JOIN bounds b USING (trace_id)""",
}


def rfc3339_sql(ns: str) -> str:
    return (
        f"strftime(make_timestamp({ns} // 1000), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST({ns} % 1000000000 AS VARCHAR), 9, '0') || 'Z'"
    )


def _needs(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", sql, re.IGNORECASE)]


def with_tables(sql: str) -> str:
    """Prefix a statement with the derived tables it reads, in the order they build on one another.

    A statement that starts with a comma brings tables of its own, which may be recursive.
    """
    needed: set[str] = set()
    todo = _needs(sql)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += _needs(TABLES[name])
    if not needed:
        return sql
    parts = ", ".join(f"{t} AS ({TABLES[t]})" for t in TABLES if t in needed)
    return f"WITH RECURSIVE {parts}{sql}" if sql.startswith(",") else f"WITH {parts} {sql}"
