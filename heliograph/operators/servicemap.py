"""Service dependency map: who calls whom, from span kinds and parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions import enums, values, web
from heliograph.operators import filters as flt
from heliograph.operators import services, traces

# Highest wins when several spans describe the same node.
NODE_TYPES = {3: "database", 2: "messaging", 1: "service"}
_SELF_DESCRIBING = (enums.KIND_CLIENT, enums.KIND_PRODUCER, enums.KIND_CONSUMER)


def span_calls(spans: DataFrame, time_range: flt.TimeRange | None = None, written: bool = False) -> DataFrame:
    """The latest copy of each span in the window, cut down to what the map needs.

    A span that is sent again counts once. Copies collapse on narrow rows, before anything is joined.
    """
    kind = F.col("kind")
    narrow = flt.in_range(spans, time_range).select(
        "trace_id",
        "span_id",
        "parent_span_id",
        "service_name",
        "kind",
        "status_code",
        "start_ns",
        "end_ns",
        F.when(kind == enums.KIND_CLIENT, web.client_target(spans))
        .when(kind == enums.KIND_PRODUCER, web.message_destination(spans))
        .when(kind == enums.KIND_CONSUMER, web.message_source(spans))
        .alias("remote"),
        F.when(kind == enums.KIND_CLIENT, web.client_database(spans)).alias("database"),
        values.first_attribute(spans, "db.system").alias("db_system"),
        values.first_attribute(spans, "messaging.system").alias("messaging_system"),
    )
    return traces.dedup_spans(narrow, keep="last", written=written).filter(F.col("service_name").isNotNull())


def _tally(source: Column, target: Column) -> list[Column]:
    """Inputs of the edge figures; zero durations stay out of the average."""
    duration = F.col("end_ns") - F.col("start_ns")
    return [
        source.alias("source"),
        target.alias("target"),
        F.lit(1).cast("bigint").alias("calls"),
        F.when(duration != 0, duration).alias("duration_ns"),
        F.when(services.is_error(), 1).otherwise(0).alias("errors"),
    ]


def remote_calls(calls: DataFrame) -> DataFrame:
    """Edges that a CLIENT, PRODUCER or CONSUMER span states by itself; an unknown end is NULL."""
    service, remote = F.col("service_name"), F.col("remote")
    receives = F.col("kind") == enums.KIND_CONSUMER
    known = calls.filter(F.col("kind").isin(*_SELF_DESCRIBING))
    return known.select(
        *_tally(F.when(receives, remote).otherwise(service), F.when(receives, service).otherwise(remote))
    )


def parent_child(spans: DataFrame) -> DataFrame:
    """SERVER, INTERNAL and unspecified spans with a parent in another service that is not CLIENT, each span once.

    The key includes the span id, so a huge trace spreads over all tasks; children of one hot
    parent are split by the adaptive skew join.
    """
    narrow = spans.select("trace_id", "span_id", "parent_span_id", "service_name", "kind", "start_ns", "end_ns")
    once = traces.dedup_spans(narrow, keep="last", written=True)
    children = once.filter(~F.col("kind").isin(*_SELF_DESCRIBING) & F.col("parent_span_id").isNotNull())
    parents = once.filter(F.col("kind") != enums.KIND_CLIENT).select(
        "trace_id", F.col("span_id").alias("parent_span_id"), F.col("service_name").alias("parent_service")
    )
    return children.join(parents, ["trace_id", "parent_span_id"]).filter("parent_service <> service_name")


def _parent_child_tally(calls: DataFrame) -> DataFrame:
    """Parent-child edges, with children counted per (parent, service) before they meet the parent."""
    duration = F.col("end_ns") - F.col("start_ns")
    children = (
        calls.filter(~F.col("kind").isin(*_SELF_DESCRIBING) & F.col("parent_span_id").isNotNull())
        .groupBy("trace_id", "parent_span_id", "service_name")
        .agg(
            F.count("*").alias("calls"),
            F.sum(F.when(duration != 0, duration)).alias("duration_sum"),
            F.count(F.when(duration != 0, 1)).alias("duration_count"),
            F.count(F.when(services.is_error(), 1)).alias("errors"),
        )
    )
    parents = calls.filter(F.col("kind") != enums.KIND_CLIENT).select(
        "trace_id", F.col("span_id").alias("parent_span_id"), F.col("service_name").alias("source")
    )
    return (
        children.join(parents, ["trace_id", "parent_span_id"])
        .filter("source <> service_name")
        .select("source", F.col("service_name").alias("target"), "calls", "duration_sum", "duration_count", "errors")
    )


def edges(spans: DataFrame, time_range: flt.TimeRange | None = None) -> DataFrame:
    """Calls, average non-zero duration and errors per (source, target)."""
    return _edges(span_calls(spans, time_range, written=True))


def _edges(calls: DataFrame) -> DataFrame:
    remote = (
        remote_calls(calls)
        .groupBy("source", "target")
        .agg(
            F.sum("calls").alias("calls"),
            F.sum("duration_ns").alias("duration_sum"),
            F.count("duration_ns").alias("duration_count"),
            F.sum("errors").alias("errors"),
        )
        .filter("source is not null and target is not null")
    )
    return (
        remote.unionByName(_parent_child_tally(calls))
        .groupBy("source", "target")
        .agg(
            F.sum("calls").alias("call_count"),
            F.round(
                F.sum("duration_sum") / F.nullif(F.sum("duration_count"), F.lit(0).cast("bigint")) / 1e6, 2
            ).alias("avg_duration_ms"),
            F.sum("errors").alias("error_count"),
        )
    )


def nodes(spans: DataFrame, time_range: flt.TimeRange | None = None) -> DataFrame:
    """A node per service, database, messaging destination and external target.

    Each span names up to two nodes; they are exploded and grouped in one pass.
    """
    return _nodes(span_calls(spans, time_range))


def _nodes(calls: DataFrame) -> DataFrame:
    kind, database, db_system = F.col("kind"), F.col("database"), F.col("db_system")
    queue, messaging_system = F.when(kind != enums.KIND_CLIENT, F.col("remote")), F.col("messaging_system")

    def node(node_id: Column, rank: int, database_system: Column, queue_system: Column) -> Column:
        return F.struct(
            node_id.alias("id"),
            F.lit(rank).alias("rank"),
            database_system.alias("db_system"),
            queue_system.alias("messaging_system"),
        )

    none = F.lit(None).cast("string")
    remote = (
        F.when((kind == enums.KIND_CLIENT) & database.isNotNull(), node(database, 3, db_system, none))
        .when(kind == enums.KIND_CLIENT, node(F.col("remote"), 1, none, none))
        .when(queue.isNotNull(), node(queue, 2, none, messaging_system))
    )
    named = calls.select(F.explode(F.array(node(F.col("service_name"), 1, none, none), remote)).alias("n"))
    grouped = (
        named.filter("n.id is not null")
        .groupBy(F.col("n.id").alias("id"))
        .agg(
            F.max("n.rank").alias("rank"),
            F.min("n.db_system").alias("db_system"),
            F.min("n.messaging_system").alias("messaging_system"),
        )
    )
    return grouped.select(
        "id",
        enums.label(F.col("rank"), NODE_TYPES).alias("type"),
        F.when(F.col("rank") == 3, F.col("db_system")).alias("db_system"),
        F.when(F.col("rank") == 2, F.col("messaging_system")).alias("messaging_system"),
    )


def node_metrics(spans: DataFrame, time_range: flt.TimeRange | None = None) -> DataFrame:
    """Map nodes with their request figures and whether no edge touches them.

    The narrow calls are written once and read by the figures, the edges and the nodes.
    """
    calls = span_calls(spans, time_range, written=True)
    figures = services.red(calls)
    touched = (
        _edges(calls)
        .select(F.explode(F.array("source", "target")).alias("id"))
        .distinct()
        .withColumn("linked", F.lit(True))
    )
    return (
        _nodes(calls)
        .join(figures.withColumnRenamed("service_name", "id"), "id", "left")
        .join(touched, "id", "left")
        .select(
            "id",
            "type",
            F.coalesce("request_count", F.lit(0)).alias("request_count"),
            F.coalesce("error_count", F.lit(0)).alias("error_count"),
            F.coalesce("error_rate", F.lit(0.0)).alias("error_rate"),
            "p50_latency_ms",
            "p95_latency_ms",
            "p99_latency_ms",
            F.col("linked").isNull().alias("isolated"),
        )
    )
