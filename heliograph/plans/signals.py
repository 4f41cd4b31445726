"""Span, log and metric tables derived from the star schema, as FIXTURES.md defines.

The tables stand for what ingest would have written, so each is derived once per application,
written as Parquet to the shared folder in day order, and read from there by every query: filters
and column choices then reach the scan as they would on a real table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import clocks, enums, values
from heliograph.operators.attributes import SPAN_KEYS, with_key_columns
from heliograph.operators.positions import number_rows
from heliograph.sources.storage import checkpoint, id_filters, shared_dir, write_alone

_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
_BOUNDS = [10.0, 50.0, 100.0, 250.0]
_ready: dict[tuple[str, str, str], str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stored(spark: SparkSession, sf_dir: str, name: str, derive, finish=None) -> DataFrame:
    """The table that ``derive`` makes; with ``finish`` that makes narrow rows, which are put in order slice by slice."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _ready:
        source = hashlib.md5(sf_dir.encode()).hexdigest()
        path = f"{shared_dir(spark)}/signals-{key[0]}/{source}/{name}"

        def parts() -> Iterator[DataFrame]:
            made = derive(spark, sf_dir)
            yield from (made,) if finish is None else (finish(part) for part in _slices(made))

        write_alone(spark, path, parts(), lambda columns: id_filters(columns))
        _ready[key] = path
    return spark.read.parquet(_ready[key])


# A table of more rows is put in time order in so many parts, one after the other, as the shuffle of a part goes before
# the next one's.
_WHOLE, _SLICES = 4_000_000, 3


def _slices(rows: DataFrame) -> Iterator[DataFrame]:
    """All rows, in slices of time where they are many, by their first column."""
    time = F.col(rows.columns[0])
    count, bounds = rows.agg(F.count("*"), F.percentile_approx(time, [n / _SLICES for n in range(1, _SLICES)])).first()
    if count <= _WHOLE or bounds is None:
        yield rows
        return
    number = sum((F.when(time >= bound, 1).otherwise(0) for bound in bounds), F.lit(0))  # 0 of rows without a time
    for n in range(_SLICES):
        yield rows.filter(number == n)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "spans", _timed_spans, _finished_spans)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "logs", _timed_logs, _finished_logs)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "metrics", _derive_metrics)


def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "distributions", _derive_distributions)


def genai_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "genai", _derive_genai)


def _span_id(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("-", *parts)), 1, 16)


def _text(value: Column | str) -> Column:
    return values.any_value(string=F.lit(value) if isinstance(value, str) else value)


def _int(value: Column) -> Column:
    return values.any_value(integer=value)


def _micros(column: str) -> Column:
    """Microseconds since the epoch of a timestamp without time zone, whatever the session's."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', {column})")


def _derive_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finished_spans(_timed_spans(spark, sf_dir))


def _timed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with their start, without ids and maps."""
    lines = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_discount", "l_quantity", *_LINE_ORDER
    )
    joined = (
        number_rows(lines, ["l_orderkey"], _LINE_ORDER, "seq")
        .join(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.expr("l_orderkey = o_orderkey"))
        .join(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.expr("l_suppkey = s_suppkey"))
        .join(_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand"), F.expr("l_partkey = p_partkey"))
    )
    c = F.col
    start_ns = _micros("o_orderdate") * 1000 + (c("seq") - 1) * 7_000_000 + c("l_partkey") % 1000
    # Written, so that the joins' shuffles go before the table is put in time order, which reads its input twice.
    return checkpoint(
        joined.select(
            start_ns.alias("start_ns"), "seq", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag",
            "l_discount", "l_quantity", "s_name", "p_type", "p_brand",
        )
    )


def _finished_spans(timed: DataFrame) -> DataFrame:
    """Spans in time order, those of a trace together in each file."""
    c = F.col
    kind = F.when(c("seq") == 1, 2).otherwise(c("l_partkey") % 6).cast("int")
    status = F.when(c("l_returnflag") == "R", 2).when(c("l_returnflag") == "A", 1).otherwise(0)
    duration = F.when(c("l_discount") == 0, 0).otherwise(
        c("l_quantity").cast("bigint") * 1_000_000 + c("l_suppkey") % 1000
    )
    # Put in time order while rows are narrow. Ids are made after it; those of a trace shrink to one where they meet.
    ordered = timed.repartitionByRange("start_ns", "l_orderkey", "seq").sortWithinPartitions("l_orderkey", "seq")
    placed = ordered.select(
        "*",
        F.md5(c("l_orderkey").cast("string")).alias("trace_id"),
        _span_id(c("l_orderkey"), c("seq")).alias("span_id"),
        _span_id(c("l_orderkey"), F.lit(1)).alias("root_id"),
        F.when(c("seq") > 1, _span_id(c("l_orderkey"), clocks.whole_div(c("seq"), 2))).alias("parent_span_id"),
        kind.alias("kind"),
        status.alias("status_code"),
        (c("start_ns") + duration).alias("end_ns"),
    )
    line, is_http = c("l_linenumber"), c("kind").isin(2, 3)
    is_root, is_client, is_queue = c("seq") == 1, c("kind") == 3, c("kind").isin(4, 5)
    http_status = (
        F.when(c("l_returnflag") == "R", 500 + c("l_partkey") % 4).when(c("l_returnflag") == "A", 404).otherwise(200)
    )
    url = F.concat(F.lit("https://shop.example.com/orders/"), c("p_type"), F.lit("?full=1"))
    remote_url = F.concat(F.lit("http://"), c("p_type"), F.lit(".example.com:8080/call"))
    pick = c("l_partkey") % 3
    tags = {
        "http.status_code": _int(F.when(is_http, http_status)),
        "http.method": _text(F.when(is_http, F.when(line % 2 == 1, "GET").otherwise("POST"))),
        "http.url": _text(F.when(is_root & (pick == 0), url).when(is_client & (line == 5), remote_url)),
        "http.route": _text(F.when(is_root & (pick == 1), F.concat(F.lit("/r/"), c("p_type")))),
        "http.target": _text(F.when(is_root & (pick == 2), F.lit("/t"))),
        "http.scheme": _text(F.when(is_root, F.lit("https"))),
        "server.address": _text(
            F.when(is_root, F.lit("shop.example.com")).when(
                is_client & (line == 3), F.concat(c("p_brand"), F.lit(".local:5432"))
            )
        ),
        "db.system": _text(F.when(is_client & (line % 2 == 0), F.lit("postgresql"))),
        "db.name": _text(F.when(is_client & (line % 2 == 0), c("p_brand"))),
        "peer.service": _text(F.when(is_client & (line == 1), c("p_type"))),
        "messaging.system": _text(F.when(is_queue, F.lit("kafka"))),
        "messaging.destination": _text(F.when(is_queue, c("p_type"))),
        "messaging.source.name": _text(
            F.when((c("kind") == 5) & (line % 2 == 0), F.concat(c("p_type"), F.lit("-in")))
        ),
        "line.discount": values.any_value(double=c("l_discount")),
        "line.open": values.any_value(boolean=c("l_returnflag") == "N"),
    }
    none = F.array().cast(f"array<struct<name:string,time_ns:bigint,attributes:{values.ATTRIBUTES}>>")
    events = F.when(
        c("status_code") == 2,
        F.array(
            F.struct(
                F.lit("exception").alias("name"),
                c("end_ns").alias("time_ns"),
                values.attribute_map({"exception.type": _text(c("p_type"))}).alias("attributes"),
            )
        ),
    ).otherwise(none)
    no_links = F.array().cast(
        "array<struct<trace_id:string,span_id:string,trace_state:string,"
        f"attributes:{values.ATTRIBUTES},dropped_attributes_count:int>>"
    )

    def link(target: Column) -> Column:
        return F.array(
            F.struct(
                c("trace_id"),
                target.alias("span_id"),
                F.lit("").alias("trace_state"),
                values.attribute_map({"link.kind": _text(F.lit("follows"))}).alias("attributes"),
                F.lit(0).alias("dropped_attributes_count"),
            )
        )

    links = (
        F.when((c("kind") == 5) & ~is_root, link(c("root_id")))
        .when((c("kind") == 0) & ~is_root, link(F.lit("f" * 16)))
        .otherwise(no_links)
    )
    resource = values.attribute_map(
        {
            "service.name": _text(c("s_name")),
            "service.namespace": _text(F.concat(F.lit("ns-"), (c("l_suppkey") % 3).cast("string"))),
        }
    )
    rows = placed.select(
        "trace_id",
        "span_id",
        "parent_span_id",
        c("p_type").alias("name"),
        "kind",
        "status_code",
        F.when(c("status_code") == 2, "failed").alias("status_message"),
        "start_ns",
        "end_ns",
        c("s_name").alias("service_name"),
        c("l_suppkey").alias("service_id"),
        resource.alias("resource"),
        F.struct(F.lit("lines").alias("name"), F.lit("1").alias("version")).alias("scope"),
        values.attribute_map(tags).alias("attributes"),
        events.alias("events"),
        links.alias("links"),
        clocks.event_date(c("start_ns")).alias("event_date"),
        # What the map is made of is at hand, so no key is looked up in it.
        *[values.any_text(tags[key]).alias(key) if key in tags else F.lit(None).cast("string").alias(key) for key in SPAN_KEYS],
    )
    return with_key_columns(rows)


_SEVERITY = {"error": 17, "signup": 13, "purchase": 9, "view": 5, "click": 1}


def _derive_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finished_logs(_timed_logs(spark, sf_dir))


def _timed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with their time, without maps."""
    c = F.col
    order = (c("event_id") % 2000).cast("string")
    severity = F.create_map(*[F.lit(x) for pair in _SEVERITY.items() for x in pair])[c("event_type")]
    user = (c("user_id") % 5).cast("string")
    from_events = _table(spark, sf_dir, "events").select(
        (_micros("ts") * 1000 + c("event_id") % 1000).alias("time_ns"),
        F.when(c("event_id") % 3 != 0, F.md5(order)).alias("trace_id"),
        F.when(c("event_id") % 3 != 0, _span_id(order, F.lit(1))).alias("span_id"),
        (_micros("ts") * 1000 + 5_000_000).alias("observed_ns"),
        severity.alias("severity_number"),
        F.concat_ws(" ", "event_type", "props").alias("body_text"),
        F.concat(F.lit("svc-"), user).alias("service_name"),
        F.concat(F.lit("ns-"), (c("user_id") % 3).cast("string")).alias("namespace"),
        "event_type",
        "user_id",
    )
    from_spans = (
        spans(spark, sf_dir)
        .filter(c("span_id") < "8")
        .select(
            (c("start_ns") + 1_000_000).alias("time_ns"),
            "trace_id",
            "span_id",
            F.lit(None).cast("bigint").alias("observed_ns"),
            F.when(c("status_code") == 2, 17).otherwise(9).alias("severity_number"),
            F.when(c("status_code") == 2, "").otherwise(F.concat(F.lit("span "), c("name"))).alias("body_text"),
            "service_name",
            values.any_text(c("resource")["service.namespace"]).alias("namespace"),
            "kind",
            "name",
            F.lit(True).alias("is_span"),
        )
    )
    return from_events.unionByName(from_spans, allowMissingColumns=True)


def _finished_logs(timed: DataFrame) -> DataFrame:
    c = F.col
    # Maps are made after rows are put in time order. A row has the columns of one side, so it gets that side's keys.
    rows = timed.repartitionByRange("time_ns", "service_name").sortWithinPartitions("trace_id")
    attributes = {
        "event.type": _text(c("event_type")),
        "user.id": _int(c("user_id")),
        "attributes.span.kind": _int(c("kind")),
        "span.name": _text(c("name")),
        "z.last": _text(F.when(c("is_span"), c("span_id"))),
    }
    return rows.select(
        "trace_id",
        "span_id",
        "time_ns",
        "observed_ns",
        (c("time_ns") + 2_000_000).alias("ingest_ns"),
        "severity_number",
        enums.label(c("severity_number"), enums.SEVERITIES).alias("severity_text"),
        values.any_value(string=c("body_text")).alias("body"),
        "body_text",
        "service_name",
        values.attribute_map(
            {"service.name": _text(c("service_name")), "service.namespace": _text(c("namespace"))}
        ).alias("resource"),
        F.struct(F.lit("events").alias("name"), F.lit("1").alias("version")).alias("scope"),
        values.attribute_map(attributes).alias("attributes"),
        clocks.event_date(c("time_ns")).alias("event_date"),
    )


def _metric_rows(events: DataFrame, **columns: Column) -> DataFrame:
    """Metric rows from events; columns not given are empty."""
    c = F.col
    order = (c("event_id") % 2000).cast("string")
    time_ns = _micros("ts") * 1000
    exemplar = F.array(
        F.struct(
            F.md5(order).alias("trace_id"),
            F.when(c("event_id") % 10 == 0, F.lit("e" * 16)).otherwise(_span_id(order, F.lit(1))).alias("span_id"),
            time_ns.alias("time_ns"),
            c("value").alias("value"),
        )
    )
    no_exemplars = F.array().cast("array<struct<trace_id:string,span_id:string,time_ns:bigint,value:double>>")
    empty = {
        "temporality": "string",
        "is_monotonic": "boolean",
        "dp_count": "bigint",
        "dp_sum": "double",
        "bucket_counts": "array<bigint>",
        "explicit_bounds": "array<double>",
        "scale": "int",
        "zero_count": "bigint",
        "positive_offset": "int",
        "positive_counts": "array<bigint>",
        "negative_offset": "int",
        "negative_counts": "array<bigint>",
        "quantile_values": "array<struct<quantile:double,value:double>>",
    }
    service = F.concat(F.lit("svc-"), (c("user_id") % 5).cast("string"))
    return events.repartitionByRange("ts", "event_id").select(
        columns["metric_name"].alias("metric_name"),
        columns["metric_type"].alias("metric_type"),
        F.when(c("event_type") == "purchase", "USD").otherwise("1").alias("unit"),
        F.when(c("user_id") % 2 == 0, F.concat(F.lit("Number of "), c("event_type")))
        .otherwise(F.concat(c("event_type"), F.lit(" events")))
        .alias("description"),
        service.alias("service_name"),
        values.attribute_map({"service.name": _text(service)}).alias("resource"),
        F.struct(F.lit("events").alias("name"), F.lit("1").alias("version")).alias("scope"),
        time_ns.alias("time_ns"),
        (time_ns - 60_000_000_000).alias("start_ns"),
        values.attribute_map(
            {"user": _int(c("user_id")), "k": _text(F.get_json_object("props", "$.k"))}
        ).alias("attributes"),
        columns["value"].alias("value"),
        *[
            (columns[name] if name in columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in empty.items()
        ],
        F.when(c("event_id") % 5 == 0, exemplar).otherwise(no_exemplars).alias("exemplars"),
        clocks.event_date(time_ns).alias("event_date"),
    )


def _derive_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_gauge = F.col("event_type").isin("click", "view")
    return _metric_rows(
        _table(spark, sf_dir, "events"),
        metric_name=F.concat(F.lit("events."), F.col("event_type")),
        metric_type=F.when(is_gauge, "gauge").otherwise("sum"),
        value=F.col("value"),
        temporality=F.when(~is_gauge, "CUMULATIVE"),
        is_monotonic=F.when(~is_gauge, F.lit(True)),
    )


def _derive_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as histogram, exponential histogram and summary points, by event_id."""
    value, number = F.col("value"), F.col("event_id")
    which = number % 3
    is_histogram, is_exponential, is_summary = which == 0, which == 1, which == 2
    counts = F.transform(F.sequence(F.lit(0), F.lit(len(_BOUNDS))), lambda i: (number + i) % 4)
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return _metric_rows(
        _table(spark, sf_dir, "events"),
        metric_name=F.concat(F.lit("dist."), F.col("event_type")),
        metric_type=F.when(is_histogram, "histogram").when(is_exponential, "exponential_histogram").otherwise("summary"),
        value=value,
        temporality=F.when(~is_summary, "DELTA"),
        dp_count=F.when(is_histogram, total),
        dp_sum=value,
        bucket_counts=F.when(is_histogram, counts),
        explicit_bounds=F.when(is_histogram, F.array(*[F.lit(b) for b in _BOUNDS])),
        scale=F.when(is_exponential, number % 5 - 2),
        zero_count=F.when(is_exponential, number % 7),
        positive_offset=F.when(is_exponential, F.col("user_id") % 5),
        positive_counts=F.when(is_exponential, F.array(number % 4, number % 5)),
        negative_offset=F.when(is_exponential, F.lit(1)),
        negative_counts=F.when(is_exponential, F.array(number % 2)),
        quantile_values=F.when(
            is_summary,
            F.array(
                *[
                    F.struct(F.lit(q).alias("quantile"), (value * factor).alias("value"))
                    for q, factor in ((0.5, 1.0), (0.9, 1.5), (0.99, 2.0))
                ]
            ),
        ),
    )


def _derive_genai(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as spans; the prompt of a turn is the text of the turn before."""
    c = F.col
    turns = _table(spark, sf_dir, "conversations")
    before = turns.select("conv_id", (c("turn") + 1).alias("turn"), c("text").alias("prompt"))
    joined = turns.join(before, ["conv_id", "turn"], "left")
    conv = c("conv_id").cast("string")
    family, is_answer = c("conv_id") % 3, c("role") == "assistant"
    model = F.concat(F.lit("model-"), family.cast("string"))
    asked = clocks.whole_div(F.length("prompt"), 4)
    answered = clocks.whole_div(F.length("text"), 4)
    start_ns = F.lit(1_700_000_000_000_000_000) + c("conv_id") * 60_000_000_000 + c("turn") * 2_000_000_000

    def when(member: int, value: Column) -> Column:
        return F.when(is_answer & (family == member), value)

    attributes = values.attribute_map(
        {
            "gen_ai.request.model": _text(when(0, model)),
            "gen_ai.system": _text(when(2, model)),
            "llm.model": _text(when(1, model)),
            "gen_ai.prompt.0.content": _text(when(0, c("prompt"))),
            "llm.prompt": _text(when(1, c("prompt"))),
            "gen_ai.request.prompt": _text(when(2, c("prompt"))),
            "gen_ai.completion.0.content": _text(when(0, c("text"))),
            "llm.completion": _text(when(1, c("text"))),
            "gen_ai.response": _text(when(2, c("text"))),
            "gen_ai.usage.input_tokens": _int(F.coalesce(when(0, asked), when(2, asked))),
            "gen_ai.usage.output_tokens": _int(F.coalesce(when(0, answered), when(2, answered))),
            "gen_ai.usage.total_tokens": _int(when(0, asked + answered)),
            "llm.usage.prompt_tokens": _int(when(1, asked)),
            "llm.usage.completion_tokens": _int(when(1, answered)),
            "llm.usage.total_tokens": _int(when(1, asked + answered)),
            "gen_ai.request.temperature": values.any_value(double=when(0, F.lit(0.5))),
            "llm.max_tokens": _int(when(1, F.lit(256))),
        }
    )
    name = F.when(is_answer, "chat").when(c("role") == "system", "Tool setup").otherwise("ask")
    return joined.repartitionByRange("conv_id", "turn").select(
        F.md5(F.concat(F.lit("conv-"), conv)).alias("trace_id"),
        _span_id(F.lit("conv"), conv, c("turn")).alias("span_id"),
        F.when(c("turn") > 0, _span_id(F.lit("conv"), conv, F.lit(0))).alias("parent_span_id"),
        name.alias("name"),
        F.lit(3).alias("kind"),
        F.lit(1).alias("status_code"),
        F.lit(None).cast("string").alias("status_message"),
        start_ns.alias("start_ns"),
        (start_ns + F.length("text") * 1_000_000).alias("end_ns"),
        F.concat(F.lit("agent-"), (c("conv_id") % 4).cast("string")).alias("service_name"),
        attributes.alias("attributes"),
        clocks.event_date(start_ns).alias("event_date"),
    )
