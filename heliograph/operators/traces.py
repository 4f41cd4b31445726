"""Trace search, summaries, detail and waterfall."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.functions import clocks, values, web
from heliograph.operators import filters as flt
from heliograph.operators import paging
from heliograph.operators.positions import number_rows, sum_before
from heliograph.operators.sides import broadcast_if_small
from heliograph.sources.storage import checkpoint, checkpoint_alone

ROOT_RULES = ("earliest", "parentless")
NO_PARENT = "0" * 16

_NEWEST_TRACE = [("earliest_ns", True), ("trace_id", False)]
NEWEST_SPAN = [("start_ns", True), ("span_id", False)]
OLDEST_SPAN = [("start_ns", False), ("span_id", False)]


def matching_traces(
    spans: DataFrame,
    time_range: flt.TimeRange | None = None,
    filters: Iterable[flt.Filter] = (),
    limit: int = paging.DEFAULT_LIMIT,
    cursor: tuple | None = None,
) -> DataFrame:
    """Traces with a matching span, newest first by their earliest matching span."""
    matching = flt.apply_filters(flt.in_range(spans, time_range), filters)
    earliest = matching.groupBy("trace_id").agg(F.min("start_ns").alias("earliest_ns"))
    return paging.page(earliest, _NEWEST_TRACE, limit, cursor, wide=False)


def spans_of(spans: DataFrame, traces: DataFrame) -> DataFrame:
    """All spans of a page of traces, in or out of the window. A page is at most 1000 ids."""
    return spans.join(F.broadcast(traces.select("trace_id")), "trace_id", "left_semi")


def search_traces(
    spans: DataFrame,
    time_range: flt.TimeRange | None = None,
    filters: Iterable[flt.Filter] = (),
    limit: int = paging.DEFAULT_LIMIT,
    cursor: tuple | None = None,
) -> DataFrame:
    """Summaries of the matching traces, in search order. The page of ids is kept, as it is read twice."""
    found = checkpoint(matching_traces(spans, time_range, filters, limit, cursor))
    summaries = trace_summaries(spans_of(spans, found))
    return summaries.join(F.broadcast(found), "trace_id").orderBy(F.desc("earliest_ns"), "trace_id")


def _is_parentless() -> Column:
    parent = F.coalesce(F.col("parent_span_id"), F.lit(""))
    return parent.isin("", NO_PARENT)


def root_order(rule: str = "earliest") -> Column:
    """Sort key whose minimum is the root span of a trace."""
    if rule not in ROOT_RULES:
        raise ValueError(f"unknown root rule {rule!r}")
    rank = F.lit(0) if rule == "earliest" else F.when(_is_parentless(), 0).otherwise(1)
    return F.struct(rank.alias("rank"), F.col("start_ns"), F.col("span_id"))


def trace_summaries(spans: DataFrame, root_rule: str = "earliest") -> DataFrame:
    """One row per trace: root span metadata, bounds, duration and span count.

    A single aggregation that combines on the map side, so a trace of any size costs one row per
    task in the shuffle.
    """
    root = F.struct(
        F.col("service_name"),
        F.col("name").alias("root_span_name"),
        values.first_attribute(spans, "http.method", "http.request.method").alias("root_span_method"),
        values.first_attribute(spans, "http.url", "url.full").alias("root_span_url"),
        values.first_attribute(spans, "http.route").alias("root_span_route"),
        web.request_target(spans).alias("root_span_target"),
        values.first_attribute(spans, "http.host", "net.host.name", "server.address").alias("root_span_host"),
        values.first_attribute(spans, "http.scheme", "url.scheme").alias("root_span_scheme"),
        values.first_attribute(spans, "server.address", "net.host.name").alias("root_span_server_name"),
        web.http_status(spans).alias("root_span_status_code"),
        F.col("status_code").alias("root_status"),
        F.col("status_message").alias("root_status_message"),
        F.col("span_id").alias("root_span_id"),
    )
    grouped = spans.groupBy("trace_id").agg(
        F.min_by(root, root_order(root_rule)).alias("root"),
        F.min("start_ns").alias("start_ns"),
        F.max("end_ns").alias("end_ns"),
        F.count("*").alias("span_count"),
    )
    return grouped.select(
        "trace_id",
        "root.*",
        "start_ns",
        "end_ns",
        clocks.rfc3339(F.col("start_ns")).alias("start_time"),
        clocks.rfc3339(F.col("end_ns")).alias("end_time"),
        clocks.duration_seconds(F.col("start_ns"), F.col("end_ns")).alias("duration_seconds"),
        "span_count",
    )


def root_spans(spans: DataFrame, root_rule: str = "earliest") -> DataFrame:
    """The root span of every trace; an aggregate instead of numbering all spans of a trace."""
    row = F.struct("span_id", "name", "service_name", "start_ns", "end_ns")
    return spans.groupBy("trace_id").agg(F.min_by(row, root_order(root_rule)).alias("r")).select("trace_id", "r.*")


def trace_bounds(spans: DataFrame) -> DataFrame:
    return spans.groupBy("trace_id").agg(
        F.min("start_ns").alias("trace_start_ns"),
        F.max("end_ns").alias("trace_end_ns"),
        F.count("*").alias("span_count"),
    )


def with_trace_bounds(spans: DataFrame) -> DataFrame:
    """Every span with the bounds and span count of its trace.

    Aggregated and joined back instead of windowed: the aggregate combines on the map side. It is
    written before the join: an aggregate that is itself dealt out by trace would keep the adaptive
    skew join from splitting the spans of one huge trace.
    """
    return spans.join(checkpoint(trace_bounds(spans)), "trace_id")


def trace_detail(spans: DataFrame, trace_ids: Iterable[str]) -> DataFrame:
    """All spans of the given traces, one row per span, in start order."""
    return spans.filter(F.col("trace_id").isin(list(trace_ids))).orderBy("trace_id", "start_ns", "span_id")


def trace_documents(spans: DataFrame, part_size: int = 1000) -> DataFrame:
    """Traces as nested records, split into parts of at most ``part_size`` spans in start order.

    A usual trace is one record; a huge one is several, so no record grows with the data.
    """
    numbered = number_rows(spans, ["trace_id"], ["start_ns", "span_id"], "position").withColumn("span", F.struct(*spans.columns))
    part = clocks.whole_div(F.col("position") - 1, part_size).alias("part")
    # Spans hold maps, which have no order: compare positions only.
    in_order = F.array_sort(
        F.collect_list(F.struct("position", "span")), lambda a, b: (a["position"] - b["position"]).cast("int")
    )
    return numbered.groupBy("trace_id", part).agg(
        F.count("*").alias("span_count"),
        F.min("start_ns").alias("first_start_ns"),
        F.transform(in_order, lambda item: item["span"]).alias("spans"),
    )


def search_spans(
    spans: DataFrame,
    time_range: flt.TimeRange | None = None,
    filters: Iterable[flt.Filter] = (),
    limit: int = paging.DEFAULT_LIMIT,
    cursor: tuple | None = None,
    oldest_first: bool = False,
) -> DataFrame:
    matching = flt.apply_filters(flt.in_range(spans, time_range), filters)
    return paging.page(matching, OLDEST_SPAN if oldest_first else NEWEST_SPAN, limit, cursor)


def span_view(spans: DataFrame) -> DataFrame:
    """Spans in the shape the query API answers with."""

    def listed(attributes: Column) -> Column:
        return F.transform(
            F.array_sort(F.map_entries(attributes)), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))
        )

    def nullable(items: Column) -> Column:
        return F.when(F.size(items) > 0, items)

    events = F.transform(
        "events",
        lambda e: F.struct(
            e["name"].alias("name"),
            clocks.rfc3339(e["time_ns"]).alias("timestamp"),
            listed(e["attributes"]).alias("attributes"),
        ),
    )
    links = F.transform(
        "links",
        lambda k: F.struct(
            k["trace_id"].alias("trace_id"), k["span_id"].alias("span_id"), listed(k["attributes"]).alias("attributes")
        ),
    )
    status = F.when(
        F.col("status_code").isNotNull(),
        F.struct(F.col("status_code").alias("code"), F.col("status_message").alias("message")),
    )
    return spans.select(
        "trace_id",
        "span_id",
        "parent_span_id",
        "name",
        "kind",
        clocks.rfc3339(F.col("start_ns")).alias("start_time"),
        clocks.rfc3339(F.col("end_ns")).alias("end_time"),
        clocks.duration_seconds(F.col("start_ns"), F.col("end_ns")).alias("duration_seconds"),
        listed(F.col("attributes")).alias("attributes"),
        nullable(events).alias("events"),
        nullable(links).alias("links"),
        status.alias("status"),
        "resource",
        "service_name",
        "scope",
    )


def dedup_spans(
    spans: DataFrame, by: tuple[str, ...] = ("trace_id", "span_id"), keep: str = "first", written: bool = False
) -> DataFrame:
    """One row per span: of copies the first or last by (start, end, rest of the row as text).

    Few spans are sent again, so keys that come twice are found first, by a hash aggregate over a number made of the
    key; no other column is read for that. Only rows with such a number are collapsed, which takes a sort as rows have
    no fixed width; the others, and a table without copies, stay as they are. Copies collapse on the map side, so many
    copies of one span shuffle as few rows.

    Where too many keys come twice to be broadcast, equal rows become one first. That is a hash aggregate without a
    sort, and as a rule leaves few copies, those that differ from their original. What is left is written for that;
    ``written`` asks for a result that is, in any case, for callers that read it more than once.
    """
    finished = checkpoint if written else lambda rows: rows
    number = F.xxhash64(*by).alias("_number")
    repeated = _repeated(spans, number)
    if repeated.isEmpty():
        return finished(spans)
    side = broadcast_if_small(repeated)
    if side is repeated and _groups_exactly(spans.schema):
        spans = checkpoint(spans.distinct())
        repeated = _repeated(spans, number)
        if repeated.isEmpty():
            return spans
        side = broadcast_if_small(repeated)
    numbered = spans.select("*", number)
    once, copies = (numbered.join(side, "_number", how).drop("_number") for how in ("left_anti", "left_semi"))
    return finished(once.unionByName(_collapsed(copies, by, keep)))


def _repeated(spans: DataFrame, number: Column) -> DataFrame:
    """The numbers that come twice, written."""
    return checkpoint(spans.groupBy(number).agg(F.count("*").alias("_n")).filter("_n > 1").select("_number"))


def _groups_exactly(kind: T.DataType) -> bool:
    """Whether values of a type are the same to a GROUP BY only if they are; it takes 0.0 and -0.0 as one, for example."""
    if isinstance(kind, T.StructType):
        return all(_groups_exactly(field.dataType) for field in kind)
    if isinstance(kind, T.ArrayType):
        return _groups_exactly(kind.elementType)
    if isinstance(kind, T.StringType):
        return kind == T.StringType()
    return not isinstance(kind, (T.MapType, T.VariantType, T.FloatType, T.DoubleType))


def _collapsed(spans: DataFrame, by: tuple[str, ...], keep: str) -> DataFrame:
    rest = [c for c in spans.columns if c not in by]
    copy = F.struct(*rest)
    # Maps have no order, so a row that holds any is compared by its text.
    comparable = [F.col(c) for c in rest] if _orderable(spans.select(rest).schema) else [F.to_json(copy).alias("text")]
    order = F.struct(F.col("start_ns").alias("first"), F.col("end_ns").alias("second"), *comparable)
    pick = F.min_by if keep == "first" else F.max_by
    return spans.groupBy(*by).agg(pick(copy, order).alias("copy")).select(*by, "copy.*").select(*spans.columns)


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(field.dataType) for field in kind)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def events(spans: DataFrame) -> DataFrame:
    """One row per span event."""
    return spans.select("trace_id", "span_id", F.posexplode("events").alias("event_index", "e")).select(
        "trace_id", "span_id", "event_index", "e.name", "e.time_ns", "e.attributes"
    )


def links(spans: DataFrame) -> DataFrame:
    """One row per span link."""
    return spans.select("trace_id", "span_id", F.posexplode("links").alias("link_index", "k")).select(
        "trace_id",
        "span_id",
        "link_index",
        F.col("k.trace_id").alias("linked_trace_id"),
        F.col("k.span_id").alias("linked_span_id"),
        F.col("k.attributes").alias("attributes"),
    )


def span_tree(spans: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Depth of every span that a root reaches, and its place in its trace with children after their parent.

    Pointer doubling: each round replaces a span's pointer by its target's pointer, so a tree of
    depth d is resolved in log2(d) rounds rather than d, and a row stays as narrow as it began. The same
    rounds add up subtree sizes: what points to a span after k rounds lies 2^k below it and brings the
    spans up to 2^k further down. Siblings are in start order; what stands before a span is the sizes of
    its earlier siblings and, once more by doubling, what stands before its parent. Spans under a missing
    parent find no target and drop out; those on or under a cycle are open after as many rounds as the
    longest trace could need, and drop out too. A round writes the rows that are still open, no others.
    """
    spark, rest = spans.sparkSession, list(dict.fromkeys(["start_ns", *carry]))
    wanted = list(dict.fromkeys(["trace_id", "span_id", "parent_span_id", "start_ns", "end_ns", *carry]))
    # Spans without ids can't be told apart and are in no tree. Rounds go by a number instead of the ids, which are long.
    named = dedup_spans(spans.select(*wanted).filter("trace_id IS NOT NULL AND span_id IS NOT NULL"))
    nodes = checkpoint(
        named.select(
            "trace_id",
            "span_id",
            *rest,
            F.when(~_is_parentless(), F.col("parent_span_id")).alias("_parent"),
            F.monotonically_increasing_id().alias("_node"),
        )
    )
    placed = checkpoint_alone(spark, lambda: _placed_siblings(nodes))
    places = checkpoint_alone(spark, lambda: _positions(placed))
    return nodes.join(places, "_node").select("trace_id", "span_id", "depth", "position", *carry)


def _placed_siblings(nodes: DataFrame) -> DataFrame:
    """_node, _up, depth of the spans that a root reaches, and the sizes of what stands before them under their parent."""
    longest = nodes.groupBy("trace_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    one = F.lit(1).cast("bigint")
    parents = nodes.select("trace_id", F.col("span_id").alias("_parent"), F.col("_node").alias("_up"))
    ups = checkpoint(nodes.select("trace_id", "_parent", "_node").join(parents, ["trace_id", "_parent"]).select("_node", "_up"))
    closed = [nodes.filter("_parent IS NULL").select("_node", F.lit(None).cast("bigint").alias("_up"), F.lit(0).alias("depth"), one.alias("size"))]
    open_rows = ups.select("_node", "_up", F.lit(1).alias("depth"), one.alias("size"))
    additions = []
    for _ in range(longest.bit_length()):
        if open_rows.isEmpty():
            break
        added = open_rows.groupBy(F.col("_up").alias("_node")).agg(F.sum("size").alias("more"))
        additions.append(added)
        targets = _union([open_rows, *closed]).select(
            F.col("_node").alias("_up"), F.col("_up").alias("next"), F.col("depth").alias("further")
        )
        stepped = open_rows.join(targets, "_up").select(
            "_node", F.col("next").alias("_up"), (F.col("depth") + F.col("further")).alias("depth"), "size"
        )
        grown = stepped.join(added, "_node", "left").select(
            "_node", "_up", "depth", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")
        )
        state = checkpoint(grown)
        closed.append(state.filter("_up IS NULL"))
        # What a round adds to rows that were open then is in their size; to others it is added at the end.
        additions[-1] = added.join(open_rows.select("_node"), "_node", "left_anti")
        open_rows = state.filter("_up IS NOT NULL")
    roots = _union(closed).select("_node", "depth", "size")
    if additions:
        late = _union(additions).groupBy("_node").agg(F.sum("more").alias("more"))
        roots = roots.join(late, "_node", "left").select("_node", "depth", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
    # The roots of a trace are siblings: their family is a number of the trace's own, below those of parents.
    tops = nodes.filter("_parent IS NULL")
    traces = checkpoint(tops.groupBy("trace_id").agg((F.lit(-1) - F.min("_node")).alias("_family")))
    top = tops.select("trace_id", "_node").join(traces, "trace_id").select("_node", F.lit(None).cast("bigint").alias("_up"), "_family")
    families = top.unionByName(ups.select("_node", "_up", F.col("_up").alias("_family")))
    family = checkpoint(roots.join(families, "_node").join(nodes.select("_node", "start_ns", "span_id"), "_node"))
    placed = sum_before(family, ["_family"], ["start_ns", "span_id"], "size", "earlier")
    return placed.select("_node", "_up", "depth", "earlier")


def _positions(placed: DataFrame) -> DataFrame:
    """_node, depth and the place in the trace, by what stands before a span's parent, and its parent."""
    position = (F.col("earlier") + 1).alias("position")
    resolved = [placed.filter("_up IS NULL").select("_node", "_up", position)]
    open_rows = placed.filter("_up IS NOT NULL").select("_node", "_up", position)
    while not open_rows.isEmpty():
        targets = _union([open_rows, *resolved]).select(
            F.col("_node").alias("_up"), F.col("_up").alias("next"), F.col("position").alias("above")
        )
        stepped = checkpoint(
            open_rows.join(targets, "_up").select(
                "_node", F.col("next").alias("_up"), (F.col("position") + F.col("above")).alias("position")
            )
        )
        resolved.append(stepped.filter("_up IS NULL"))
        open_rows = stepped.filter("_up IS NOT NULL")
    return placed.select("_node", "depth").join(_union(resolved).select("_node", "position"), "_node")


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def waterfall(spans: DataFrame) -> DataFrame:
    """Per span: depth, offset from the trace start, duration, position in the drawn tree, trace duration,
    and where its bar starts and how wide it is as a share of the trace.

    Children follow their parent in start order. Offsets count from the earliest span of the trace,
    drawn or not; the trace duration covers drawn spans only.
    """

    def share(part: str) -> Column:
        return F.col(part) / F.nullif(F.col("trace_duration_ns"), F.lit(0).cast("bigint"))

    drawn = checkpoint_alone(spans.sparkSession, lambda: span_tree(spans, carry=("name", "service_name", "start_ns", "end_ns")))
    starts = spans.groupBy("trace_id").agg(F.min("start_ns").alias("_start"))
    ends = drawn.groupBy("trace_id").agg(F.max("end_ns").alias("_end"))
    bounds = checkpoint(starts.join(ends, "trace_id"))
    return (
        drawn.join(bounds, "trace_id")
        .select(
            "trace_id",
            "span_id",
            "name",
            "service_name",
            "depth",
            "position",
            (F.col("start_ns") - F.col("_start")).alias("offset_ns"),
            (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"),
            (F.col("_end") - F.col("_start")).alias("trace_duration_ns"),
        )
        .withColumns({"left_fraction": share("offset_ns"), "width_fraction": share("duration_ns")})
    )
