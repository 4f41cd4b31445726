"""Metric catalogue, series, cardinality."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions import clocks, identifiers, values
from heliograph.operators import filters as flt
from heliograph.operators import paging
from heliograph.operators.positions import number_rows
from heliograph.operators.sides import bounded

MAX_METRIC_NAMES = 1000
HIGH_SERIES, HIGH_LABELS = 100, 5
WARN_AT, ALARM_AT = 70.0, 90.0

NEWEST_POINT = [("time_ns", True), ("metric_name", False), ("service_name", False), ("series_key", False)]


def series_key(merge_services: bool = False) -> Column:
    """Identity of a series: its attribute set, within its service unless merged."""
    within = [] if merge_services else [F.col("service_name")]
    return identifiers.attributes_hash(F.col("attributes"), *within)


def with_series(metrics: DataFrame, merge_services: bool = False) -> DataFrame:
    return metrics.withColumn("series_key", series_key(merge_services))


def search_points(
    metrics: DataFrame,
    time_range: flt.TimeRange | None = None,
    names: Iterable[str] = (),
    filters: Iterable[flt.Filter] = (),
    limit: int = paging.DEFAULT_LIMIT,
    cursor: tuple | None = None,
) -> DataFrame:
    """A page of data points, newest first."""
    matching = flt.apply_filters(flt.metric_names(flt.in_range(metrics, time_range), names), filters)
    return paging.page(with_series(matching), NEWEST_POINT, limit, cursor)


def catalog(
    metrics: DataFrame,
    time_range: flt.TimeRange | None = None,
    names: Iterable[str] = (),
    filters: Iterable[flt.Filter] = (),
) -> DataFrame:
    """Per metric: description of its earliest point, distinct resources, label keys, attribute sets.

    One scan. Points are first reduced on the map side to one row per (metric, resource, attribute
    set); those become one row per distinct thing to count, which spreads a metric that holds a
    third of all points over its series; what is left per metric is then a plain count.
    """
    matching = flt.apply_filters(flt.metric_names(flt.in_range(metrics, time_range), names), filters)
    described = ("metric_type", "unit", "description")
    series = (
        matching.withColumn("_resource", F.when(F.size("resource") > 0, identifiers.attributes_hash(F.col("resource"))))
        .withColumn("_attributes", F.when(F.size("attributes") > 0, identifiers.attributes_hash(F.col("attributes"))))
        .withColumn("_keys", F.map_keys("attributes"))
        .groupBy("metric_name", "_resource", "_attributes", "_keys", *described)
        .agg(F.min("time_ns").alias("first_ns"))
    )

    def thing(kind: str, value: Column) -> Column:
        return F.named_struct(F.lit("kind"), F.lit(kind), F.lit("value"), value)

    things = F.concat(
        F.array(thing("resource", F.col("_resource")), thing("attributes", F.col("_attributes"))),
        F.transform("_keys", lambda key: thing("label", key)),
    )
    first = F.struct("first_ns", *described)
    distinct = (
        series.select("metric_name", first.alias("first"), F.explode(things).alias("t"))
        .groupBy("metric_name", "t.kind", "t.value")
        .agg(F.min("first").alias("first"))
    )

    def counted(kind: str, name: str) -> Column:
        return F.count(F.when(F.col("kind") == kind, F.col("value"))).alias(name)

    counts = distinct.groupBy("metric_name").agg(
        F.min("first").alias("first"),
        counted("resource", "resource_count"),
        counted("label", "label_count"),
        counted("attributes", "attribute_combinations"),
    )
    return counts.select(
        "metric_name",
        "first.metric_type",
        "first.unit",
        "first.description",
        "resource_count",
        "label_count",
        "attribute_combinations",
    )


def catalog_page(
    metrics: DataFrame,
    time_range: flt.TimeRange | None = None,
    names: Iterable[str] = (),
    filters: Iterable[flt.Filter] = (),
    limit: int = paging.DEFAULT_LIMIT,
    cursor: tuple | None = None,
) -> DataFrame:
    """A page of the catalogue by name, with ``has_more``."""
    return paging.page(catalog(metrics, time_range, names, filters), [("metric_name", False)], limit, cursor, wide=False)


def detail(
    metrics: DataFrame,
    metric_name: str | None,
    time_range: flt.TimeRange | None = None,
    merge_services: bool = False,
) -> DataFrame:
    """Points of a metric (all metrics when None) by series and time; the range is closed."""
    chosen = metrics if metric_name is None else metrics.filter(F.col("metric_name") == metric_name)
    chosen = flt.in_range(chosen.filter(F.col("service_name").isNotNull()), time_range, closed=True)
    return (
        with_series(chosen, merge_services)
        .select(
            "metric_name",
            "series_key",
            values.series_label(F.col("attributes"), F.col("service_name")).alias("label"),
            "service_name",
            "time_ns",
            "value",
        )
        .orderBy("metric_name", "series_key", "time_ns")
    )


def series_documents(
    metrics: DataFrame,
    metric_name: str | None,
    time_range: flt.TimeRange | None = None,
    merge_services: bool = False,
    part_size: int = 1000,
) -> DataFrame:
    """Series of a metric (all metrics when None) as nested records of at most ``part_size`` points in time order."""
    named = metrics if metric_name is None else metrics.filter(F.col("metric_name") == metric_name)
    chosen = named.filter(F.col("service_name").isNotNull())
    keyed = with_series(flt.in_range(chosen, time_range, closed=True), merge_services).select(
        "metric_name",
        "series_key",
        values.series_label(F.col("attributes"), F.col("service_name")).alias("label"),
        F.to_json(identifiers.canonical_entries(F.col("attributes"))).alias("attributes"),
        F.to_json(identifiers.canonical_entries(F.col("resource"))).alias("resource"),
        "time_ns",
        "value",
    )
    numbered = number_rows(keyed, ["metric_name", "series_key"], ["time_ns", "value", "resource"], "position")
    part = clocks.whole_div(F.col("position") - 1, part_size).alias("part")
    points = F.array_sort(F.collect_list(F.struct("time_ns", "value"))).alias("datapoints")
    first = F.min_by("resource", F.struct("time_ns", "value", "resource")).alias("resource")
    return numbered.groupBy("metric_name", "series_key", "label", "attributes", part).agg(first, points)


def attribute_sets(metrics: DataFrame, metric_name: str | None = None) -> DataFrame:
    """Distinct attribute sets of a metric, whatever their time."""
    chosen = metrics if metric_name is None else metrics.filter(F.col("metric_name") == metric_name)
    return chosen.select(
        "metric_name", values.series_label(F.col("attributes"), F.lit("")).alias("attribute_set")
    ).distinct()


def label_values(metrics: DataFrame) -> DataFrame:
    """Points per (metric, label, value): the base of the label analysis."""
    texts = F.transform_values("attributes", lambda _, v: values.any_text(v))
    return (
        metrics.select("metric_name", F.explode(texts).alias("label", "label_value"))
        .groupBy("metric_name", "label", "label_value")
        .agg(F.count("*").alias("point_count"))
    )


def top_label_values(metrics: DataFrame, k: int = 5) -> DataFrame:
    """Most common values of each label; the rank limit also prunes before the shuffle."""
    order = Window.partitionBy("metric_name", "label").orderBy(F.desc("point_count"), "label_value")
    return (
        label_values(metrics)
        .withColumn("value_rank", F.row_number().over(order))
        .filter(F.col("value_rank") <= k)
    )


def label_cardinality(metrics: DataFrame, k: int = 5) -> DataFrame:
    """Per metric and label: points, distinct values, and the top ``k`` values joined with commas.

    Both sides use all of the counted values, so Spark scans and counts once and reuses the shuffle.
    """
    counts = label_values(metrics).groupBy("metric_name", "label").agg(
        F.sum("point_count").alias("point_count"), F.count("label_value").alias("distinct_values")
    )
    ranked = F.array_sort(F.collect_list(F.struct("value_rank", "label_value")))
    top = (
        top_label_values(metrics, k)
        .groupBy("metric_name", "label")
        .agg(F.array_join(F.transform(ranked, lambda v: v["label_value"]), ",").alias("top_values"))
    )
    return counts.join(top, ["metric_name", "label"])


def active_series(metrics: DataFrame, now: str | int, minutes: float = 60) -> DataFrame:
    """Series ever seen, and series seen in the last hour, per metric."""
    since = clocks.parse_bound(now) - int(minutes * 60 * clocks.NANOS_PER_SECOND)
    last_seen = with_series(metrics).groupBy("metric_name", "series_key").agg(F.max("time_ns").alias("last_ns"))
    return last_seen.groupBy("metric_name").agg(
        F.count("*").alias("total_series"), F.count(F.when(F.col("last_ns") > since, 1)).alias("active_series")
    )


def cardinality_analysis(metrics: DataFrame) -> DataFrame:
    """Series and labels per metric, and whether they are many; most series first.

    Series are reduced to (metric, label set) counts, which both halves read in full and so share.
    """
    keys = F.array_sort(F.map_keys("attributes")).alias("keys")
    series = with_series(metrics).select("metric_name", "series_key", keys).distinct()
    sets = series.groupBy("metric_name", "keys").agg(F.count("*").alias("n"))
    counts = sets.groupBy("metric_name").agg(
        F.sum("n").alias("series_count"), F.max(F.size("keys")).alias("widest_label_set")
    )
    labels = (
        sets.select("metric_name", "n", F.explode_outer("keys").alias("key"))
        .groupBy("metric_name", "key")
        .agg(F.sum("n").alias("labelled_series"))
        .groupBy("metric_name")
        .agg(
            F.count("key").alias("label_count"),
            F.coalesce(F.max(F.when(F.col("key").isNotNull(), F.col("labelled_series"))), F.lit(0)).alias("most_labelled"),
            F.array_join(F.array_sort(F.collect_list("key")), ",").alias("labels"),
        )
    )
    # Metrics without labels have a NULL key above, so the inner join keeps them.
    labelled = counts.join(labels, "metric_name")
    high = (F.col("series_count") > HIGH_SERIES) | (F.col("label_count") > HIGH_LABELS)
    return labelled.withColumn("is_high_cardinality", high).orderBy(F.desc("series_count"), "metric_name")


def first_seen_names(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("metric_name").agg(F.min("time_ns").alias("first_ns"), F.count("*").alias("point_count"))


def admitted_names(metrics: DataFrame, limit: int = MAX_METRIC_NAMES) -> DataFrame:
    """The metric names seen first, at most ``limit`` of them."""
    return first_seen_names(metrics).orderBy("first_ns", "metric_name").limit(limit).select("metric_name")


def guard_cardinality(metrics: DataFrame, limit: int = MAX_METRIC_NAMES) -> DataFrame:
    """Points of admitted names, of which there are at most ``limit``."""
    return metrics.join(bounded(admitted_names(metrics, limit), limit), "metric_name", "left_semi")


def usage_level(names: Column, limit: int = MAX_METRIC_NAMES) -> Column:
    percent = names * 100.0 / limit
    return F.when(percent > ALARM_AT, "red").when(percent > WARN_AT, "yellow").otherwise("ok")


def guard_report(metrics: DataFrame, limit: int = MAX_METRIC_NAMES) -> DataFrame:
    """Names and points kept and dropped by the guard, and how full it is."""
    names = first_seen_names(metrics)
    kept = names.orderBy("first_ns", "metric_name").limit(limit).select("metric_name", F.lit(1).alias("kept"))
    flagged = names.join(bounded(kept, limit), "metric_name", "left").withColumn("is_kept", F.col("kept").isNotNull())
    totals = flagged.agg(
        F.count(F.when(F.col("is_kept"), 1)).alias("kept_names"),
        F.count(F.when(~F.col("is_kept"), 1)).alias("dropped_names"),
        F.coalesce(F.sum(F.when(F.col("is_kept"), F.col("point_count"))), F.lit(0)).alias("kept_points"),
        F.coalesce(F.sum(F.when(~F.col("is_kept"), F.col("point_count"))), F.lit(0)).alias("dropped_points"),
    )
    return totals.withColumn("usage_level", usage_level(F.col("kept_names"), limit))


def latest_and_domain(metrics: DataFrame) -> DataFrame:
    """Latest value per metric, and the chart range: min and max padded by a tenth, never below 0."""
    bounds = metrics.groupBy("metric_name").agg(
        F.max_by("value", F.struct("time_ns", "value")).alias("latest_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )
    padding = (F.col("max_value") - F.col("min_value")) * 0.1
    bounds = bounds.withColumn("_padding", F.when(padding == 0, 1.0).otherwise(padding))
    return bounds.select(
        "metric_name",
        "latest_value",
        "min_value",
        "max_value",
        F.round(F.greatest(F.lit(0.0), F.col("min_value") - F.col("_padding")), 6).alias("domain_low"),
        F.round(F.col("max_value") + F.col("_padding"), 6).alias("domain_high"),
    )


def series_selectors(metrics: DataFrame) -> DataFrame:
    """Each series as ``{key="value", …}``; backslashes, quotes and line breaks in a value are escaped."""

    def escaped(value):
        for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
            value = F.replace(value, F.lit(plain), F.lit(written))
        return value

    parts = F.transform(
        values.canonical_text_entries(F.col("attributes")),
        lambda e: F.concat(e["key"], F.lit('="'), escaped(F.coalesce(e["value"], F.lit(""))), F.lit('"')),
    )
    selector = F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))
    return metrics.select("metric_name", selector.alias("selector")).distinct()
