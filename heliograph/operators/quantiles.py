"""Exact percentiles of an integer column for groups of any size."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions.clocks import whole_div
from heliograph.functions.values import all_of, any_of
from heliograph.operators.sides import broadcast_if_small
from heliograph.sources.storage import checkpoint

# Buckets per doubling of the value: each is about 2 % wide.
_STEPS = 32
# Distinct values of one range that may be put in order by one task; a range with more is divided.
FEW = 50_000
PARTS = 4096

BUCKET, COUNT, LEAST, MOST = "_bucket", "_n", "_lo", "_hi"
_AT = "_at"  # a range's bucket

Summary = dict[str, tuple[Column, Column]]


def magnitude_bucket(value: Column) -> Column:
    """Log-scale bucket that never decreases as the value grows; a few thousand cover a BIGINT."""
    steps = F.floor(F.log2(F.abs(value).cast("double")) * _STEPS) + 1
    return F.when(value > 0, steps).when(value < 0, -steps).otherwise(F.lit(0)).cast("int")


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    quantiles: dict[str, float],
    summary: Summary | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Linearly interpolated percentiles per group, one column per entry of ``quantiles``.

    The built-in ``percentile`` gathers every distinct value of a group in one task. Here a first pass counts rows
    per (group, magnitude bucket), which combines on the map side to a few thousand rows per group and tells which
    buckets hold the wanted ranks. :func:`select_ranks` then finds the ranks in those alone.

    ``summary`` adds aggregates taken in the first pass, each as (aggregate of the rows, aggregate
    of the partial results). ``weight`` names a column of repeat counts for data already grouped
    by value. Rows without a value count for the summary only. Group keys may be NULL.
    """
    # Read three times below, and only thousands of rows per group: keep it instead of rescanning.
    histogram = checkpoint(bucket_counts(df, keys, value, summary, weight))
    return select_ranks(histogram, df, keys, value, quantiles, summary, weight)


def bucket_counts(df: DataFrame, keys: list[str], value: str, summary: Summary | None = None, weight: str | None = None) -> DataFrame:
    """Per (group, magnitude bucket) its rows, least and greatest value, and the summary: a sketch of bounded size.

    Sketches of parts of the data add up by :func:`merged_counts`.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return (
        df.withColumn(BUCKET, magnitude_bucket(F.col(value)))
        .groupBy(*keys, BUCKET)
        .agg(
            F.sum(F.when(F.col(value).isNull(), none).otherwise(F.col(weight) if weight else one)).alias(COUNT),
            F.min(F.col(value).cast("bigint")).alias(LEAST),
            F.max(F.col(value).cast("bigint")).alias(MOST),
            *[rows.alias(name) for name, (rows, _) in (summary or {}).items()],
        )
    )


def merged_counts(sketches: DataFrame, keys: list[str], summary: Summary | None = None) -> DataFrame:
    """Several sketches of the same groups as one."""
    return sketches.groupBy(*keys, BUCKET).agg(
        F.sum(COUNT).alias(COUNT),
        F.min(LEAST).alias(LEAST),
        F.max(MOST).alias(MOST),
        *[merge.alias(name) for name, (_, merge) in (summary or {}).items()],
    )


def _holds(quantiles: Iterable[float], total: str, start: str, rows: str) -> Column:
    """Whether the values that begin at a rank include one of the wanted ranks."""
    ends = [end(F.lit(q) * (F.col(total) - 1)) for q in quantiles for end in (F.floor, F.ceil)]
    return any_of([(index >= F.col(start)) & (index < F.col(start) + F.col(rows)) for index in ends])


def _is_wide(few: int) -> Column:
    """Whether a range may hold more distinct values than one task should put in order: neither its rows nor its
    width bound them."""
    return (F.col(COUNT) > few) & (F.col(MOST) - F.col(LEAST) >= few)


def select_ranks(
    histogram: DataFrame,
    df: DataFrame,
    keys: list[str],
    value: str,
    quantiles: dict[str, float],
    summary: Summary | None = None,
    weight: str | None = None,
    few: int | None = None,
) -> DataFrame:
    """The percentiles, from the sketch of all rows and from those rows that lie in the buckets the ranks are in."""
    summary, few = summary or {}, few or FEW
    none = F.lit(0).cast("bigint")
    repeat = F.col(weight) if weight else F.lit(1).cast("bigint")
    group = Window.partitionBy(*keys)
    earlier = group.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    ranked = histogram.withColumn("_before", F.coalesce(F.sum(COUNT).over(earlier), none)).withColumn(
        "_total", F.sum(COUNT).over(group)
    )
    found = ranked.filter(_holds(quantiles.values(), "_total", "_before", COUNT))
    found = found.withColumnRenamed(BUCKET, _AT)
    columns = [_AT, "_before", "_total", COUNT, LEAST, MOST]
    bucketed = df.withColumn(BUCKET, magnitude_bucket(F.col(value))).filter(F.col(value).isNotNull())
    needed = narrowed(checkpoint(_renamed(found, keys, *columns)), bucketed, keys, value, quantiles, repeat, few)
    values = (
        bucketed.join(broadcast_if_small(needed), _in_range(keys, value))
        .groupBy(*keys, BUCKET, LEAST, "_before", "_total", value)
        .agg(F.sum(repeat).alias("_c"))
    )
    inside = Window.partitionBy(*keys, BUCKET, LEAST).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = values.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_c").over(inside), none))

    def rank(q: float) -> Column:
        return F.lit(q) * (F.col("_total") - 1)

    def at(index: Column) -> Column:
        return (index >= F.col("_start")) & (index < F.col("_start") + F.col("_c"))

    def gap(high: str, low: str) -> Column:
        """Their difference, which may be more than a BIGINT holds."""
        exact = F.try_subtract(high, low).cast("double")
        return F.coalesce(exact, F.col(high).cast("double") - F.col(low).cast("double"))

    picks = [
        F.max(F.when(at(end(rank(q))), F.col(value))).alias(f"_{side}{i}")
        for i, q in enumerate(quantiles.values())
        for side, end in (("lo", F.floor), ("hi", F.ceil))
    ]
    ends = placed.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    result = ends.select(
        *keys,
        *[
            (F.col(f"_lo{i}") + gap(f"_hi{i}", f"_lo{i}") * (rank(q) - F.floor(rank(q)))).alias(name)
            for i, (name, q) in enumerate(quantiles.items())
        ],
    )
    if not summary:
        return result
    totals = histogram.groupBy(*keys).agg(*[merge.alias(name) for name, (_, merge) in summary.items()])
    matched = totals.join(_renamed(result, keys, *quantiles), _same(keys), "left")
    return matched.select(*keys, *summary, *quantiles)


def narrowed(
    needed: DataFrame, bucketed: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], repeat: Column, few: int
) -> DataFrame:
    """Ranges that hold the wanted ranks, none with more than ``few`` distinct values.

    Each round divides the ranges that are too wide into ``PARTS``, counts the rows of each part on the map side,
    and goes on with the parts the ranks are in, shrunk to the values found there. A range of a BIGINT is down to
    single values in six rounds; most need one.
    """
    group = [f"_k{i}" for i in range(len(keys))]
    kept = []
    while True:
        wide = needed.filter(_is_wide(few))
        if wide.isEmpty():
            break
        kept.append(needed.filter(~_is_wide(few)))
        step = whole_div(F.col(MOST) - F.col(LEAST), PARTS) + 1
        sides = broadcast_if_small(wide.withColumn("_step", step))
        part = F.call_function("div", F.col(value) - F.col(LEAST), F.col("_step")).cast("int").alias("_part")
        parts = (
            bucketed.join(sides, _in_range(keys, value))
            .groupBy(*group, _AT, F.col(LEAST).alias("_from"), "_before", "_total", part)
            .agg(F.sum(repeat).alias(COUNT), F.min(value).cast("bigint").alias(LEAST), F.max(value).cast("bigint").alias(MOST))
        )
        earlier = Window.partitionBy(*group, _AT, "_from").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        before = F.col("_before") + F.coalesce(F.sum(COUNT).over(earlier), F.lit(0).cast("bigint"))
        ranked = parts.withColumn("_before", before).filter(_holds(quantiles.values(), "_total", "_before", COUNT))
        needed = checkpoint(ranked.select(needed.columns))
    for other in kept:
        needed = needed.unionByName(other)
    return needed


def _renamed(df: DataFrame, keys: list[str], *others: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *others)


def _same(keys: list[str]) -> Column:
    return all_of([F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])


def _in_range(keys: list[str], value: str) -> Column:
    return _same(keys) & (F.col(BUCKET) == F.col(_AT)) & F.col(value).between(F.col(LEAST), F.col(MOST))
