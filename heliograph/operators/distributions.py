"""Histogram, exponential histogram and summary points as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_POINT = ["metric_name", "service_name", "time_ns"]


def histogram_buckets(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per bucket: upper bound (infinite for the last), count, running count.

    The running count is folded inside each point's own array, so nothing is shuffled.
    """
    start = F.struct(F.array().cast("array<bigint>").alias("sums"), F.lit(0).cast("bigint").alias("total"))

    def add(so_far: Column, n: Column) -> Column:
        total = so_far["total"] + n
        return F.struct(F.array_append(so_far["sums"], total).alias("sums"), total.alias("total"))

    running = F.aggregate("bucket_counts", start, add, lambda folded: folded["sums"])
    zipped = F.arrays_zip(
        F.col("bucket_counts").alias("n"), F.col("explicit_bounds").alias("le"), running.alias("c")
    )
    return (
        points.filter(F.size("bucket_counts") > 0)
        .select(*(keys or _POINT), F.posexplode(zipped).alias("bucket_index", "b"))
        .select(
            *(keys or _POINT),
            "bucket_index",
            F.coalesce(F.col("b")["le"], F.lit(float("inf"))).alias("le"),
            F.col("b")["n"].alias("bucket_count"),
            F.col("b")["c"].alias("cumulative_count"),
        )
    )


def _exponential_side(counts: str, offset: str, sign: int) -> Column:
    """Bounds of one side: bucket i spans (base^(offset+i), base^(offset+i+1)], base = 2^(2^-scale)."""

    def bucket(n: Column, i: Column) -> Column:
        low, high = (
            F.pow(F.lit(2.0), F.pow(F.lit(2.0), -F.col("scale")) * (F.col(offset) + i + step)) for step in (0, 1)
        )
        return F.struct(
            ((low if sign > 0 else -high)).alias("lower"),
            ((high if sign > 0 else -low)).alias("upper"),
            n.alias("n"),
        )

    empty = F.array().cast("array<struct<lower:double,upper:double,n:bigint>>")
    return F.coalesce(F.transform(counts, bucket), empty)


def exponential_buckets(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per explicit bucket of an exponential histogram: negative, zero, positive."""
    zero = F.array(
        F.struct(F.lit(0.0).alias("lower"), F.lit(0.0).alias("upper"), F.coalesce("zero_count", F.lit(0).cast("bigint")).alias("n"))
    )
    buckets = F.concat(
        _exponential_side("negative_counts", "negative_offset", -1),
        zero,
        _exponential_side("positive_counts", "positive_offset", 1),
    )
    return (
        points.filter(F.col("scale").isNotNull())
        .select(*(keys or _POINT), F.explode(buckets).alias("b"))
        .select(*(keys or _POINT), "b.lower", "b.upper", F.col("b.n").alias("bucket_count"))
    )


def summary_quantiles(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per quantile of a summary point."""
    return points.select(*(keys or _POINT), F.explode("quantile_values").alias("q")).select(
        *(keys or _POINT), "q.quantile", F.col("q.value").alias("quantile_value")
    )
