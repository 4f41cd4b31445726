"""Numbering rows inside a group, whatever the size of the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.sources.storage import checkpoint

# monotonically_increasing_id: partition number above 33 bits of row number.
_ROW_BITS = 33


# A group of at most so many rows is put in order by one task.
USUAL = 100_000


def number_rows(df: DataFrame, group: list[str], order: list[str | Column], name: str) -> DataFrame:
    """Add the 1-based position of each row in its group; rows whose group is null in part drop out.

    Groups of at most ``USUAL`` rows are dealt out whole and numbered by a window, so what follows by the same group
    needs no shuffle. Of huge ones that would sort a whole group in one task: their rows are range partitioned on
    (group, order), so a group holding a third of the table is sorted by a third of the tasks; what is windowed
    afterwards is one row per (group, partition). The order must be total.
    """
    usual, huge = _by_size(df, group)
    position = F.row_number().over(Window.partitionBy(*group).orderBy(*_keys(order))).cast("bigint")
    numbered = usual.withColumn(name, position)
    if huge is None:
        return numbered
    placed, runs = _placed(huge, group, order, F.lit(1).cast("bigint"))
    return numbered.unionByName(
        placed.join(runs, [*group, "_part"])
        .withColumn(name, (F.col("_before") + F.col("_id") - F.col("_first") + 1))
        .drop("_id", "_part", "_first", "_before", "_value")
    )


def sum_before(df: DataFrame, group: list[str], order: list[str | Column], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows before each row in its group, in the same way.

    Inside a partition the sum runs over that partition's part of a group only.
    """
    usual, huge = _by_size(df, group)
    earlier = Window.partitionBy(*group).orderBy(*_keys(order)).rowsBetween(Window.unboundedPreceding, -1)
    summed = usual.withColumn(name, F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    if huge is None:
        return summed
    placed, runs = _placed(huge, group, order, F.col(value))
    inside = Window.partitionBy(*group, "_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    return summed.unionByName(
        placed.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(runs, [*group, "_part"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_id", "_part", "_first", "_before", "_inside", "_value")
    )


def _keys(order: list[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _by_size(df: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of usual groups and those of huge ones, if there are any; there are few huge groups, as each has many rows."""
    df = df.dropna(subset=group)
    huge = checkpoint(df.groupBy(*group).agg(F.count("*").alias("_n")).filter(F.col("_n") > USUAL).select(*group))
    if huge.isEmpty():
        return df, None
    few = F.broadcast(huge)
    return df.join(few, group, "left_anti"), df.join(few, group, "left_semi").select(*df.columns)


def _placed(df: DataFrame, group: list[str], order: list[str | Column], value: Column) -> tuple[DataFrame, DataFrame]:
    """Rows sorted over range partitions, and per (group, partition) what the partitions before it hold.

    The sorted rows are checkpointed, because both uses must see the same partitions.
    """
    keys = _keys(order)
    placed = checkpoint(
        df.withColumn("_value", value)
        .repartitionByRange(*group, *keys)
        .sortWithinPartitions(*group, *keys)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("_part", F.shiftright("_id", _ROW_BITS))
    runs = placed.groupBy(*group, "_part").agg(F.min("_id").alias("_first"), F.sum("_value").alias("_held"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *group, "_part", "_first", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before")
    )
    return placed, runs
