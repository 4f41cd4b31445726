"""Choosing the small side of a join by measuring it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def bounded(side: DataFrame, rows: int) -> DataFrame:
    """Mark a side for broadcast when its limit, known beforehand, is small enough and so are its rows."""
    return broadcast_if_small(side, rows) if rows <= BROADCAST_ROWS else side


def _width(field: T.StructField) -> Column:
    """Bytes of a value: of text its length, of nested values that of their text."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return F.lit(16)


def broadcast_if_small(side: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a side for broadcast only when it holds few rows and few bytes; otherwise Spark shuffles it.

    The side should come from something already materialised, so that measuring costs no rescan.
    """
    widths = [_width(field) for field in side.schema.fields]
    total = F.lit(0).cast("bigint")
    for width in widths:
        total = total + width
    rows, size = side.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(total), F.lit(0))).first()
    return F.broadcast(side) if rows <= max_rows and size <= max_bytes else side
