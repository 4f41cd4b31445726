"""Attributes as typed rows, their key registry, and promotion to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions import values
from heliograph.operators.sides import broadcast_if_small
from heliograph.sources.storage import checkpoint

_VALUE_COLUMNS = {
    "str_value": lambda v: v["string_value"],
    "int_value": lambda v: v["int_value"].try_cast("bigint"),
    "double_value": lambda v: v["double_value"],
    "bool_value": lambda v: v["bool_value"],
    "bytes_value": lambda v: v["bytes_value"],
    "other_value": lambda v: F.coalesce(v["array_value"], v["kvlist_value"]),
}
TYPED = ("string", "int", "double", "bool", "bytes")


def attribute_rows(df: DataFrame, level: str, owner: list[str], column: Column | str = "attributes") -> DataFrame:
    """One typed row per attribute. ``owner`` names the key columns joined into ``owner_id``."""
    attributes = F.col(column) if isinstance(column, str) else column
    return df.select(
        F.lit(level).alias("level"),
        F.concat_ws("/", *[F.col(c).cast("string") for c in owner]).alias("owner_id"),
        F.explode(attributes).alias("key", "v"),
    ).select(
        "level",
        "owner_id",
        "key",
        values.value_type(F.col("v")).alias("value_type"),
        *[read(F.col("v")).alias(name) for name, read in _VALUE_COLUMNS.items()],
    )


def typed_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The rows split by value type, each with its own value column, and the catch-all."""
    column = dict(zip(TYPED, _VALUE_COLUMNS))
    tables = {
        kind: rows.filter(F.col("value_type") == kind).select("level", "owner_id", "key", column[kind])
        for kind in TYPED
    }
    tables["other"] = rows.filter(F.col("value_type") == "other").select("level", "owner_id", "key", "other_value")
    return tables


def unify(tables: dict[str, DataFrame]) -> DataFrame:
    """The typed tables and the catch-all as one view again."""
    whole: DataFrame | None = None
    for kind, table in tables.items():
        part = table.withColumn("value_type", F.lit(kind))
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    return whole.select("level", "owner_id", "key", "value_type", *_VALUE_COLUMNS)


def value_text() -> Column:
    return F.coalesce(*[F.col(c).cast("string") for c in _VALUE_COLUMNS])


def key_registry(rows: DataFrame, indexed: tuple[str, ...] = (), approximate: bool = False) -> DataFrame:
    """Keys with their type, occurrences, distinct values and whether searches index them.

    The exact count first groups by value, which spreads a hot key over its values.
    """
    flag = F.col("key").isin(list(indexed)) if indexed else F.lit(False)
    if approximate:
        counted = rows.groupBy("key", "value_type").agg(
            F.count("*").alias("occurrences"), F.approx_count_distinct(value_text()).alias("distinct_values")
        )
    else:
        by_value = rows.groupBy("key", "value_type", value_text().alias("value")).agg(F.count("*").alias("n"))
        counted = by_value.groupBy("key", "value_type").agg(
            F.sum("n").alias("occurrences"), F.count("value").alias("distinct_values")
        )
    return counted.withColumn("is_indexed", flag)


def with_registry(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Attribute rows with their key's registry entry.

    The registry has a row per key. It is materialised and counted: broadcast while small, so that
    rows of a hot key need no shuffle, joined by shuffle when not.
    """
    return rows.join(broadcast_if_small(checkpoint(registry)), ["key", "value_type"])


# Span attributes that the queries over spans read.
SPAN_KEYS = (
    "http.method",
    "http.request.method",
    "http.status_code",
    "http.response.status_code",
    "http.url",
    "url.full",
    "http.route",
    "http.target",
    "url.path",
    "http.scheme",
    "url.scheme",
    "http.host",
    "net.host.name",
    "net.peer.name",
    "server.address",
    "peer.service",
    "db.system",
    "db.name",
    "messaging.system",
    "messaging.destination",
    "messaging.destination.name",
    "messaging.source.name",
)


def with_key_columns(df: DataFrame, keys: tuple[str, ...] = SPAN_KEYS, column: str = "attributes") -> DataFrame:
    """Repeat well-known keys as text columns next to the map, as ingest does for its tables.

    The map is most of a span's bytes; a query that needs a few keys then need not read it. The map's texts are made
    once for all keys: as an expression of its own per key, each task spent seconds on generating and compiling code.
    """
    texts = df.withColumn("_texts", F.transform_values(column, lambda _, v: values.any_text(v)))
    found = {key: values.attribute_value(df, key, column) if key in df.columns else F.col("_texts")[key] for key in keys}
    return texts.withColumns(found).drop("_texts")


def promote_attribute(df: DataFrame, key: str, data_type: str = "string", column: str = "attributes") -> DataFrame:
    """Move one key out of the map into a typed column named like the key.

    Searches read the column from then on, so their filters reach the Parquet scan.
    """
    promoted = values.any_text(df[column][key]).try_cast(data_type)
    rest = F.map_filter(df[column], lambda k, _: k != key)
    return df.withColumns({key: promoted, column: rest})
