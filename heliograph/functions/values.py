"""Reading OTLP AnyValue unions and attribute maps.

An attribute map is ``MAP<STRING, ANY_VALUE>``; at most one field of the struct is set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY_VALUE = (
    "struct<string_value:string,int_value:string,double_value:double,bool_value:boolean,"
    "array_value:string,kvlist_value:string,bytes_value:string>"
)
ANY_VALUE_FIELDS = [
    "string_value",
    "int_value",
    "double_value",
    "bool_value",
    "array_value",
    "kvlist_value",
    "bytes_value",
]
ATTRIBUTES = f"map<string,{ANY_VALUE}>"


def any_value(
    string: Column | None = None,
    integer: Column | None = None,
    double: Column | None = None,
    boolean: Column | None = None,
) -> Column:
    """Build an ANY_VALUE from one typed column."""

    def field(value: Column | None, kind: str, name: str) -> Column:
        return (F.lit(None) if value is None else value).cast(kind).alias(name)

    return F.struct(
        field(string, "string", "string_value"),
        field(integer, "string", "int_value"),
        field(double, "double", "double_value"),
        field(boolean, "boolean", "bool_value"),
        field(None, "string", "array_value"),
        field(None, "string", "kvlist_value"),
        field(None, "string", "bytes_value"),
    )


def attribute_map(pairs: dict[str, Column]) -> Column:
    """Attribute map of the given values; keys whose value is NULL are left out.

    Made of lists of one entry or none: a higher-order function, as a filter over the map of all keys, has everything
    inside it interpreted row by row.
    """
    none = F.array().cast(f"array<struct<key:string,value:{ANY_VALUE}>>")
    entries = [
        F.when(any_text(value).isNotNull(), F.array(F.struct(F.lit(key).alias("key"), value.cast(ANY_VALUE).alias("value")))).otherwise(none)
        for key, value in pairs.items()
    ]
    return F.map_from_entries(F.flatten(F.array(none, *entries))).cast(ATTRIBUTES)


def any_text(value: Column) -> Column:
    """AnyValue as text, whichever field carries it."""
    return F.coalesce(
        value["string_value"],
        value["int_value"],
        value["double_value"].cast("string"),
        value["bool_value"].cast("string"),
        value["array_value"],
        value["kvlist_value"],
        value["bytes_value"],
    )


def any_number(value: Column) -> Column:
    return F.coalesce(
        value["int_value"].try_cast("double"), value["double_value"], value["string_value"].try_cast("double")
    )


def value_type(value: Column) -> Column:
    """Type tag of an AnyValue."""
    return (
        F.when(value["string_value"].isNotNull(), "string")
        .when(value["int_value"].isNotNull(), "int")
        .when(value["double_value"].isNotNull(), "double")
        .when(value["bool_value"].isNotNull(), "bool")
        .when(value["bytes_value"].isNotNull(), "bytes")
        .otherwise("other")
    )


def body_type(value: Column) -> Column:
    """Log body type name."""
    return (
        F.when(value["string_value"].isNotNull(), "STRING")
        .when(value["int_value"].isNotNull(), "INT")
        .when(value["double_value"].isNotNull(), "DOUBLE")
        .when(value["bool_value"].isNotNull(), "BOOL")
        .when(value["bytes_value"].isNotNull(), "BYTES")
        .when(value["array_value"].isNotNull(), "ARRAY")
        .when(value["kvlist_value"].isNotNull(), "KVLIST")
        .otherwise("EMPTY")
    )


def attribute_value(df: DataFrame, key: str, column: str = "attributes") -> Column:
    """Text of one attribute.

    A key with a column of its own is read there, so that a query reads that column instead of the
    map and filters reach the Parquet scan; other keys come from the map. Most keys are absent from
    most maps, so that is tested first: each field of a missing value would be a lookup otherwise.
    """
    if key in df.columns:
        return F.col(f"`{key}`").cast("string")
    return F.when(F.map_contains_key(column, key), any_text(F.col(column)[key]))


def first_attribute(df: DataFrame, *keys: str, column: str = "attributes") -> Column:
    """First non-empty of several attribute keys."""
    return first_of(*[attribute_value(df, key, column) for key in keys])


def first_number(df: DataFrame, *keys: str, column: str = "attributes") -> Column:
    """First non-zero number among several attribute keys."""
    numbers = [attribute_value(df, key, column).try_cast("double") for key in keys]
    return F.coalesce(*[F.nullif(n, F.lit(0.0)) for n in numbers[:-1]], numbers[-1])


def first_of(*candidates: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def series_label(attributes: Column, service_name: Column) -> Column:
    """``k=v, …`` ordered by key, else the service, else ``default``."""
    parts = F.transform(
        canonical_text_entries(attributes), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))
    )
    return F.when(F.size(attributes) > 0, F.array_join(parts, ", ")).otherwise(
        F.coalesce(service_name, F.lit("default"))
    )


def canonical_text_entries(attributes: Column) -> Column:
    return F.array_sort(F.map_entries(F.transform_values(attributes, lambda _, v: any_text(v))))


def any_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates)


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates)
