"""Nested attribute values as VARIANT.

Lists and key-value lists of an AnyValue arrive as text of tagged values. Here they become plain nested values whose
parts have their own type and are addressed by path. Expressions cannot recurse, so ``DEPTH`` levels are unfolded; what
lies deeper keeps its tagged form and can still be addressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 4


def _kind(depth: int) -> str:
    """Type of an AnyValue in both spellings, with lists unfolded ``depth`` times."""
    scalars = "string_value:string,stringValue:string,int_value:string,intValue:string,double_value:double,doubleValue:double,"
    scalars += "bool_value:boolean,boolValue:boolean,bytes_value:string,bytesValue:string,"
    array, pairs = ("string", "string") if depth == 0 else (_array_kind(depth - 1), _pairs_kind(depth - 1))
    return f"struct<{scalars}array_value:{array},arrayValue:{array},kvlist_value:{pairs},kvlistValue:{pairs}>"


def _array_kind(depth: int) -> str:
    return f"struct<values:array<{_kind(depth)}>>"


def _pairs_kind(depth: int) -> str:
    return f"struct<values:array<struct<key:string,value:{_kind(depth)}>>>"


def _quoted(text: Column) -> Column:
    """JSON text of a string."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


def _number(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.rlike("^-?[0-9]"), text).otherwise(_quoted(text))  # NaN and the infinities have no JSON number


def _array(values: Column, depth: int) -> Column:
    plain = F.transform(values, lambda v: _plain(v, depth))
    return F.concat(F.lit("["), F.array_join(plain, ","), F.lit("]"))


def _pairs(values: Column, depth: int) -> Column:
    """An object; of a repeated key the last value stays, as in attribute maps."""
    keys = values["key"]

    def is_last(_: Column, i: Column) -> Column:
        return ~F.array_contains(F.slice(keys, i + F.lit(2), F.size(keys)), F.get(keys, i))

    unique = F.when(F.size(F.array_distinct(keys)) == F.size(keys), values).otherwise(F.filter(values, is_last))
    plain = F.transform(unique, lambda p: F.concat(_quoted(p["key"]), F.lit(":"), _plain(p["value"], depth)))
    return F.concat(F.lit("{"), F.array_join(plain, ","), F.lit("}"))


def _plain(value: Column, depth: int) -> Column:
    def pick(snake: str, camel: str) -> Column:
        return F.coalesce(value[snake], value[camel])

    array, pairs = pick("array_value", "arrayValue"), pick("kvlist_value", "kvlistValue")
    return F.coalesce(
        _quoted(pick("string_value", "stringValue")),
        pick("int_value", "intValue"),
        _number(pick("double_value", "doubleValue")),
        pick("bool_value", "boolValue").cast("string"),
        _quoted(pick("bytes_value", "bytesValue")),
        array if depth == 0 else _array(array["values"], depth - 1),
        pairs if depth == 0 else _pairs(pairs["values"], depth - 1),
        F.lit("null"),
    )


def as_variant(value: Column, depth: int = DEPTH) -> Column:
    """An AnyValue of a fact row as VARIANT; bytes are their base64 text. NULL where it is empty or not well formed."""
    array = F.from_json(value["array_value"], _array_kind(depth - 1))["values"]
    pairs = F.from_json(value["kvlist_value"], _pairs_kind(depth - 1))["values"]
    text = F.coalesce(
        _quoted(value["string_value"]),
        value["int_value"],
        _number(value["double_value"]),
        value["bool_value"].cast("string"),
        _quoted(value["bytes_value"]),
        _array(array, depth - 1),
        _pairs(pairs, depth - 1),
    )
    return F.try_parse_json(text)


def at_path(variant: Column, path: str, kind: str) -> Column:
    """The part of a VARIANT at ``$.key[0].key``, as a type; NULL where it is absent or of another type."""
    return F.try_variant_get(variant, path, kind)


def nested_attribute(df: DataFrame, key: str, path: str, kind: str, column: str = "attributes") -> Column:
    """Part of one attribute. Keys that a row does not have are not unfolded."""
    return F.when(F.map_contains_key(column, key), at_path(as_variant(F.col(column)[key]), path, kind))
