"""Trace and span identifiers, and stable hashes of attribute sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_id(raw: Column) -> Column:
    """Lower-case hex id; base64 is decoded, anything else is kept as it came."""
    decoded = F.lower(F.hex(F.try_to_binary(raw, F.lit("base64"))))
    return F.when(raw.rlike("^[0-9a-fA-F]*$"), F.lower(raw)).otherwise(F.coalesce(decoded, raw))


def optional_hex_id(raw: Column) -> Column:
    """Like :func:`hex_id`, with an empty id read as no id."""
    return hex_id(F.nullif(raw, F.lit("")))


def bytes_hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def canonical_entries(attributes: Column) -> Column:
    """Map entries ordered by key, so equal maps look the same whatever their build order."""
    return F.array_sort(F.map_entries(attributes))


def canonical_json(attributes: Column) -> Column:
    return F.to_json(F.map_from_entries(canonical_entries(attributes)))


def attributes_hash(attributes: Column, *within: Column) -> Column:
    """Hash of an attribute set, optionally within the values of further columns."""
    text = F.coalesce(F.to_json(canonical_entries(attributes)), F.lit("[]"))
    return F.sha2(F.concat_ws("|", *[F.coalesce(w, F.lit("")) for w in within], text), 256)
