"""Folds by the checksum of an id, and bounded samples to fit models on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_fold(id_column: str, folds: int, fold: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; a null id belongs to no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def sample(rows: DataFrame, id_column: str, size: int) -> DataFrame:
    """At most ``size`` rows, the same for the same ids: those with the smallest hash of their id."""
    return rows.orderBy(F.xxhash64(id_column), id_column).limit(size)
