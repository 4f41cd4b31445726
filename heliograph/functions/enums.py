"""OTLP enumerations: names, numbers and the columns that map between them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the OTLP specification.
SPAN_KINDS = {0: "UNSPECIFIED", 1: "INTERNAL", 2: "SERVER", 3: "CLIENT", 4: "PRODUCER", 5: "CONSUMER"}
STATUS_CODES = {0: "UNSET", 1: "OK", 2: "ERROR"}
SEVERITY_BASES = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
METRIC_TYPES = {1: "GAUGE", 2: "SUM", 3: "HISTOGRAM", 4: "EXPONENTIAL_HISTOGRAM", 5: "SUMMARY"}
TEMPORALITIES = {0: "UNSPECIFIED", 1: "DELTA", 2: "CUMULATIVE"}
BODY_TYPES = {0: "EMPTY", 1: "STRING", 2: "INT", 3: "DOUBLE", 4: "BOOL", 5: "BYTES", 6: "ARRAY", 7: "KVLIST"}

# Four steps per level: TRACE, TRACE2, TRACE3, TRACE4, DEBUG, …
SEVERITIES = {0: "UNSPECIFIED"} | {
    1 + 4 * level + step: base + (str(step + 1) if step else "")
    for level, base in enumerate(SEVERITY_BASES)
    for step in range(4)
}
SEVERITY_RANGES = {base: (1 + 4 * level, 4 + 4 * level) for level, base in enumerate(SEVERITY_BASES)}

KIND_CLIENT, KIND_PRODUCER, KIND_CONSUMER = 3, 4, 5
STATUS_ERROR = 2

ENUM_TABLES = {
    "span_kind": SPAN_KINDS,
    "status_code": STATUS_CODES,
    "severity": SEVERITIES,
    "metric_type": METRIC_TYPES,
    "temporality": TEMPORALITIES,
    "body_type": BODY_TYPES,
}


def enum_table(spark: SparkSession, name: str) -> DataFrame:
    """One of the six enumerations as a table (id, label)."""
    return spark.createDataFrame(sorted(ENUM_TABLES[name].items()), "id int, label string")


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(part) for part in chain.from_iterable(pairs.items())])


def label(code: Column, table: dict[int, str]) -> Column:
    """Name of an enum number; a literal map, so no join is planned."""
    return _lookup(table)[code.cast("int")]


def _number(raw: Column, prefix: str, table: dict[int, str]) -> Column:
    names = {f"{prefix}{name}": number for number, name in table.items()}
    return F.coalesce(raw.try_cast("int"), _lookup(names)[raw], F.lit(0))


def span_kind(raw: Column) -> Column:
    """Number of a span kind given by name or number; unknown or missing is 0."""
    return _number(raw, "SPAN_KIND_", SPAN_KINDS)


def status_code(raw: Column) -> Column:
    return F.when(raw.isNotNull(), _number(raw, "STATUS_CODE_", STATUS_CODES))


def severity_number(raw: Column) -> Column:
    return F.when(raw.isNotNull(), _number(raw, "SEVERITY_NUMBER_", SEVERITIES))


def temporality(raw: Column) -> Column:
    """Name of an aggregation temporality given by full name or number."""
    text = F.regexp_replace(raw, "^AGGREGATION_TEMPORALITY_", "")
    return F.coalesce(label(text.try_cast("int"), TEMPORALITIES), F.nullif(text, F.lit("")))
