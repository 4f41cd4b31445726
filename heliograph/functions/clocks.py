"""Nanosecond clocks.

Spark timestamps carry microseconds, so all arithmetic is on BIGINT nanoseconds since the epoch;
timestamps are derived for display and for partitioning by day.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS_PER_SECOND = 1_000_000_000


def whole_div(value: Column, divisor: int) -> Column:
    return F.call_function("div", value, F.lit(divisor).cast("bigint"))


def to_timestamp(ns: Column) -> Column:
    """Microsecond part of a nanosecond clock."""
    return F.timestamp_micros(whole_div(ns, 1000))


def nanos_fraction(ns: Column) -> Column:
    """The 0–999 nanoseconds a microsecond timestamp cannot hold."""
    return F.pmod(ns, F.lit(1000).cast("bigint")).cast("smallint")


def from_timestamp(ts: Column, fraction: Column | int = 0) -> Column:
    return F.unix_micros(ts) * F.lit(1000).cast("bigint") + (F.lit(fraction) if isinstance(fraction, int) else fraction)


def event_date(ns: Column) -> Column:
    """UTC day of a nanosecond clock, whatever the session time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), whole_div(ns, 86_400 * NANOS_PER_SECOND).cast("int"))


def rfc3339(ns: Column) -> Column:
    """``2026-01-25T17:30:45.123456789Z``."""
    wall = F.expr("timestamp_ntz '1970-01-01 00:00:00'") + F.make_dt_interval(
        secs=whole_div(ns, NANOS_PER_SECOND).cast("decimal(18,6)")
    )
    nanos = F.pmod(ns, F.lit(NANOS_PER_SECOND).cast("bigint")).cast("string")
    # Text of a timestamp without time zone does not depend on the session's zone.
    return F.concat(
        F.replace(wall.cast("string"), F.lit(" "), F.lit("T")), F.lit("."), F.lpad(nanos, 9, "0"), F.lit("Z")
    )


def parse_rfc3339(text: Column) -> Column:
    """RFC3339 text to nanoseconds; the fraction is padded or cut to nine digits."""
    base = F.regexp_extract(text, r"^([^.Zz+]+?)(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?$", 1)
    fraction = F.regexp_extract(text, r"\.(\d+)", 1)
    zone = F.regexp_extract(text, r"([+-]\d\d:\d\d)$", 1)
    seconds = F.unix_seconds(F.try_to_timestamp(F.concat(base, F.when(zone == "", "Z").otherwise(zone))))
    return seconds * F.lit(NANOS_PER_SECOND).cast("bigint") + F.rpad(fraction, 9, "0").try_cast("bigint")


def duration_seconds(start_ns: Column, end_ns: Column) -> Column:
    return (end_ns - start_ns) / F.lit(1e9)


def duration_ms(start_ns: Column, end_ns: Column) -> Column:
    return (end_ns - start_ns) / F.lit(1e6)


def log_time(time_ns: Column, observed_ns: Column, ingest_ns: Column) -> Column:
    """Event time, else observed time, else the time of ingest; zero means missing."""
    zero = F.lit(0).cast("bigint")
    return F.coalesce(F.nullif(time_ns, zero), F.nullif(observed_ns, zero), ingest_ns)


def parse_bound(value: str | int) -> int:
    """A query bound given as RFC3339 text or as nanoseconds."""
    if isinstance(value, int):
        return value
    match = re.fullmatch(r"(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d)(?:\.(\d+))?(?:Z|z|([+-]\d\d:\d\d))?", value)
    if not match:
        raise ValueError(f"not an RFC3339 time: {value!r}")
    base, fraction, zone = match.groups()
    moment = datetime.fromisoformat(base + (zone or "+00:00"))
    whole = (moment - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(seconds=1)
    return whole * NANOS_PER_SECOND + int((fraction or "").ljust(9, "0")[:9])
