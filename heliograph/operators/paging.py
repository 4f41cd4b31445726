"""Pages of a sorted result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions.values import all_of, any_of

MAX_LIMIT = 1000
DEFAULT_LIMIT = 100


def check_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be 1..{MAX_LIMIT}")
    return limit


def _orders(keys: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(name).desc_nulls_last() if desc else F.col(name).asc_nulls_first() for name, desc in keys]


def after(keys: list[tuple[str, bool]], cursor: tuple) -> Column:
    """Rows that sort after the cursor: keyset paging, no offset to count through."""
    steps = []
    for i, (name, desc) in enumerate(keys):
        same = [F.col(k) == cursor[j] for j, (k, _) in enumerate(keys[:i])]
        steps.append(all_of([*same, F.col(name) < cursor[i] if desc else F.col(name) > cursor[i]]))
    return any_of(steps)


def near_page(df: DataFrame, keys: list[tuple[str, bool]], limit: int) -> DataFrame:
    """Rows of a table that may be on its first page, found by the leading key alone.

    A first pass over that one column tells how far the page reaches. The bound is pushed into the
    scan of what follows, which then reads all columns of few row groups. The key must not be NULL.
    """
    lead, descending = keys[0]
    reach = df.select(lead).orderBy(*_orders(keys[:1])).limit(limit + 1)
    bound = reach.agg(F.min(lead) if descending else F.max(lead)).scalar()
    return df.filter(F.col(lead) >= bound if descending else F.col(lead) <= bound)


def page(
    df: DataFrame,
    keys: list[tuple[str, bool]],
    limit: int = DEFAULT_LIMIT,
    cursor: tuple | None = None,
    wide: bool = True,
) -> DataFrame:
    """One page, with ``has_more`` on every row.

    ``keys`` are (column, descending) pairs that order rows totally. ``wide`` is for rows scanned
    from a table, see :func:`near_page`; for narrow, computed rows it would compute them twice. One
    row more than asked for is fetched; only those at most 1001 rows are then numbered.
    """
    check_limit(limit)
    source = df if cursor is None else df.filter(after(keys, cursor))
    if wide:
        source = near_page(source, keys, limit)
    fetched = source.orderBy(*_orders(keys)).limit(limit + 1)
    numbered = fetched.withColumn("_row", F.row_number().over(Window.orderBy(*_orders(keys)))).withColumn(
        "has_more", F.count("*").over(Window.partitionBy()) > limit
    )
    return numbered.filter(F.col("_row") <= limit).drop("_row")
