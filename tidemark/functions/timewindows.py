"""Calendar and row windows over (entity, day) tables (WIN3, WIN6-WIN9).

Every calendar frame needs one row per entity and day.  That also bounds a window
partition by the length of the calendar, however active an entity is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.scalars import ColumnLike, as_column


def by_day(keys: str | Sequence[str], day: ColumnLike) -> WindowSpec:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return Window.partitionBy(*keys).orderBy(F.unix_date(as_column(day)))


def trailing_days(keys: str | Sequence[str], day: ColumnLike, days: int) -> WindowSpec:
    """The as-of day and the ``days - 1`` calendar days before it (WIN6)."""
    return by_day(keys, day).rangeBetween(-(days - 1), 0)


def leading_days(keys: str | Sequence[str], day: ColumnLike, days: int) -> WindowSpec:
    """The ``days`` calendar days after the as-of day, which is left out (WIN7)."""
    return by_day(keys, day).rangeBetween(1, days)


def up_to_day(keys: str | Sequence[str], day: ColumnLike) -> WindowSpec:
    """Everything up to and with the as-of day (WIN8, WIN9)."""
    return by_day(keys, day).rangeBetween(Window.unboundedPreceding, 0)


def trailing_rows(keys: str | Sequence[str], order: ColumnLike, rows: int) -> WindowSpec:
    """The current row and the ``rows - 1`` rows before it (WIN3)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return Window.partitionBy(*keys).orderBy(as_column(order)).rowsBetween(-(rows - 1), 0)


def happened(condition: Column, window: WindowSpec) -> Column:
    """1 when the condition holds for some row of the window, else 0 (AGG6)."""
    return F.coalesce(F.max(F.when(condition, 1).otherwise(0)).over(window), F.lit(0)).cast("int")
