"""Filters and predicates (FLT2-FLT7, FLT10, PRJ3)."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import EVENT_TYPES


def is_event_type(types: Iterable[str] = EVENT_TYPES, column: str = "event_type") -> Column:
    return F.col(column).isin(*types)


def is_non_negative(*columns: str) -> Column:
    return reduce(lambda left, right: left & right, [F.col(name) >= 0 for name in columns])


def is_consistent_line(tolerance: str = "0.01") -> Column:
    """Positive quantity and a line amount that matches quantity times price."""
    gap = F.abs(F.col("line_amount") - F.col("quantity") * F.col("unit_price"))
    return (F.col("quantity") > 0) & (gap <= F.lit(tolerance).cast("decimal(12,2)"))


def is_valid_interval(start: str, end: str) -> Column:
    """Start not after end; an open end is fine."""
    return F.col(end).isNull() | (F.col(start) <= F.col(end))


def valid_event_types(df: DataFrame, types: Iterable[str] = EVENT_TYPES) -> DataFrame:
    """Rows whose event type is allowed (FLT2, FLT9)."""
    return df.filter(is_event_type(types))


def non_negative(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows in which every listed amount is zero or more (FLT3)."""
    return df.filter(is_non_negative(*columns))


def consistent_lines(df: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Order lines that add up (FLT4)."""
    return df.filter(is_consistent_line(tolerance))


def valid_interval(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with an open or ordered interval (FLT5)."""
    return df.filter(is_valid_interval(start, end))


def date_range(df: DataFrame, column: str, start: date | str | None = None, end: date | str | None = None) -> DataFrame:
    """Optional range over a date or timestamp column; the whole end day counts (FLT6).

    Both bounds are plain comparisons with literals, so they reach the scan.
    """
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(str(start)).cast("date"))
    if end is not None:
        df = df.filter(F.col(column) < F.date_add(F.lit(str(end)).cast("date"), 1))
    return df


def not_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows with a value in every listed column (FLT7)."""
    for name in columns:
        df = df.filter(F.col(name).isNotNull())
    return df


def split_on_error(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) by presence of a decode error (FLT10)."""
    return df.filter(F.col(error).isNull()), df.filter(F.col(error).isNotNull())


def with_date(df: DataFrame, timestamp: str, name: str) -> DataFrame:
    """Add the calendar day of a timestamp (PRJ3)."""
    return df.withColumn(name, F.col(timestamp).cast("date"))
