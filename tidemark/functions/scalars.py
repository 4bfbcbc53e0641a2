"""Null-safe arithmetic, money, calendar and parsing expressions (SCA6-SCA16, PRJ10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def money(value: ColumnLike) -> Column:
    """Normalise a money aggregate to ``decimal(18,2)`` (PRJ10)."""
    return as_column(value).cast("decimal(18,2)")


def safe_divide(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """Double ratio; 0.0 where the denominator is null or zero (SCA6)."""
    below = as_column(denominator).cast("double")
    return F.when(below.isNull() | (below == 0), F.lit(0.0)).otherwise(as_column(numerator).cast("double") / below)


def clamped_ratio(part: ColumnLike, whole: ColumnLike) -> Column:
    """``least(part, whole) / whole``, never above one for counts (SCA7)."""
    return safe_divide(F.least(as_column(part), as_column(whole)), whole)


def ctr(clicks: ColumnLike, impressions: ColumnLike) -> Column:
    """Unclamped click-through rate; 0.0 when nothing can be divided (SCA8)."""
    ratio = as_column(clicks).cast("double") / F.nullif(as_column(impressions).cast("double"), F.lit(0.0))
    return F.coalesce(ratio, F.lit(0.0))


def calendar_parts(day: ColumnLike) -> list[Column]:
    """Year, quarter, month, day, ISO week and short day name of a date (SCA9)."""
    d = as_column(day)
    return [
        F.year(d).alias("calendar_year"),
        F.quarter(d).alias("calendar_quarter"),
        F.month(d).alias("calendar_month"),
        F.dayofmonth(d).alias("day_of_month"),
        F.weekofyear(d).alias("week_of_year"),
        F.date_format(d, "E").alias("day_name"),
    ]


def days_between(later: ColumnLike, earlier: ColumnLike) -> Column:
    """Whole days from ``earlier`` to ``later`` (SCA10, SCA11)."""
    return F.datediff(as_column(later), as_column(earlier))


def seconds_before(ts: ColumnLike, seconds: int) -> Column:
    """``ts`` minus a literal number of seconds (SCA13)."""
    return as_column(ts) - F.make_dt_interval(secs=F.lit(seconds))


def parse_iso_date(text: ColumnLike) -> Column:
    """Date from an ISO date or timestamp text; null when it is neither (SCA14)."""
    return parse_iso_timestamp(text).cast("date")


def parse_iso_timestamp(text: ColumnLike) -> Column:
    """Timestamp from ISO text, with ``T``, trailing ``Z`` or date only (SCA14)."""
    return F.try_to_timestamp(as_column(text).cast("string"))


def as_double(value: ColumnLike, default: float = 0.0) -> Column:
    """Lenient number: null, empty or unparsable becomes ``default`` (SCA15)."""
    return F.coalesce(as_column(value).try_cast("double"), F.lit(default))


def as_long(value: ColumnLike, default: int = 0) -> Column:
    """Lenient whole number, fractions cut off (SCA15)."""
    return F.coalesce(as_column(value).try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def clip(value: ColumnLike, low: float, high: float) -> Column:
    """Value limited to ``[low, high]`` (SCA16)."""
    return F.least(F.greatest(as_column(value), F.lit(low)), F.lit(high))


def sigmoid(linear: ColumnLike) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_column(linear)))


def epoch_millis(value: ColumnLike) -> Column:
    """Timestamp from epoch milliseconds (SCA12)."""
    return F.timestamp_millis(as_column(value).cast("bigint"))


def epoch_days(value: ColumnLike) -> Column:
    """Date from days since 1970-01-01 (SCA12)."""
    return F.date_from_unix_date(as_column(value).cast("int"))
