"""Deduplication and daily counts over the event stream (STR6, STR7, STR10)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATENESS = "90 minutes"


def with_watermark(stream: DataFrame, column: str = "event_ts", delay: str = LATENESS) -> DataFrame:
    """Accept rows up to ``delay`` behind the newest event time (STR6)."""
    return stream.withWatermark(column, delay)


def dedup_stream(stream: DataFrame, key: str = "event_uuid", column: str = "event_ts", delay: str = LATENESS) -> DataFrame:
    """First copy of every event; ids are forgotten once the watermark has passed them (STR7)."""
    return with_watermark(stream, column, delay).dropDuplicatesWithinWatermark([key])


def daily_funnel_stream(stream: DataFrame, keys: list[str], types: Mapping[str, str], delay: str = LATENESS) -> DataFrame:
    """Event counts per day and key, one column per event type (STR10, AGG1).

    Counts are combined inside the map tasks before they reach the state of a key.
    """
    counts = [F.count_if(F.col("event_type") == kind).alias(name) for name, kind in types.items()]
    days = with_watermark(stream, delay=delay).groupBy(F.window("event_ts", "1 day").alias("day"), *keys).agg(*counts)
    return days.select(F.to_date("day.start").alias("metric_date"), *keys, *types)
