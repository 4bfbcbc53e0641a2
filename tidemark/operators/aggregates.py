"""Aggregations and set operations (AGG1-AGG13, SET1-SET4, SRT1-SRT3)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import ColumnLike, as_column, money


def funnel_counts(events: DataFrame, keys: Sequence[ColumnLike], types: Mapping[str, str]) -> DataFrame:
    """Events per key, one count column per event type (AGG1).  ``types``: column -> event type."""
    counts = [F.count_if(F.col("event_type") == kind).alias(name) for name, kind in types.items()]
    return events.groupBy(*[as_column(key) for key in keys]).agg(*counts)


def fill_zero(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Nulls of the listed measures become zero (AGG4)."""
    return df.na.fill(0, list(columns))


def duplicates(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count (AGG10, DQ2)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).filter(F.col("row_count") > 1)


def control_totals(df: DataFrame, measures: Mapping[str, Column]) -> DataFrame:
    """One row of totals, zero for an empty input (AGG9)."""
    return df.agg(*[F.coalesce(measure, F.lit(0)).alias(name) for name, measure in measures.items()])


def daily(df: DataFrame, measures: Sequence[str], day: str = "metric_date") -> DataFrame:
    """Sums of additive measures per day (AGG11)."""
    return df.groupBy(day).agg(*[F.sum(name).alias(name) for name in measures])


def wide_to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Measure columns to (name, value) rows in one pass (AGG13, SET3)."""
    return df.unpivot(list(ids), list(columns), name, value)


def as_of_spine(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct as-of rows (AGG7)."""
    return df.select(*keys).distinct()


def union_distinct(frames: Iterable[DataFrame]) -> DataFrame:
    """Set union by column name, in one aggregation over all inputs (SET1, SET2, SET4).

    Each map task of an input makes its rows distinct before the one shuffle, so a key or day
    with very many rows costs one row per task.
    """
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=False), frames).distinct()


def definition_exprs(aggregations: Iterable[Mapping], age_seconds: Column) -> list[Column]:
    """Aggregation columns from a declarative list (AGG8).

    Each entry names ``as``, ``function``, ``window_seconds`` and an optional
    ``event_type``.  ``age_seconds`` is the distance of a row from its anchor.  Rows must
    be unique by ``field`` already, so a distinct count is a plain conditional count.
    """
    columns = []
    for entry in aggregations:
        condition = age_seconds <= entry["window_seconds"]
        if entry.get("event_type"):
            condition = condition & (F.col("event_type") == entry["event_type"])
        if entry["function"] == "count_distinct":
            columns.append(F.count_if(condition & F.col(entry["field"]).isNotNull()).alias(entry["as"]))
        elif entry["function"] in ("sum", "avg", "max"):
            aggregate = getattr(F, entry["function"])
            columns.append(aggregate(F.when(condition, F.col(entry["field"]))).alias(entry["as"]))
        else:
            raise ValueError(f"unknown aggregation function {entry['function']!r}")
    return columns


# The named BI metrics as (function, column) (AGG12).
BI_METRICS = {
    "campaign_performance": {
        "total_impressions": ("sum", "impressions"),
        "total_clicks": ("sum", "clicks"),
        "total_orders": ("sum", "attributed_orders"),
        "total_revenue": ("sum", "attributed_revenue"),
        "avg_ctr": ("avg", "ctr"),
    },
    "advertiser_engagement": {
        "total_revenue": ("sum", "attributed_revenue"),
        "total_sales_contacts": ("sum", "sales_contacts"),
        "total_active_campaigns": ("sum", "active_campaigns"),
        "avg_ctr": ("avg", "ctr"),
        "avg_revenue_per_sales_contact": ("avg", "revenue_per_sales_contact"),
    },
    "customer_conversion": {
        "total_views": ("sum", "views"),
        "total_clicks": ("sum", "ad_clicks"),
        "total_add_to_cart": ("sum", "add_to_cart"),
        "total_checkout_starts": ("sum", "checkout_starts"),
        "total_purchases": ("sum", "purchases"),
        "total_order_amount": ("sum", "order_amount"),
    },
    "funnel_stage_totals": {"stage_total": ("sum", "stage_total")},
    "product_channel_contribution": {
        "total_orders": ("sum", "orders"),
        "total_quantity_sold": ("sum", "quantity_sold"),
        "total_revenue": ("sum", "revenue"),
        "total_product_views": ("sum", "product_views"),
    },
}


def metric_query(
    df: DataFrame,
    dataset: str,
    metrics: Sequence[str],
    dims: Sequence[str] = (),
    time_col: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Named metrics over chosen dimensions at day grain (AGG12, SRT3).

    With a limit the rows are the top ones by the first metric, ties by dimension; a
    time series is ordered by day and keeps its newest rows.  The limit runs as a distributed top-k.
    """
    defined = BI_METRICS[dataset]
    keys = ([F.col(time_col).cast("date").alias(time_col)] if time_col else []) + [F.col(name) for name in dims]
    columns = [getattr(F, defined[name][0])(defined[name][1]).alias(name) for name in metrics]
    grouped = df.groupBy(*keys).agg(*columns)
    ties = [F.col(name).asc_nulls_last() for name in dims]
    if not time_col:
        ordered = grouped.orderBy(F.col(metrics[0]).desc_nulls_last(), *ties)
        return ordered.limit(limit) if limit else ordered
    if limit:  # the newest days stay
        grouped = grouped.orderBy(F.col(time_col).desc_nulls_last(), *ties).limit(limit)
    return grouped.orderBy(F.col(time_col).asc_nulls_last(), *ties)


def top_k(df: DataFrame, metric: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows with the largest metric (SRT3)."""
    return df.orderBy(F.col(metric).desc_nulls_last(), *[F.col(name).asc_nulls_last() for name in ties]).limit(k)


def sum_money(column: str) -> Column:
    return money(F.sum(column))
