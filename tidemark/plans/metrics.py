"""Daily metrics S12-S15.

Every input is aggregated to its target grain before it is joined, so the joins only see
(day, entity) rows and hot entities are reduced inside the map tasks.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import money
from tidemark.operators.aggregates import fill_zero, funnel_counts, sum_money, union_distinct
from tidemark.operators.filters import not_null
from tidemark.operators.joins import active_intervals
from tidemark.plans.silver import stamp

DAY = "metric_date"

# Measure column -> event type.
CUSTOMER_FUNNEL = {
    "views": "product_view",
    "ad_clicks": "ad_click",
    "add_to_cart": "add_to_cart",
    "checkout_starts": "checkout_start",
}
PRODUCT_FUNNEL = {"product_views": "product_view", "add_to_cart": "add_to_cart"}
CAMPAIGN_FUNNEL = {"impressions": "ad_impression", "clicks": "ad_click"}


def _order_days(orders: DataFrame) -> DataFrame:
    return orders.select("order_id", F.to_date("order_ts").alias(DAY))


def _attributed(items: DataFrame, orders: DataFrame, entity: str, name: str) -> DataFrame:
    """Distinct orders and revenue per (day, entity) of the order lines (JOI3, AGG2, AGG3).

    Lines are reduced to (order, entity) first.  One row per order and entity also makes the
    distinct order count a plain count, without a shuffle of its own.
    """
    lines = not_null(items, ["order_id"]).groupBy("order_id", F.col(entity).alias(name))
    reduced = lines.agg(F.sum("line_amount").alias("amount"))
    return (
        reduced.join(_order_days(orders), "order_id")
        .groupBy(DAY, name)
        .agg(F.count("*").alias("attributed_orders"), sum_money("amount").alias("attributed_revenue"))
    )


def customer_daily(events: DataFrame, orders: DataFrame, processed_at: datetime | None = None) -> DataFrame:
    """Funnel counts and orders per (day, customer) (JOI1).  Orders are unique by id."""
    funnel = funnel_counts(events, [F.col("event_date").alias(DAY), "customer_id"], CUSTOMER_FUNNEL)
    purchases = orders.groupBy(F.to_date("order_ts").alias(DAY), "customer_id").agg(
        F.count("order_id").alias("purchases"),
        sum_money("total_amount").alias("order_amount"),
        (F.sum("total_amount").cast("double") / F.count("total_amount")).alias("avg_order_value"),
    )
    joined = funnel.join(purchases, [DAY, "customer_id"], "full_outer")
    measures = [*CUSTOMER_FUNNEL, "purchases", "order_amount", "avg_order_value"]
    return stamp(fill_zero(joined, measures), "processed_ts", processed_at)


def product_daily(
    events: DataFrame, items: DataFrame, orders: DataFrame, processed_at: datetime | None = None
) -> DataFrame:
    """Views, carts and sales per (day, product) (JOI2)."""
    with_product = not_null(events, ["product_id"])
    funnel = funnel_counts(with_product, [F.col("event_date").alias(DAY), "product_id"], PRODUCT_FUNNEL)
    sales = _attributed(items, orders, "product_id", "product_id")
    joined = funnel.join(sales, [DAY, "product_id"], "full_outer")
    measures = [*PRODUCT_FUNNEL, "attributed_orders", "attributed_revenue"]
    return stamp(fill_zero(joined, measures), "processed_ts", processed_at)


def contacts_by_day(activities: DataFrame) -> DataFrame:
    """Sales activities per (day, advertiser); activities are unique by id."""
    return activities.groupBy(F.to_date("activity_ts").alias(DAY), "advertiser_id").agg(
        F.count("sales_activity_id").alias("sales_contacts")
    )


def campaign_daily(
    events: DataFrame,
    items: DataFrame,
    orders: DataFrame,
    campaigns: DataFrame,
    activities: DataFrame,
    complete: bool = False,
    processed_at: datetime | None = None,
) -> DataFrame:
    """Impressions, clicks, attributed sales, contacts per (day, campaign) (JOI4-JOI6).

    By default the days come from events; ``complete`` also keeps days that only have
    orders or sales contacts.  An advertiser's contacts count for each of its campaigns.
    """
    owners = campaigns.select("campaign_id", "advertiser_id")
    with_campaign = not_null(events, ["campaign_id"])
    funnel = funnel_counts(with_campaign, [F.col("event_date").alias(DAY), "campaign_id"], CAMPAIGN_FUNNEL)
    sales = _attributed(not_null(items, ["attributed_campaign_id"]), orders, "attributed_campaign_id", "campaign_id")
    contacts = contacts_by_day(activities)
    if complete:
        expanded = contacts.join(owners, "advertiser_id").select(DAY, "campaign_id")
        spine = union_distinct([funnel.select(DAY, "campaign_id"), sales.select(DAY, "campaign_id"), expanded])
        funnel = spine.join(funnel, [DAY, "campaign_id"], "left")
    joined = (
        funnel.join(sales, [DAY, "campaign_id"], "left")
        .join(owners, "campaign_id", "left")
        .join(contacts, [DAY, "advertiser_id"], "left")
    )
    measures = [*CAMPAIGN_FUNNEL, "attributed_orders", "attributed_revenue", "sales_contacts"]
    shaped = fill_zero(joined, measures).select(
        DAY,
        "campaign_id",
        "advertiser_id",
        "impressions",
        "clicks",
        "attributed_orders",
        money("attributed_revenue").alias("attributed_revenue"),
        "sales_contacts",
    )
    return stamp(shaped, "processed_ts", processed_at)


def metric_dates(campaign_days: DataFrame, activities: DataFrame) -> DataFrame:
    """Distinct (day, advertiser) of campaign metrics and sales activities (SET4)."""
    active = activities.select(F.to_date("activity_ts").alias(DAY), "advertiser_id")
    return union_distinct([campaign_days.select(DAY, "advertiser_id"), active])


def active_campaigns(days: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Campaigns running on each (day, advertiser); other columns of ``days`` stay (JOI7)."""
    return active_intervals(days, campaigns, "advertiser_id", DAY, "start_date", "end_date", "active_campaigns")


def advertiser_daily(
    campaign_days: DataFrame,
    campaigns: DataFrame,
    activities: DataFrame,
    complete: bool = False,
    processed_at: datetime | None = None,
) -> DataFrame:
    """Campaign metrics rolled up per (day, advertiser), contacts, running campaigns.

    By default the days come from campaign metrics; ``complete`` also keeps days that only
    have sales activity.
    """
    measures = ["impressions", "clicks", "attributed_orders"]
    rows = campaign_days.select(DAY, "advertiser_id", *measures, "attributed_revenue")
    contacts = contacts_by_day(activities)
    if complete:
        rows = rows.unionByName(contacts.select(DAY, "advertiser_id"), allowMissingColumns=True)
    base = rows.groupBy(DAY, "advertiser_id").agg(
        *[F.sum(name).alias(name) for name in measures], sum_money("attributed_revenue").alias("attributed_revenue")
    )
    joined = active_campaigns(base.join(contacts, [DAY, "advertiser_id"], "left"), campaigns)
    filled = fill_zero(joined, [*measures, "attributed_revenue", "sales_contacts", "active_campaigns"])
    return stamp(filled, "processed_ts", processed_at)
