"""Gold: dimensions G01-G06, facts G07-G12, marts G13-G15, semantic tables G16-G18."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.privacy import token
from tidemark.functions.scalars import calendar_parts, clamped_ratio, money, safe_divide
from tidemark.operators.aggregates import union_distinct
from tidemark.operators.filters import not_null
from tidemark.plans.silver import stamp

CHANGE_COLUMNS = ("created_at", "updated_at", "source_last_change_ts", "silver_processed_ts")

# Staging column lists (PRJ4); entries like "old as new" rename.
STAGING = {
    "sales_rep": ("sales_rep_id", "rep_name", "team_name", "region", "manager_name", "status as sales_rep_status"),
    "advertiser": (
        "advertiser_id",
        "advertiser_name",
        "industry",
        "account_tier",
        "region",
        "owner_sales_rep_id",
        "status as advertiser_status",
    ),
    "product": (
        "product_id",
        "sku",
        "product_name",
        "brand",
        "category",
        "subcategory",
        "list_price",
        "cost",
        "active_flag",
    ),
    "campaign": (
        "campaign_id",
        "advertiser_id",
        "campaign_name",
        "campaign_type",
        "objective",
        "budget_amount",
        "start_date",
        "end_date",
        "status as campaign_status",
    ),
    "customer": (
        "first_name_masked",
        "last_name_masked",
        "email_masked",
        "phone_masked",
        "city",
        "state",
        "zip_code_masked",
        "status as customer_status",
    ),
    "order": (
        "order_id",
        "order_date",
        "order_ts",
        "order_status",
        "payment_type",
        "subtotal_amount",
        "discount_amount",
        "tax_amount",
        "total_amount",
    ),
    "sales_activity": (
        "sales_activity_id",
        "activity_date",
        "activity_ts",
        "advertiser_id",
        "sales_rep_id",
        "activity_type",
        "activity_outcome",
    ),
    "event": (
        "event_uuid",
        "event_date",
        "event_ts",
        "session_id",
        "product_id",
        "campaign_id",
        "event_type",
        "page_type",
        "search_term",
        "position_in_list",
        "producer_version",
        "schema_version",
        "ingest_ts",
    ),
}


def stage(df: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """Pass-through projection from a column list (PRJ4)."""
    return df.selectExpr(*columns)


def _dimension(current: DataFrame, name: str, loaded_at: datetime | None) -> DataFrame:
    return stamp(stage(current, [*STAGING[name], *CHANGE_COLUMNS]), "loaded_at", loaded_at)


def dim_sales_rep(current: DataFrame, loaded_at: datetime | None = None) -> DataFrame:
    """G04."""
    return _dimension(current, "sales_rep", loaded_at)


def dim_advertiser(current: DataFrame, loaded_at: datetime | None = None) -> DataFrame:
    """G03."""
    return _dimension(current, "advertiser", loaded_at)


def dim_product(current: DataFrame, loaded_at: datetime | None = None) -> DataFrame:
    """G02."""
    return _dimension(current, "product", loaded_at)


def dim_campaign(current: DataFrame, loaded_at: datetime | None = None) -> DataFrame:
    """G05."""
    return _dimension(current, "campaign", loaded_at)


def customer_keys(current: DataFrame, sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Every customer seen anywhere (SET1)."""
    key = ["customer_id"]
    return union_distinct([current.select(*key), not_null(sessions, key).select(*key), not_null(events, key).select(*key)])


def dim_customer(
    current: DataFrame, sessions: DataFrame, events: DataFrame, loaded_at: datetime | None = None
) -> DataFrame:
    """Tokens and masked attributes; customers without a current row keep nulls (JOI14)."""
    joined = customer_keys(current, sessions, events).join(current, "customer_id", "left")
    columns = stage(joined.withColumn("customer_token", token("customer_id")), ["customer_token", *STAGING["customer"], *CHANGE_COLUMNS])
    return stamp(columns, "loaded_at", loaded_at)


def dim_date(days: list[tuple[DataFrame, str]], loaded_at: datetime | None = None) -> DataFrame:
    """Calendar over the days of the given (frame, date column) inputs (SET2, SCA9)."""
    frames = [frame.select(F.col(column).cast("date").alias("date_day")) for frame, column in days]
    distinct = not_null(union_distinct(frames), ["date_day"])
    return stamp(distinct.select("date_day", *calendar_parts("date_day")), "loaded_at", loaded_at)


def fct_session_events(events: DataFrame, sessions: DataFrame, loaded_at: datetime | None = None) -> DataFrame:
    """Events with their session's device and channel (JOI15)."""
    about = sessions.select("session_id", "device_type", "channel", "referrer_type")
    joined = events.join(about, "session_id", "left").withColumn("customer_token", token("customer_id"))
    columns = [*STAGING["event"], "customer_token", "device_type", "channel", "referrer_type", "silver_processed_ts"]
    return stamp(stage(joined, columns), "loaded_at", loaded_at)


def fct_orders(orders: DataFrame, loaded_at: datetime | None = None) -> DataFrame:
    """G08."""
    shaped = orders.withColumns({"order_date": F.to_date("order_ts"), "customer_token": token("customer_id")})
    return stamp(stage(shaped, ["customer_token", *STAGING["order"], *CHANGE_COLUMNS]), "loaded_at", loaded_at)


def fct_order_items(items: DataFrame, orders: DataFrame, loaded_at: datetime | None = None) -> DataFrame:
    """Order lines with their order's customer and day (JOI3)."""
    header = orders.select(
        "order_id",
        F.to_date("order_ts").alias("order_date"),
        "order_ts",
        token("customer_id").alias("customer_token"),
        "order_status",
        "payment_type",
    )
    joined = items.join(header, "order_id").select(
        "order_item_id",
        "order_id",
        "order_date",
        "order_ts",
        "customer_token",
        "product_id",
        F.col("attributed_campaign_id").alias("campaign_id"),
        "quantity",
        "unit_price",
        "line_amount",
        "order_status",
        "payment_type",
        *CHANGE_COLUMNS,
    )
    return stamp(joined, "loaded_at", loaded_at)


def fct_sales_activity(activities: DataFrame, loaded_at: datetime | None = None) -> DataFrame:
    """G10."""
    shaped = activities.withColumn("activity_date", F.to_date("activity_ts"))
    return stamp(stage(shaped, [*STAGING["sales_activity"], *CHANGE_COLUMNS]), "loaded_at", loaded_at)


def fct_campaign_daily(campaign_days: DataFrame, loaded_at: datetime | None = None) -> DataFrame:
    """G11."""
    return stamp(campaign_days, "loaded_at", loaded_at)


def fct_advertiser_daily(advertiser_days: DataFrame, loaded_at: datetime | None = None) -> DataFrame:
    """Only days with a known advertiser (FLT7)."""
    return stamp(not_null(advertiser_days, ["advertiser_id"]), "loaded_at", loaded_at)


def mart_campaign_performance(fact: DataFrame, campaigns: DataFrame, loaded_at: datetime | None = None) -> DataFrame:
    """G13."""
    about = campaigns.select("campaign_id", "budget_amount", "campaign_status")
    columns = fact.join(about, "campaign_id", "left").select(
        "metric_date",
        "campaign_id",
        "advertiser_id",
        "impressions",
        "clicks",
        clamped_ratio("clicks", "impressions").alias("ctr"),
        "attributed_orders",
        money("attributed_revenue").alias("attributed_revenue"),
        "sales_contacts",
        "budget_amount",
        "campaign_status",
    )
    return stamp(columns, "loaded_at", loaded_at)


def mart_advertiser_engagement(
    fact: DataFrame, advertisers: DataFrame, sales_reps: DataFrame, loaded_at: datetime | None = None
) -> DataFrame:
    """Advertiser days with advertiser and owner attributes (JOI11)."""
    about = advertisers.select(
        "advertiser_id", "advertiser_name", "industry", "account_tier", "region", "owner_sales_rep_id"
    )
    owner = sales_reps.select(F.col("sales_rep_id").alias("owner_sales_rep_id"), F.col("rep_name").alias("owner_sales_rep_name"))
    columns = (
        fact.join(about, "advertiser_id", "left")
        .join(owner, "owner_sales_rep_id", "left")
        .select(
            "metric_date",
            "advertiser_id",
            "advertiser_name",
            "industry",
            "account_tier",
            "region",
            "owner_sales_rep_id",
            "owner_sales_rep_name",
            "active_campaigns",
            "sales_contacts",
            "impressions",
            "clicks",
            clamped_ratio("clicks", "impressions").alias("ctr"),
            "attributed_orders",
            money("attributed_revenue").alias("attributed_revenue"),
            safe_divide("attributed_revenue", "sales_contacts").alias("revenue_per_sales_contact"),
        )
    )
    return stamp(columns, "loaded_at", loaded_at)


def mart_customer_conversion(
    customer_days: DataFrame, customers: DataFrame, loaded_at: datetime | None = None
) -> DataFrame:
    """Funnel and rates per (day, customer token) (JOI12)."""
    about = customers.select("customer_token", "customer_status", "city", "state")
    tokens = customer_days.withColumn("customer_token", token("customer_id"))
    columns = tokens.join(about, "customer_token", "left").select(
        "metric_date",
        "customer_token",
        "customer_status",
        "city",
        "state",
        "views",
        "ad_clicks",
        "add_to_cart",
        "checkout_starts",
        "purchases",
        money("order_amount").alias("order_amount"),
        F.col("avg_order_value").cast("double").alias("avg_order_value"),
        safe_divide("purchases", "views").alias("view_to_purchase_rate"),
        safe_divide("purchases", "ad_clicks").alias("click_to_purchase_rate"),
        safe_divide("purchases", "add_to_cart").alias("cart_to_purchase_rate"),
    )
    return stamp(columns, "loaded_at", loaded_at)


# Columns of the semantic tables (PRJ9).
SEMANTIC = {
    "campaign_performance": (
        "metric_date as report_date",
        "campaign_id",
        "advertiser_id",
        "impressions",
        "clicks",
        "ctr as click_through_rate",
        "attributed_orders",
        "attributed_revenue",
        "sales_contacts",
        "budget_amount",
        "campaign_status",
    ),
    "advertiser_engagement": (
        "metric_date as report_date",
        "advertiser_id",
        "advertiser_name",
        "industry",
        "account_tier",
        "region",
        "owner_sales_rep_name",
        "active_campaigns",
        "sales_contacts",
        "impressions",
        "clicks",
        "ctr as click_through_rate",
        "attributed_orders",
        "attributed_revenue",
        "revenue_per_sales_contact",
    ),
    "customer_conversion": (
        "metric_date as report_date",
        "customer_token",
        "customer_status",
        "city",
        "state",
        "views",
        "ad_clicks",
        "add_to_cart",
        "checkout_starts",
        "purchases",
        "order_amount",
        "avg_order_value",
        "view_to_purchase_rate",
        "click_to_purchase_rate",
        "cart_to_purchase_rate",
    ),
}


def semantic(mart: DataFrame, name: str) -> DataFrame:
    """Business names over a mart."""
    return stage(mart, SEMANTIC[name])
