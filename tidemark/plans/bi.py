"""BI queries B1-B13."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.aggregates import daily, metric_query, sum_money, wide_to_long
from tidemark.operators.filters import not_null

FUNNEL_STAGES = ("views", "ad_clicks", "add_to_cart", "checkout_starts", "purchases")
LOOKBACK_DAYS = 14
UNKNOWN_CHANNEL = "unknown"

# The nine charts (AGG12, SRT3).
CHARTS = {
    "campaign_trend": {
        "dataset": "campaign_performance",
        "time_col": "metric_date",
        "metrics": ("total_impressions", "total_clicks", "total_revenue"),
    },
    "campaign_leaderboard": {
        "dataset": "campaign_performance",
        "dims": ("campaign_id", "advertiser_id", "campaign_status"),
        "metrics": ("total_revenue", "total_orders", "avg_ctr"),
        "limit": 20,
    },
    "advertiser_revenue_contacts": {
        "dataset": "advertiser_engagement",
        "time_col": "metric_date",
        "metrics": ("total_revenue", "total_sales_contacts"),
    },
    "advertiser_tier": {
        "dataset": "advertiser_engagement",
        "dims": ("advertiser_name", "account_tier", "owner_sales_rep_name"),
        "metrics": ("total_revenue", "total_sales_contacts", "avg_revenue_per_sales_contact", "avg_ctr"),
        "limit": 25,
    },
    "customer_funnel_stage": {
        "dataset": "funnel_stage_totals",
        "time_col": "metric_date",
        "dims": ("stage_name",),
        "metrics": ("stage_total",),
    },
    "customer_conversion_rates": {
        "dataset": "customer_conversion",
        "dims": ("metric_date", "state"),
        "metrics": (
            "total_views",
            "total_clicks",
            "total_add_to_cart",
            "total_checkout_starts",
            "total_purchases",
            "total_order_amount",
        ),
        "limit": 50,
    },
    "category_revenue": {
        "dataset": "product_channel_contribution",
        "time_col": "metric_date",
        "dims": ("category",),
        "metrics": ("total_revenue",),
    },
    "category_orders": {
        "dataset": "product_channel_contribution",
        "time_col": "metric_date",
        "dims": ("category",),
        "metrics": ("total_orders",),
    },
    "product_channel": {
        "dataset": "product_channel_contribution",
        "dims": ("channel", "category", "product_name"),
        "metrics": ("total_orders", "total_quantity_sold", "total_revenue", "total_product_views"),
        "limit": 25,
    },
}


def chart(df: DataFrame, name: str) -> DataFrame:
    """One chart over its dataset."""
    return metric_query(df, **CHARTS[name])


def campaign_performance_over_time(mart: DataFrame) -> DataFrame:
    """B1."""
    measures = ["impressions", "clicks", "attributed_orders", "attributed_revenue"]
    return daily(mart, measures).orderBy("metric_date")


def advertiser_effectiveness(mart: DataFrame) -> DataFrame:
    """B2."""
    columns = [
        "metric_date",
        "advertiser_name",
        "account_tier",
        "active_campaigns",
        "sales_contacts",
        "attributed_revenue",
        "revenue_per_sales_contact",
    ]
    return mart.select(*columns).orderBy("metric_date", F.col("advertiser_name").asc_nulls_last())


def browse_to_purchase_funnel(mart: DataFrame) -> DataFrame:
    """Daily stage totals, one row per stage."""
    return wide_to_long(daily(mart, FUNNEL_STAGES), ["metric_date"], FUNNEL_STAGES, "stage_name", "stage_total")


def _found() -> Column:
    """An event as a candidate, ordered by time; null without a channel."""
    return F.when(F.col("channel").isNotNull(), F.struct("event_ts", "event_uuid", "channel"))


def _block(days: int) -> Column:
    """Number of the block of days that a day, moved by ``days``, lies in."""
    return F.floor((F.unix_date("metric_date") + days) / (LOOKBACK_DAYS + 1))


def lines_and_events(items: DataFrame, events: DataFrame) -> DataFrame:
    """Order lines and the events that they may see, dealt over the tasks in one shuffle.

    ``dealt`` is a buyer and a block of 15 days: an event goes to the blocks that hold the days that see it,
    two at most, so a buyer with many lines fills as many tasks as the calendar has blocks.  Lines
    without a buyer see nothing and are dealt by order.
    """
    lines = items.withColumn("metric_date", F.col("order_date")).select(
        F.when(F.col("customer_token").isNull(), F.xxhash64("order_id")).otherwise(F.xxhash64("customer_token", _block(0))).alias("dealt"),
        *("customer_token", "product_id", "metric_date", "order_id", "quantity", "line_amount"),
        F.lit(True).alias("is_line"),
    )
    on_product = F.col("product_id").isNotNull()
    seen = not_null(events.withColumn("metric_date", F.col("event_date")), ["customer_token", "metric_date"]).select(
        *("customer_token", "product_id", "metric_date"),
        F.when(on_product, _found()).alias("best"),
        F.when(~on_product, _found()).alias("other"),
        F.when(on_product & (F.col("event_type") == "product_view"), F.lit(1)).alias("view"),
        F.explode(F.sequence(_block(0), _block(LOOKBACK_DAYS))).alias("_block"),
    )
    useful = seen.filter(F.coalesce(F.col("best"), F.col("other")).isNotNull() | F.col("view").isNotNull())
    placed = useful.withColumn("dealt", F.xxhash64("customer_token", "_block")).drop("_block")
    return lines.unionByName(placed, allowMissingColumns=True).repartition("dealt")


def credited_lines(items: DataFrame, events: DataFrame) -> DataFrame:
    """Order lines with the channel credited with their order (JOI9, WIN5).

    A line sees the customer's events of its order day and the 14 days before, on the same
    product or on no product.  Best is an event on the same product, then the latest one;
    the order, which has one buyer and one day, takes the best over its lines and gives it to all of them.
    Every window and aggregation is inside ``dealt``, so the lines are shuffled once; a day's frame holds
    the candidates of earlier days as one running value.
    """
    rows = lines_and_events(items, events)
    product = ["dealt", "customer_token", "product_id"]
    by_day = {name: F.col(name)["day"] for name in ("best", "other")}

    def latest(name: str, *keys: str) -> Column:
        """The latest candidate up to the day of a row, with its own day."""
        candidate = F.when(F.col(name).isNotNull(), F.struct(F.col("metric_date").alias("day"), F.col(name).alias("event")))
        frame = Window.partitionBy(*keys).orderBy("metric_date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return F.max(candidate).over(frame)

    found = rows.withColumns({"views": F.sum("view").over(Window.partitionBy(*product, "metric_date")), "best": latest("best", *product)})
    found = found.withColumn("other", latest("other", *product[:2])).filter("is_line")
    near = {name: day >= F.date_sub("metric_date", LOOKBACK_DAYS) for name, day in by_day.items()}
    nearest = F.when(near["best"], F.struct(F.lit(1).alias("same"), F.col("best")["event"].alias("event"))).when(
        near["other"], F.struct(F.lit(0).alias("same"), F.col("other")["event"].alias("event"))
    )
    # One row per order, buyer, day and product, with the number of lines behind it.
    lines = found.groupBy("dealt", "order_id", "customer_token", "product_id", "metric_date", nearest.alias("nearest"), "views").agg(
        F.sum("quantity").alias("quantity"), sum_money("line_amount").alias("amount"), F.count("*").alias("lines")
    )
    top = F.max("nearest").over(Window.partitionBy("dealt", "order_id"))
    return lines.withColumn("channel", F.coalesce(top["event"]["channel"], F.lit(UNKNOWN_CHANNEL)))


def product_channel_contribution(items: DataFrame, events: DataFrame, products: DataFrame) -> DataFrame:
    """Orders, sales, buyers and product views per (day, channel, product).

    The channel belongs to the order and is used for all of its lines.  Product views are
    those of the buyer on the order day; they count once per matching line.
    """
    lines = credited_lines(items, events)
    # The buyer's level first: an order has one buyer, so orders add up and buyers are counted once.
    keys = ["metric_date", "channel", "product_id"]
    per_buyer = lines.groupBy("dealt", *keys, "customer_token").agg(
        F.count("order_id").alias("orders"),
        F.sum("quantity").alias("quantity"),
        F.sum("amount").alias("amount"),
        F.sum(F.col("views") * F.col("lines")).alias("views"),
    )
    per_product = per_buyer.groupBy(*keys).agg(
        F.sum("orders").alias("orders"),
        F.sum("quantity").alias("quantity_sold"),
        sum_money("amount").alias("revenue"),
        F.count("customer_token").alias("purchasing_customers"),
        F.coalesce(F.sum("views"), F.lit(0)).alias("product_views"),
    )
    # Product attributes join the finished report, not the lines.
    about = products.select("product_id", "category", "product_name")
    return per_product.join(about, "product_id").orderBy("metric_date", F.col("revenue").desc_nulls_last())
