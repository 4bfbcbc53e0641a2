"""Point-in-time features and labels FEA1-FEA9.

All features come from range frames over (entity, day) rows: linear work, no self join,
nothing from after the as-of day except in labels.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import policies
from tidemark.functions.privacy import token
from tidemark.functions.scalars import ctr
from tidemark.functions.timewindows import happened, leading_days, trailing_days, trailing_rows, up_to_day
from tidemark.operators.aggregates import definition_exprs
from tidemark.operators.joins import latest_snapshot, salted_join
from tidemark.plans.silver import stamp


def _labelled(df: DataFrame, group: str, label: Column, generated_at: datetime | None) -> DataFrame:
    about = policies.FEATURE_GROUPS[group]
    constants = {
        "feature_group": F.lit(group),
        "feature_definition_version": F.lit(about["version"]),
        "label_name": F.lit(about["label"]),
        "label_value": label.cast("int"),
    }
    return stamp(df.withColumns(constants), "generated_ts", generated_at)


def order_history(
    daily: DataFrame, orders: DataFrame, carry: Sequence[str] = (), framed: Mapping[str, Column] | None = None
) -> DataFrame:
    """Order facts as of every (customer, day) of the daily metrics (AGG5, WIN6-WIN8).

    Order days and metric days meet in one union, one row per customer and day, so the
    frames see both without a join.  ``carry`` keeps columns of ``daily``; ``framed`` adds
    window expressions over them, days without metrics counting as nothing.
    """
    key, day = "customer_id", "as_of_date"
    spine = daily.select(key, F.col("metric_date").alias(day), *carry, F.lit(1).alias("_spine"))
    per_day = orders.groupBy(key, F.to_date("order_ts").alias(day)).agg(
        F.count("order_id").alias("_orders"),
        F.sum("total_amount").alias("_amount"),
        F.count("total_amount").alias("_amounts"),
    )
    both = spine.unionByName(per_day, allowMissingColumns=True)
    merged = [F.max(name).alias(name) for name in (*carry, "_spine")]
    added = [F.sum(name).alias(name) for name in ("_orders", "_amount", "_amounts")]
    rows = both.groupBy(key, day).agg(*merged, *added)
    month, quarter = trailing_days(key, day, 30), trailing_days(key, day, 90)
    paid = F.sum("_amounts").over(quarter)
    last_purchase = F.max(F.when(F.col("_orders") > 0, F.col(day))).over(up_to_day(key, day))
    return (
        rows.select(
            key,
            day,
            *carry,
            *[column.alias(name) for name, column in (framed or {}).items()],
            "_spine",
            F.coalesce(F.sum("_orders").over(month), F.lit(0)).cast("bigint").alias("purchases_30d"),
            F.when(paid > 0, F.sum("_amount").over(quarter).cast("double") / paid).otherwise(0.0).alias("avg_order_value_90d"),
            F.coalesce(F.datediff(day, last_purchase), F.lit(policies.NO_PURCHASE_DAYS)).alias("days_since_last_purchase"),
            happened(F.col("_orders") > 0, leading_days(key, day, 7)).alias("label_value"),
        )
        .filter(F.col("_spine") == 1)
        .drop("_spine")
    )


def _trailing_sums(key: str, day: str, sums: Mapping[str, tuple[str, int]]) -> dict[str, Column]:
    return {
        name: F.coalesce(F.sum(column).over(trailing_days(key, day, days)), F.lit(0)) for name, (column, days) in sums.items()
    }


def customer_purchase_features(daily: DataFrame, orders: DataFrame, generated_at: datetime | None = None) -> DataFrame:
    """FEA1: 7-day behaviour, 30/90-day purchases, recency, purchase within the next 7 days."""
    behaviour = {"views_7d": ("views", 7), "ad_clicks_7d": ("ad_clicks", 7), "add_to_cart_7d": ("add_to_cart", 7)}
    framed = _trailing_sums("customer_id", "as_of_date", behaviour)
    history = order_history(daily, orders, ["views", "ad_clicks", "add_to_cart"], framed)
    shaped = history.select(
        "as_of_date",
        token("customer_id").alias("customer_token"),
        *[F.col(name).cast("bigint").alias(name) for name in behaviour],
        "purchases_30d",
        F.round("avg_order_value_90d", 4).alias("avg_order_value_90d"),
        "days_since_last_purchase",
        F.col("label_value").alias("_label"),
    )
    return _labelled(shaped, "customer", F.col("_label"), generated_at).drop("_label")


def customer_rowframe_features(daily: DataFrame, orders: DataFrame, generated_at: datetime | None = None) -> DataFrame:
    """FEA2: features over the last 30 metric rows instead of 30 days (WIN3, JOI8)."""
    window = trailing_rows("customer_id", "metric_date", 30)
    rows = daily.select(
        "customer_id",
        "metric_date",
        F.sum("purchases").over(window).cast("bigint").alias("row_purchases"),
        F.avg("order_amount").over(window).cast("double").alias("row_avg_amount"),
    )
    shaped = order_history(rows, orders, ["row_purchases", "row_avg_amount"]).select(
        "as_of_date",
        token("customer_id").alias("customer_token"),
        F.col("row_purchases").alias("purchases_30d"),
        F.col("row_avg_amount").alias("avg_order_value_30d"),
        F.col("label_value").alias("customer_purchase_next_7d"),
        F.lit(policies.FEATURE_GROUPS["customer"]["version"]).alias("feature_version"),
    )
    return stamp(shaped, "generated_ts", generated_at)


def customer_realtime_features(
    daily: DataFrame, orders: DataFrame, parity: DataFrame, generated_at: datetime | None = None
) -> DataFrame:
    """FEA3: order history plus online counts, from the snapshot or else from the day's metrics.

    A snapshot is used from its own day on and never before, so nothing leaks backwards.
    """
    online = ["views_1h", "views_24h", "ad_clicks_24h", "add_to_cart_24h"]
    snapshot = latest_snapshot(parity, ["customer_id"], ["as_of_ts"]).select(
        "customer_id",
        F.to_date("as_of_ts").alias("_known_from"),
        *[F.col(name).alias(f"_{name}") for name in online],
        F.col("feature_version").alias("_version"),
        F.col("last_event_ts").alias("_last_event_ts"),
        F.col("ttl_seconds").alias("_ttl"),
    )
    history = order_history(daily, orders, ["views", "ad_clicks", "add_to_cart"])
    joined = history.join(snapshot, "customer_id", "left")
    known = F.col("_known_from") <= F.col("as_of_date")
    fallback = {
        "views_1h": F.when(F.col("views") > 0, 1).otherwise(0),
        "views_24h": F.col("views"),
        "ad_clicks_24h": F.col("ad_clicks"),
        "add_to_cart_24h": F.col("add_to_cart"),
    }
    shaped = joined.select(
        "as_of_date",
        F.col("customer_id").cast("bigint").alias("customer_id"),
        *[F.coalesce(F.when(known, F.col(f"_{name}")), fallback[name]).cast("bigint").alias(name) for name in online],
        "purchases_30d",
        F.round("avg_order_value_90d", 4).alias("avg_order_value_90d"),
        "days_since_last_purchase",
        F.coalesce(F.when(known, F.col("_version")), F.lit(policies.ONLINE_FEATURES["name"])).alias("online_feature_version"),
        F.when(known, F.col("_last_event_ts")).alias("last_event_ts"),
        F.coalesce(F.when(known, F.col("_ttl")), F.lit(0)).cast("int").alias("ttl_seconds"),
        F.col("label_value").alias("_label"),
    )
    return _labelled(shaped, "customer_realtime", F.col("_label"), generated_at).drop("_label")


def campaign_features(
    daily: DataFrame,
    ctr_threshold: float = policies.CAMPAIGN_CTR_THRESHOLD,
    generated_at: datetime | None = None,
) -> DataFrame:
    """FEA4: 7/30-day campaign features; success is an order or a good CTR in the next 7 days."""
    sums = {
        "impressions_7d": ("impressions", 7),
        "clicks_7d": ("clicks", 7),
        "attributed_orders_30d": ("attributed_orders", 30),
        "attributed_revenue_30d": ("attributed_revenue", 30),
    }
    good_day = (F.col("attributed_orders") > 0) | (ctr("clicks", "impressions") >= ctr_threshold)
    framed = daily.select(
        F.col("metric_date").alias("as_of_date"),
        F.col("campaign_id").alias("entity_id"),
        "advertiser_id",
        *[column.alias(name) for name, column in _trailing_sums("campaign_id", "metric_date", sums).items()],
        happened(good_day, leading_days("campaign_id", "metric_date", 7)).alias("_label"),
    )
    shaped = framed.select(
        "as_of_date",
        "entity_id",
        "advertiser_id",
        F.col("impressions_7d").cast("bigint").alias("impressions_7d"),
        F.col("clicks_7d").cast("bigint").alias("clicks_7d"),
        ctr("clicks_7d", "impressions_7d").alias("ctr_7d"),
        F.col("attributed_orders_30d").cast("bigint").alias("attributed_orders_30d"),
        F.round(F.col("attributed_revenue_30d").cast("double"), 2).alias("attributed_revenue_30d"),
        "_label",
    )
    return _labelled(shaped, "campaign", F.col("_label"), generated_at).drop("_label")


def advertiser_features(
    daily: DataFrame, budget: DataFrame | None = None, generated_at: datetime | None = None
) -> DataFrame:
    """FEA5: advertiser features and the change of the largest budget over the next 30 days (WIN9).

    ``budget`` has (snapshot_date, advertiser_id, budget_amount); without it the number of
    active campaigns stands in.  Budget days join the frames by union, so sums are not
    multiplied by budget rows.
    """
    key, day = "advertiser_id", "as_of_date"
    measures = ["active_campaigns", "sales_contacts", "impressions", "clicks", "attributed_revenue"]
    known = daily.filter(F.col(key).isNotNull())
    spine = known.select(F.col("metric_date").alias(day), key, *measures, F.lit(1).alias("_spine"))
    if budget is None:
        proxy = F.col("active_campaigns") * policies.BUDGET_PER_ACTIVE_CAMPAIGN
        rows = spine.withColumn("_budget", proxy.cast("double"))
    else:
        per_day = budget.groupBy(F.col("snapshot_date").cast("date").alias(day), key).agg(
            F.max(F.col("budget_amount").cast("double")).alias("_budget")
        )
        both = spine.unionByName(per_day, allowMissingColumns=True)
        rows = both.groupBy(day, key).agg(
            *[F.max(name).alias(name) for name in [*measures, "_spine", "_budget"]],
        )
    month = trailing_days(key, day, 30)

    def trailing_sum(column: str, days: int) -> Column:
        return F.coalesce(F.sum(column).over(trailing_days(key, day, days)), F.lit(0))

    current = F.coalesce(F.max("_budget").over(up_to_day(key, day)), F.lit(0.0))
    future = F.coalesce(F.max("_budget").over(leading_days(key, day, 30)), F.lit(0.0))
    framed = rows.select(
        day,
        F.col(key).alias("entity_id"),
        F.coalesce(F.max("active_campaigns").over(month), F.lit(0)).cast("bigint").alias("active_campaigns_30d"),
        trailing_sum("sales_contacts", 14).cast("bigint").alias("sales_contacts_14d"),
        F.round(future - current, 2).alias("budget_delta_30d"),
        trailing_sum("impressions", 7).cast("bigint").alias("impressions_7d"),
        trailing_sum("clicks", 7).cast("bigint").alias("clicks_7d"),
        F.round(trailing_sum("attributed_revenue", 30).cast("double"), 2).alias("attributed_revenue_30d"),
        (future - current > 0).cast("int").alias("_label"),
        "_spine",
    )
    shaped = framed.filter(F.col("_spine") == 1).drop("_spine")
    return _labelled(shaped, "advertiser", F.col("_label"), generated_at).drop("_label")


def offline_online_features(
    events: DataFrame, definition: Mapping = policies.ONLINE_FEATURES, as_of: datetime | None = None
) -> DataFrame:
    """FEA6: the online features of every customer recomputed from clean events.

    Without ``as_of`` the anchor is the customer's latest event, as in the stream.  Events
    must be unique by id.  The anchor lookup is salted for very active customers only, and the
    counts are combined per salt before the final sum, so such a customer is spread over many tasks.
    """
    key = definition["entity_key"]
    longest = max(entry["window_seconds"] for entry in definition["aggregations"])
    used = events.filter(F.col("event_type").isin(*definition["event_types"])).select(
        key, "event_uuid", "event_type", "event_ts"
    )
    if as_of is None:
        anchors = used.groupBy(key).agg(F.max("event_ts").alias("as_of_ts"))
        anchored = salted_join(used, anchors, [key])
    else:
        anchored = used.withColumn("as_of_ts", F.lit(as_of).cast("timestamp"))
    age = (F.unix_micros("as_of_ts") - F.unix_micros("event_ts")) / 1_000_000
    # With the latest event as anchor every customer keeps a row; a given time keeps all customers seen before it.
    in_window = anchored.filter(age >= 0) if as_of is not None else anchored.filter(age <= longest)
    counted = in_window.groupBy(key, "as_of_ts").agg(
        *definition_exprs(definition["aggregations"], age), F.max("event_ts").alias("last_event_ts")
    )
    return counted.withColumns(
        {
            "feature_version": F.lit(definition["name"]),
            "updated_at": F.col("as_of_ts"),
            "ttl_seconds": F.lit(definition["ttl_seconds"]),
        }
    )


# Compared fields of an online record; the doubles are rounded to four places.
ONLINE_FIELDS = (
    "views_1h",
    "views_24h",
    "ad_clicks_24h",
    "add_to_cart_24h",
    "purchases_30d",
    "avg_order_value_90d",
    "days_since_last_purchase",
    "feature_version",
    "last_event_ts",
    "updated_at",
    "ttl_seconds",
)
ONLINE_DEFAULTS = {"days_since_last_purchase": policies.NO_PURCHASE_DAYS, "feature_version": ""}


def expected_online_records(realtime: DataFrame, features: DataFrame, definition: Mapping = policies.ONLINE_FEATURES) -> DataFrame:
    """What the online store should hold: online counts with the latest order features."""
    counts = [entry["as"] for entry in definition["aggregations"]]
    latest = features.select("customer_id", "purchases_30d", "avg_order_value_90d", "days_since_last_purchase")
    return realtime.join(latest, "customer_id", "left").select(
        "customer_id",
        *[F.coalesce(F.col(name).cast("bigint"), F.lit(0)).alias(name) for name in [*counts, "purchases_30d"]],
        F.round(F.coalesce(F.col("avg_order_value_90d").cast("double"), F.lit(0.0)), 4).alias("avg_order_value_90d"),
        F.coalesce("days_since_last_purchase", F.lit(policies.NO_PURCHASE_DAYS)).alias("days_since_last_purchase"),
        F.lit(definition["name"]).alias("feature_version"),
        "last_event_ts",
        "updated_at",
        F.lit(definition["ttl_seconds"]).alias("ttl_seconds"),
    )


def parity_mismatches(
    expected: DataFrame,
    actual: DataFrame,
    key: str = "customer_id",
    fields: Sequence[str] = ONLINE_FIELDS,
    tolerance: float = 1e-6,
) -> DataFrame:
    """FEA7: one row per field that differs, (key, field, expected, actual) as text.

    A record missing on one side differs in every field that the other side sets.
    Doubles are compared with the tolerance after rounding to four places.
    """
    used = [name for name in fields if name in expected.columns and name in actual.columns]
    doubles = {field.name for field in expected.schema.fields if field.dataType.typeName() in ("double", "float")}
    left = expected.select(key, *[F.col(name).alias(f"e_{name}") for name in used])
    right = actual.select(key, *[F.col(name).alias(f"a_{name}") for name in used])
    checks = []
    for name in used:
        mine, theirs = F.col(f"e_{name}"), F.col(f"a_{name}")
        if name in doubles:
            theirs = F.round(theirs.cast("double"), 4)
            same = (F.abs(mine - theirs) <= tolerance) | (mine.isNull() & theirs.isNull())
        else:
            same = mine.eqNullSafe(theirs)
        detail = F.struct(
            F.lit(name).alias("field"), mine.cast("string").alias("expected"), theirs.cast("string").alias("actual")
        )
        checks.append(F.when(~F.coalesce(same, F.lit(False)), detail))
    joined = left.join(right, key, "full_outer")
    return joined.select(key, F.explode(F.array_compact(F.array(*checks))).alias("m")).select(key, "m.*")


def latest_features(features: DataFrame, entity: str) -> DataFrame:
    """FEA9: the row of the latest as-of day for every entity."""
    return latest_snapshot(features, [entity], ["as_of_date"])


def scoring_payload(offline: DataFrame, online: DataFrame, key: str = "customer_id") -> DataFrame:
    """FEA8: model inputs for every entity; the online value wins, then the offline one, then the default."""
    inputs = ONLINE_FIELDS[:7]
    live = online.select(key, *[F.col(name).alias(f"_{name}") for name in inputs if name in online.columns])
    joined = offline.join(live, key, "left")
    columns = []
    for name in inputs:
        kind = "double" if name == "avg_order_value_90d" else "bigint"
        sources = [F.col(c).cast(kind) for c in (f"_{name}", name) if c in joined.columns]
        columns.append(F.coalesce(*sources, F.lit(ONLINE_DEFAULTS.get(name, 0)).cast(kind)).alias(name))
    return joined.select(key, *columns)
