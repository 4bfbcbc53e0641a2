"""Governance and feature definitions.  All of these are fixed values."""

from __future__ import annotations

import json

# Owners by dataset; sensitivity by layer with restricted exceptions (GOV3).
OWNERS = {
    "commerce_platform": (
        "silver.silver_customer_current",
        "silver.silver_order_header",
        "silver.silver_order_item",
        "silver.silver_customer_session",
    ),
    "ad_platform": (
        "silver.silver_advertiser_current",
        "silver.silver_campaign_current",
        "silver.silver_sales_activity",
    ),
    "analytics_engineering": (
        "gold.dim_customer",
        "gold.dim_product",
        "gold.dim_advertiser",
        "gold.dim_sales_rep",
        "gold.dim_campaign",
        "gold.dim_date",
        "gold.fct_session_events",
        "gold.fct_orders",
        "gold.fct_order_items",
        "gold.fct_sales_activity",
        "gold.fct_campaign_daily",
        "gold.fct_advertiser_daily",
        "gold.mart_campaign_performance",
        "gold.mart_advertiser_engagement",
        "gold.mart_customer_conversion",
        "gold.semantic_campaign_performance",
        "gold.semantic_advertiser_engagement",
        "gold.semantic_customer_conversion",
    ),
    "ml_platform": (
        "silver.customer_purchase_features_v1",
        "silver.customer_realtime_features_v1_parity",
    ),
}
DEFAULT_OWNER = "platform_admin"
SENSITIVITY_BY_LAYER = {"bronze": "internal", "silver": "confidential", "gold": "internal"}
RESTRICTED = ("silver.silver_customer_current", "silver.silver_sales_activity")
RESTRICTED_CLASS = "restricted"

# Columns that must not leave a table in clear: column -> mask, None drops it (GOV1).
MASKING = {
    "customer": {"first_name": "name", "last_name": "name", "email": "email", "phone": "phone", "zip_code": "zip_code"},
    "sales_activity": {"notes": None},
}
# Column -> name of its token (GOV2).
TOKENIZATION = {"customer": {"email": "email_token", "phone": "phone_token", "customer_id": "customer_token"}}

# Rule catalogue with severities (DQ8).
RULE_SEVERITY = {
    "primary_key_not_null": "critical",
    "business_key_uniqueness": "critical",
    "event_type_enum": "critical",
    "non_negative_amounts": "critical",
    "line_amount_consistency": "critical",
    "session_window": "critical",
    "volume_baseline": "warning",
    "distribution_drift": "warning",
    "reconciliation_totals": "warning",
}

# Declared tests per dataset and column; a relationship names the parent dataset and its column.
# The label of every feature table is in label_value here.
DECLARED_TESTS = {
    "gold.dim_customer": {"customer_token": ["not_null", "unique"]},
    "gold.dim_product": {"product_id": ["not_null", "unique"]},
    "gold.dim_advertiser": {"advertiser_id": ["not_null", "unique"]},
    "gold.dim_sales_rep": {"sales_rep_id": ["not_null", "unique"]},
    "gold.dim_campaign": {"campaign_id": ["not_null", "unique"], "advertiser_id": ["relationships gold.dim_advertiser advertiser_id"]},
    "gold.dim_date": {"date_day": ["not_null", "unique"]},
    "gold.fct_session_events": {"event_uuid": ["not_null", "unique"], "customer_token": ["relationships gold.dim_customer customer_token"]},
    "gold.fct_orders": {
        "order_id": ["not_null", "unique"],
        "customer_token": ["relationships gold.dim_customer customer_token"],
        "total_amount": ["non_negative"],
    },
    "gold.fct_order_items": {
        "order_item_id": ["not_null", "unique"],
        "order_id": ["relationships gold.fct_orders order_id"],
        "line_amount": ["non_negative"],
    },
    "gold.fct_sales_activity": {"sales_activity_id": ["not_null", "unique"]},
    "gold.fct_campaign_daily": {"metric_date": ["not_null"], "campaign_id": ["not_null"], "attributed_revenue": ["non_negative"]},
    "gold.fct_advertiser_daily": {"metric_date": ["not_null"], "advertiser_id": ["not_null"], "attributed_revenue": ["non_negative"]},
    "gold.mart_campaign_performance": {"metric_date": ["not_null"], "campaign_id": ["not_null"], "ctr": ["ratio"], "attributed_revenue": ["non_negative"]},
    "gold.mart_advertiser_engagement": {"metric_date": ["not_null"], "advertiser_id": ["not_null"], "ctr": ["ratio"], "active_campaigns": ["non_negative"]},
    "gold.mart_customer_conversion": {
        "metric_date": ["not_null"],
        "customer_token": ["not_null"],
        "purchases": ["non_negative"],
        "view_to_purchase_rate": ["ratio"],
        "click_to_purchase_rate": ["ratio"],
        "cart_to_purchase_rate": ["ratio"],
    },
    "silver.session_event_clean": {
        "event_uuid": ["not_null", "unique"],
        "event_type": ["accepted_values product_view ad_impression ad_click add_to_cart checkout_start"],
    },
    "silver.order_header": {"order_id": ["not_null", "unique"], "customer_id": ["not_null"]},
    "silver.order_item": {"order_item_id": ["not_null", "unique"], "order_id": ["not_null"]},
    "silver.campaign_daily_metrics": {"campaign_id": ["not_null"], "metric_date": ["not_null"]},
    "silver.customer_purchase_features_v1": {"as_of_date": ["not_null"], "customer_token": ["not_null"], "label_value": ["not_null"]},
    "silver.customer_purchase_realtime_features_v1": {"as_of_date": ["not_null"], "customer_id": ["not_null"], "label_value": ["not_null"]},
    "silver.campaign_success_features_v1": {"as_of_date": ["not_null"], "entity_id": ["not_null"], "label_value": ["not_null"]},
    "silver.advertiser_budget_features_v1": {"as_of_date": ["not_null"], "entity_id": ["not_null"], "label_value": ["not_null"]},
}

# Online features of one customer (STR3, FEA6).
ONLINE_FEATURES = {
    "name": "customer_realtime_features_v1",
    "entity_key": "customer_id",
    "key_pattern": "features:customer:{customer_id}:v1",
    "ttl_seconds": 86400,
    "event_types": ("product_view", "ad_click", "add_to_cart"),
    "aggregations": (
        {"as": "views_1h", "function": "count_distinct", "field": "event_uuid", "window_seconds": 3600, "event_type": "product_view"},
        {"as": "views_24h", "function": "count_distinct", "field": "event_uuid", "window_seconds": 86400, "event_type": "product_view"},
        {"as": "ad_clicks_24h", "function": "count_distinct", "field": "event_uuid", "window_seconds": 86400, "event_type": "ad_click"},
        {"as": "add_to_cart_24h", "function": "count_distinct", "field": "event_uuid", "window_seconds": 86400, "event_type": "add_to_cart"},
    ),
}

# Feature groups: entity, definition version, label (FEA1-FEA5).
FEATURE_GROUPS = {
    "customer": {
        "version": "customer_purchase_features_v1",
        "label": "customer_purchase_next_7d",
        "entity": "customer_token",
    },
    "customer_realtime": {
        "version": "customer_purchase_realtime_features_v1",
        "label": "customer_purchase_next_7d",
        "entity": "customer_id",
    },
    "campaign": {"version": "campaign_success_features_v1", "label": "campaign_success_flag", "entity": "entity_id"},
    "advertiser": {
        "version": "advertiser_budget_features_v1",
        "label": "advertiser_budget_increase_next_30d",
        "entity": "entity_id",
    },
}
NO_PURCHASE_DAYS = 9999
CAMPAIGN_CTR_THRESHOLD = 0.02
BUDGET_PER_ACTIVE_CAMPAIGN = 1000

# Columns of a feature table that are never model inputs (ML1).
NOT_FEATURES = (
    "as_of_date",
    "entity_id",
    "customer_id",
    "customer_token",
    "feature_group",
    "feature_definition_version",
    "feature_version",
    "online_feature_version",
    "label_name",
    "label_value",
    "advertiser_id",
    "generated_ts",
    "last_event_ts",
    "updated_at",
    "ttl_seconds",
)

# Score records: group -> (entity, score name, source of the inputs) and their lifetime (SNK9).
SCORES = {
    "customer_realtime": ("customer", "customer_purchase_propensity", "purchase_propensity", "online+offline"),
    "campaign": ("campaign", "campaign_success_propensity", "success_propensity", "offline"),
    "advertiser": ("advertiser", "advertiser_budget_expansion_propensity", "budget_expansion_propensity", "offline"),
}
SCORE_TTL_SECONDS = 3600


def online_definition(entry: dict) -> dict:
    """An online feature definition file entry in the form of ``ONLINE_FEATURES`` (FLT9, AGG8)."""
    (source,) = entry["sources"]
    return {
        "name": entry["name"],
        "entity_key": entry["entity_key"],
        "key_pattern": next(value for key, value in entry.items() if key.endswith("key_pattern")),
        "ttl_seconds": int(entry["ttl_seconds"]),
        "event_types": tuple(source["filters"]["event_type"]),
        "aggregations": tuple(
            {
                "as": item["as"],
                "function": item["function"],
                "field": item["field"],
                "window_seconds": int(item.get("window_seconds", 0)),
                "event_type": item.get("when", {}).get("event_type"),
            }
            for item in entry["aggregations"]
        ),
    }


def load_definitions(path: str) -> list[dict]:
    """Entries of a feature definition file, JSON or (with PyYAML installed) YAML."""
    with open(path, encoding="utf-8") as handle:
        if path.endswith(".json"):
            return json.load(handle)["features"]
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("reading YAML definitions needs PyYAML; use JSON instead") from error
        return yaml.safe_load(handle)["features"]
