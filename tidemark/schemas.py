"""Declared shapes: the ten change-log tables, the session event, the envelope (SRC7)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TableSpec:
    """Business columns of one change-log table, with the durable key."""

    name: str
    key: str
    columns: dict[str, str]

    @property
    def bronze(self) -> str:
        return f"bronze_{self.name}_cdc"


_AUDIT = {"created_at": "timestamp", "updated_at": "timestamp"}

# Column names and types of the ten source tables.
_COLUMNS = {
    "sales_rep": {
        "sales_rep_id": "bigint",
        "rep_name": "string",
        "team_name": "string",
        "region": "string",
        "manager_name": "string",
        "status": "string",
    },
    "customer": {
        "customer_id": "bigint",
        "first_name": "string",
        "last_name": "string",
        "email": "string",
        "phone": "string",
        "city": "string",
        "state": "string",
        "zip_code": "string",
        "status": "string",
    },
    "advertiser": {
        "advertiser_id": "bigint",
        "advertiser_name": "string",
        "industry": "string",
        "account_tier": "string",
        "region": "string",
        "owner_sales_rep_id": "bigint",
        "status": "string",
    },
    "product": {
        "product_id": "bigint",
        "sku": "string",
        "product_name": "string",
        "brand": "string",
        "category": "string",
        "subcategory": "string",
        "list_price": "decimal(12,2)",
        "cost": "decimal(12,2)",
        "active_flag": "boolean",
    },
    "campaign": {
        "campaign_id": "bigint",
        "advertiser_id": "bigint",
        "campaign_name": "string",
        "campaign_type": "string",
        "objective": "string",
        "budget_amount": "decimal(14,2)",
        "start_date": "date",
        "end_date": "date",
        "status": "string",
    },
    "campaign_product": {
        "campaign_product_id": "bigint",
        "campaign_id": "bigint",
        "product_id": "bigint",
        "bid_amount": "decimal(10,2)",
        "priority": "int",
    },
    "customer_session": {
        "session_id": "bigint",
        "customer_id": "bigint",
        "session_start_ts": "timestamp",
        "session_end_ts": "timestamp",
        "device_type": "string",
        "channel": "string",
        "referrer_type": "string",
    },
    "order_header": {
        "order_id": "bigint",
        "customer_id": "bigint",
        "order_ts": "timestamp",
        "order_status": "string",
        "subtotal_amount": "decimal(12,2)",
        "discount_amount": "decimal(12,2)",
        "tax_amount": "decimal(12,2)",
        "total_amount": "decimal(12,2)",
        "payment_type": "string",
    },
    "order_item": {
        "order_item_id": "bigint",
        "order_id": "bigint",
        "product_id": "bigint",
        "quantity": "int",
        "unit_price": "decimal(12,2)",
        "line_amount": "decimal(12,2)",
        "attributed_campaign_id": "bigint",
    },
    "sales_activity": {
        "sales_activity_id": "bigint",
        "advertiser_id": "bigint",
        "sales_rep_id": "bigint",
        "activity_ts": "timestamp",
        "activity_type": "string",
        "activity_outcome": "string",
        "notes": "string",
    },
}

TABLE_SPECS = {name: TableSpec(name, next(iter(cols)), {**cols, **_AUDIT}) for name, cols in _COLUMNS.items()}

# The event types that may enter Bronze.
EVENT_TYPES = ("product_view", "ad_impression", "ad_click", "add_to_cart", "checkout_start")

# The session event record, in wire order; a trailing "?" marks a nullable field.
EVENT_RECORD = {
    "event_uuid": "string",
    "event_id": "bigint",
    "session_id": "bigint",
    "customer_id": "bigint",
    "event_ts": "timestamp",
    "event_type": "string",
    "product_id": "bigint?",
    "campaign_id": "bigint?",
    "page_type": "string?",
    "search_term": "string?",
    "position_in_list": "int?",
    "ingest_ts": "timestamp",
    "producer_version": "string",
    "schema_version": "int",
}
EVENT_COLUMNS = {name: kind.rstrip("?") for name, kind in EVENT_RECORD.items()}
EVENT_TOPIC = "events.session_event"
EVENT_SUBJECT = "events.session_event-value"


def ddl(columns: dict[str, str]) -> str:
    """``name type, …`` text that Spark's schema arguments accept."""
    return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())
