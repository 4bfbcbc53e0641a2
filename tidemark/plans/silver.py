"""Silver tables S01-S11: current dimensions and clean facts.  Pure builders, nothing runs here."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import policies
from tidemark.operators.cdc import flatten_cdc, latest_by_event_uuid, latest_cdc
from tidemark.operators.filters import date_range, is_consistent_line, is_event_type, is_non_negative, is_valid_interval
from tidemark.operators.governance import enrich_metadata, mask_table
from tidemark.operators.quality import event_rules, item_rules, order_rules, session_rules
from tidemark.schemas import TABLE_SPECS

Day = date | str | None

DIMENSIONS = ("sales_rep", "customer", "advertiser", "product", "campaign", "campaign_product")
ORDER_AMOUNTS = ("subtotal_amount", "discount_amount", "tax_amount", "total_amount")

# Columns of the clean event table.
EVENT_OUTPUT = (
    "event_uuid",
    "session_id",
    "customer_id",
    "event_ts",
    "event_date",
    "event_type",
    "product_id",
    "campaign_id",
    "page_type",
    "search_term",
    "position_in_list",
    "ingest_ts",
    "producer_version",
    "schema_version",
)


def stamp(df: DataFrame, column: str, at: datetime | None) -> DataFrame:
    """Processing time as a parameter, the wall clock only by default."""
    return df.withColumn(column, F.current_timestamp() if at is None else F.lit(at))


def business_rows(bronze: DataFrame, name: str) -> DataFrame:
    """Current rows of one change log in business columns, before rules and masks."""
    spec = TABLE_SPECS[name]
    return flatten_cdc(latest_cdc(bronze, spec.key), spec)


def current_dimension(bronze: DataFrame, name: str, processed_at: datetime | None = None) -> DataFrame:
    """One governed row per business key, restricted columns masked."""
    rows = mask_table(business_rows(bronze, name), policies.MASKING.get(name, {}))
    return enrich_metadata(stamp(rows, "silver_processed_ts", processed_at), f"silver.silver_{name}_current")


def candidate_sessions(bronze: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    return date_range(business_rows(bronze, "customer_session"), "updated_at", start, end)


def candidate_events(bronze: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    """Deduplicated events.  The range comes after the latest row, which may lie outside it."""
    return date_range(latest_by_event_uuid(bronze), "event_date", start, end).select(*EVENT_OUTPUT)


def candidate_orders(bronze: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    return date_range(business_rows(bronze, "order_header"), "order_ts", start, end)


def candidate_items(bronze: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    return date_range(business_rows(bronze, "order_item"), "updated_at", start, end)


#: Facts with rules: the rows before the rules, and the rules.  ``Lakehouse.build`` sends rejected rows to quarantine.
RULED = {
    "customer_session": (candidate_sessions, session_rules),
    "session_event_clean": (candidate_events, event_rules),
    "order_header": (candidate_orders, order_rules),
    "order_item": (candidate_items, item_rules),
}


def customer_session(
    bronze: DataFrame, start: Day = None, end: Day = None, processed_at: datetime | None = None
) -> DataFrame:
    """Sessions with an open or ordered time span."""
    rows = candidate_sessions(bronze, start, end).filter(is_valid_interval("session_start_ts", "session_end_ts"))
    return stamp(rows, "silver_processed_ts", processed_at)


def session_event_clean(
    bronze: DataFrame, start: Day = None, end: Day = None, processed_at: datetime | None = None
) -> DataFrame:
    """One row per event, allowed types only."""
    rows = candidate_events(bronze, start, end).filter(is_event_type())
    return stamp(rows, "silver_processed_ts", processed_at)


def order_header(
    bronze: DataFrame, start: Day = None, end: Day = None, processed_at: datetime | None = None
) -> DataFrame:
    """Orders whose amounts are all zero or more."""
    rows = candidate_orders(bronze, start, end).filter(is_non_negative(*ORDER_AMOUNTS))
    return stamp(rows, "silver_processed_ts", processed_at)


def order_item(
    bronze: DataFrame, start: Day = None, end: Day = None, processed_at: datetime | None = None
) -> DataFrame:
    """Order lines that add up."""
    rows = candidate_items(bronze, start, end).filter(is_consistent_line())
    return stamp(rows, "silver_processed_ts", processed_at)


def sales_activity(
    bronze: DataFrame, start: Day = None, end: Day = None, processed_at: datetime | None = None
) -> DataFrame:
    """Sales activities without the free-text notes (PRJ2)."""
    rows = mask_table(business_rows(bronze, "sales_activity"), policies.MASKING["sales_activity"])
    return stamp(date_range(rows, "activity_ts", start, end), "silver_processed_ts", processed_at)
