"""Sample tables (customer, orders, lineitem, events …) as Bronze change logs and events.

Every rule is a deterministic SQL expression.  All frames are lazy and grow with the files
they read.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import TABLE_SPECS


def _cents(value: str) -> str:
    return f"bigint(round({value} * 100))"


def _money(cents: str, kind: str = "decimal(12,2)") -> str:
    return f"cast(cast({cents} as decimal(14,0)) * 0.01BD as {kind})"


def _one_of(key: str, *values: str) -> str:
    """Cycle through a few texts by the key."""
    listed = ", ".join(f"'{value}'" for value in values)
    return f"element_at(array({listed}), int({key} % {len(values)} + 1))"


def _minutes_after(day: str, minutes: str) -> str:
    return f"timestamp_seconds(unix_seconds(timestamp({day})) + ({minutes}) * 60)"


def _base(key: str) -> str:
    return f"timestamp(date_add(date'2023-01-01', int({key} % 365)))"


def change_log(rows: DataFrame, name: str, base: str, status: str | None = None) -> DataFrame:
    """Versions of every row: create, update (key % 3 = 0), delete (key % 10 = 9), correction (key % 20 = 0).

    The correction has the same change and ingest time as the update, a tie that only
    the log offset decides.  Deletes alternate between lower and upper case codes.
    """
    spec = TABLE_SPECS[name]
    key = spec.key
    versions = f"array_compact(array(0, if({key} % 3 = 0, 1, null), if({key} % 10 = 9, 2, null), if({key} % 20 = 0, 3, null)))"
    changed = "timestamp_seconds(unix_seconds(_base) + if(_v = 3, 1, _v) * 3600)"
    ingested = "timestamp_seconds(unix_seconds(_base) + if(_v = 3, 1, _v) * 3600 + 5)"
    op = f"case when _v = 0 then 'c' when _v = 2 then if({key} % 20 = 19, 'D', 'd') else 'u' end"
    columns = []
    for column, kind in spec.columns.items():
        if column in ("created_at", "updated_at"):
            continue
        value = column
        if column == status:
            value = f"case _v when 1 then 'updated' when 2 then 'deleted' when 3 then 'corrected' else {column} end"
        columns.append(f"cast({value} as {kind}) as {column}")
    return rows.selectExpr("*", f"{base} as _base", f"explode({versions}) as _v").selectExpr(
        *columns,
        "_base as created_at",
        f"{changed} as updated_at",
        f"named_struct('key', string({key}), 'op', {op}, 'ts', {changed}, 'offset', {key} * 4 + _v) as _cdc",
        f"'{name}' as _kafka_metadata_topic",
        f"int({key} % 8) as _kafka_metadata_partition",
        f"{key} * 4 + _v as _kafka_metadata_offset",
        f"{ingested} as _kafka_metadata_timestamp",
    )


def raw_event_rows(events: DataFrame) -> DataFrame:
    """Click events of the sample in the session event shape, batch or stream; invalid types stay in."""
    kind = """case event_type when 'view' then if(event_id % 2 = 1, 'product_view', 'ad_impression')
        when 'click' then 'ad_click' when 'signup' then 'checkout_start' when 'purchase' then 'add_to_cart'
        else event_type end"""
    rows = events.selectExpr(
        "explode(array_compact(array(0, if(event_id % 20 = 0, 1, null)))) as _copy",
        "event_id",
        "bigint(user_id) as customer_id",
        "timestamp(ts) as event_ts",
        f"{kind} as event_type",
        "bigint(get_json_object(props, '$.k')) as _k",
        "(bigint(user_id) * 2 div 3) * 2 + event_id % 2 as _campaign",
    )
    advertised = "event_type in ('ad_impression', 'ad_click') or (event_type = 'product_view' and event_id % 3 = 0)"
    ingest = "timestamp_micros(unix_micros(event_ts) + bigint(event_id % 120 + _copy * 60) * 60000000)"
    return rows.selectExpr(
        "'evt-' || event_id as event_uuid",
        "event_id",
        "customer_id * 100 + day(event_ts) as session_id",
        "customer_id",
        "event_ts",
        "date(event_ts) as event_date",
        "event_type",
        "if(event_type = 'ad_impression', null, _k) as product_id",
        f"if({advertised}, _campaign, null) as campaign_id",
        f"{_one_of('event_id', 'home', 'search', 'product')} as page_type",
        "if(event_id % 5 = 0, 'k' || _k, null) as search_term",
        "int(event_id % 10 + _copy) as position_in_list",
        f"{ingest} as ingest_ts",
        f"date({ingest}) as ingest_date",
        "'v1' as producer_version",
        "1 as schema_version",
        "int(event_id % 8) as source_partition",
        "event_id * 2 + _copy as source_offset",
    )


def campaign_product_log(part: DataFrame) -> DataFrame:
    """Change log of campaign products, batch or stream."""
    rows = part.selectExpr(
        "p_partkey as campaign_product_id",
        "p_partkey div 10 as campaign_id",
        "p_partkey % 100 as product_id",
        f"{_money('bigint(p_size) * 100 + 25', 'decimal(10,2)')} as bid_amount",
        "p_size % 5 as priority",
    )
    return change_log(rows, "campaign_product", _base("campaign_product_id"))


class SampleBronze:
    """Bronze layer over a folder with the sample files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._files: dict[str, DataFrame] = {}

    def file(self, name: str) -> DataFrame:
        if name not in self._files:
            self._files[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._files[name]

    def table(self, name: str) -> DataFrame:
        """Bronze change log ``name``, or ``session_event``."""
        return getattr(self, name)

    @cached_property
    def _places(self) -> DataFrame:
        region = self.file("region").selectExpr("r_regionkey as n_regionkey", "r_name")
        return self.file("nation").join(region, "n_regionkey", "left").select("n_nationkey", "n_name", "r_name")

    @cached_property
    def _suppliers(self) -> DataFrame:
        places = self._places.withColumnRenamed("n_nationkey", "s_nationkey")
        return self.file("supplier").join(places, "s_nationkey", "left")

    @cached_property
    def sales_rep(self) -> DataFrame:
        rows = self._suppliers.selectExpr(
            "s_suppkey as sales_rep_id",
            "'Rep ' || s_name as rep_name",
            "'team-' || s_suppkey % 5 as team_name",
            "r_name as region",
            "'manager-' || s_suppkey % 3 as manager_name",
            "'active' as status",
        )
        return change_log(rows, "sales_rep", _base("sales_rep_id"), "status")

    @cached_property
    def customer(self) -> DataFrame:
        places = self._places.withColumnRenamed("n_nationkey", "c_nationkey")
        email = "lower(c_mktsegment) || '.' || c_custkey || '@example.com'"
        rows = (
            self.file("customer")
            .join(places, "c_nationkey", "left")
            .selectExpr(
                "c_custkey as customer_id",
                "c_name as first_name",
                "c_mktsegment as last_name",
                f"case c_custkey % 50 when 1 then 'no-at-sign' when 0 then null else {email} end as email",
                "'555-' || lpad(c_custkey % 1000, 3, '0') || '-' || lpad(c_custkey % 10000, 4, '0') as phone",
                "n_name as city",
                "r_name as state",
                "lpad(c_custkey % 100000, 5, '0') as zip_code",
                "if(c_acctbal < 0, 'dormant', 'active') as status",
            )
        )
        return change_log(rows, "customer", _base("customer_id"), "status")

    @cached_property
    def advertiser(self) -> DataFrame:
        tier = "case when s_acctbal >= 6000 then 'enterprise' when s_acctbal >= 2000 then 'mid_market' else 'small' end"
        rows = self._suppliers.selectExpr(
            "s_suppkey as advertiser_id",
            "s_name as advertiser_name",
            "'industry-' || s_suppkey % 7 as industry",
            f"{tier} as account_tier",
            "r_name as region",
            "s_suppkey - s_suppkey % 2 as owner_sales_rep_id",
            "'active' as status",
        )
        return change_log(rows, "advertiser", _base("advertiser_id"), "status")

    @cached_property
    def product(self) -> DataFrame:
        price = _cents("p_retailprice")
        rows = self.file("part").selectExpr(
            "p_partkey as product_id",
            "'SKU-' || p_partkey as sku",
            "p_name as product_name",
            "p_brand as brand",
            "p_type as category",
            "'size-' || p_size as subcategory",
            f"{_money(price)} as list_price",
            f"{_money(f'({price} * 6) div 10')} as cost",
            "p_partkey % 7 <> 0 as active_flag",
        )
        return change_log(rows, "product", _base("product_id"))

    @cached_property
    def campaign(self) -> DataFrame:
        end = """case when campaign_id % 11 = 0 then null when campaign_id % 26 = 13 then date_sub(start_date, 2)
            else date_add(start_date, int(campaign_id % 15 + 5)) end"""
        rows = (
            self.file("supplier")
            .selectExpr("s_suppkey", "s_name", "explode(array(0, 1)) as j")
            .selectExpr("*", "s_suppkey * 2 + j as campaign_id")
            .selectExpr("*", "date_add(date'2024-01-01', int(campaign_id * 3 % 20)) as start_date")
            .selectExpr(
                "campaign_id",
                "s_suppkey as advertiser_id",
                "s_name || '-' || j as campaign_name",
                f"{_one_of('campaign_id', 'search', 'display', 'video')} as campaign_type",
                f"{_one_of('campaign_id', 'reach', 'traffic')} as objective",
                f"{_money('(campaign_id % 40 * 250 + 1000) * 100', 'decimal(14,2)')} as budget_amount",
                "start_date",
                f"{end} as end_date",
                f"{_one_of('campaign_id', 'active', 'paused')} as status",
            )
        )
        return change_log(rows, "campaign", _base("campaign_id"))

    @cached_property
    def campaign_product(self) -> DataFrame:
        return campaign_product_log(self.file("part"))

    @cached_property
    def session_event(self) -> DataFrame:
        return raw_event_rows(self.file("events"))

    @cached_property
    def customer_session(self) -> DataFrame:
        events = self.file("events").selectExpr(
            "bigint(user_id) as customer_id", "bigint(user_id) * 100 + day(ts) as session_id", "timestamp(ts) as ts"
        )
        spans = events.groupBy("customer_id", "session_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        end = """case when session_id % 13 = 0 then null
            when session_id % 19 = 0 then timestamp_micros(unix_micros(first_ts) - 60000000) else last_ts end"""
        rows = spans.selectExpr(
            "session_id",
            "customer_id",
            "first_ts as session_start_ts",
            f"{end} as session_end_ts",
            f"{_one_of('session_id', 'mobile', 'desktop', 'tablet')} as device_type",
            f"if(session_id % 17 = 0, null, {_one_of('session_id', 'email', 'organic', 'paid_search', 'social')}) as channel",
            f"{_one_of('session_id', 'direct', 'partner')} as referrer_type",
        )
        return change_log(rows, "customer_session", "date_trunc('second', session_start_ts)")

    @cached_property
    def order_header(self) -> DataFrame:
        total = _cents("o_totalprice")
        tax = f"if(o_orderkey % 97 = 0, -100, ({total} * 8) div 100)"
        day = "date_add(date'2023-09-01', datediff(o_orderdate, date'1995-01-01') % 210)"
        rows = self.file("orders").selectExpr(
            "o_orderkey as order_id",
            "o_custkey as customer_id",
            f"{_minutes_after(day, 'o_orderkey * 7 % 1440')} as order_ts",
            "o_orderstatus as order_status",
            f"{_money(total)} as subtotal_amount",
            f"{_money('0')} as discount_amount",
            f"{_money(tax)} as tax_amount",
            f"{_money(total)} as total_amount",
            f"{_one_of('o_orderkey', 'card', 'paypal', 'gift_card')} as payment_type",
        )
        return change_log(rows, "order_header", "order_ts")

    @cached_property
    def order_item(self) -> DataFrame:
        """Repeated (order, line) pairs of the sample are versions of one item."""
        extended = _cents("l_extendedprice")
        rows = self.file("lineitem").selectExpr(
            "*",
            "l_orderkey * 10 + l_linenumber as order_item_id",
            "bigint(l_quantity) as _quantity",
            f"{extended} div bigint(l_quantity) as _unit",
            "timestamp(l_shipdate) as _ts",
            f"l_partkey * 1000000 + {extended} % 1000000 as _offset",
        )
        op = "if(l_suppkey % 25 = 7, 'd', 'u')"
        return rows.selectExpr(
            "order_item_id",
            "l_orderkey as order_id",
            "l_partkey % 100 as product_id",
            "int(_quantity) as quantity",
            f"{_money('_unit')} as unit_price",
            f"{_money('_unit * _quantity + if(l_tax = 0.08D, 100, 0)')} as line_amount",
            "if(l_returnflag = 'R', null, l_suppkey * 2 + l_linenumber % 2) as attributed_campaign_id",
            "_ts as created_at",
            "_ts as updated_at",
            f"named_struct('key', string(order_item_id), 'op', {op}, 'ts', _ts, 'offset', _offset) as _cdc",
            "'order_item' as _kafka_metadata_topic",
            "int(order_item_id % 8) as _kafka_metadata_partition",
            "_offset as _kafka_metadata_offset",
            "timestamp_seconds(unix_seconds(_ts) + l_suppkey) as _kafka_metadata_timestamp",
        )

    @cached_property
    def sales_activity(self) -> DataFrame:
        """One activity an order, whose priority tells its type."""
        day = "date_add(date'2023-09-01', (datediff(o_orderdate, date'1995-01-01') * 5 + 17) % 210)"
        rows = self.file("orders").selectExpr(
            "o_orderkey as sales_activity_id",
            "o_custkey div 15 as advertiser_id",
            "o_custkey div 15 as sales_rep_id",
            f"{_minutes_after(day, 'o_orderkey * 11 % 1440')} as activity_ts",
            "case o_orderpriority when '1-URGENT' then 'call' when '2-HIGH' then 'meeting' else 'email' end as activity_type",
            f"{_one_of('o_orderkey', 'positive', 'neutral')} as activity_outcome",
            "'call ' || o_orderkey as notes",
        )
        return change_log(rows, "sales_activity", "activity_ts")
