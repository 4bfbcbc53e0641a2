"""DuckDB SQL for every registered query that SQL can express, over the sample tables.

Written independently of the DataFrame code: plain joins, row_number and conditional sums.
Dates leave as text, timestamps as epoch microseconds, decimals as double, like
``portable`` in ``__spark_entry__`` makes them.
"""

from __future__ import annotations

import re

from tidemark.functions.privacy import TOKEN_SEPARATOR, default_salt
from tidemark.policies import DECLARED_TESTS

CTES: dict[str, str] = {}


def mean4(total: str, count: str) -> str:
    """Mean of a decimal(…,2) total rounded half up to four places, in whole numbers."""
    return f"((CAST({total} * 100 AS BIGINT) * 200 + {count}) // (2 * {count})) / 10000.0"


def token(column: str) -> str:
    return f"sha256('{default_salt()}{TOKEN_SEPARATOR}' || CAST({column} AS VARCHAR))"


def one_of(key: str, *values: str) -> str:
    listed = ", ".join(f"'{value}'" for value in values)
    return f"([{listed}])[CAST({key} % {len(values)} AS INTEGER) + 1]"


def cents(value: str, kind: str = "DECIMAL(12,2)") -> str:
    return f"CAST(CAST({value} AS DECIMAL(14,0)) * CAST(0.01 AS DECIMAL(3,2)) AS {kind})"


def ratio(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} IS NULL OR {bottom} = 0 THEN 0.0 ELSE CAST({top} AS DOUBLE) / CAST({bottom} AS DOUBLE) END"


def add_log(name: str, key: str, rows: str, base: str, status: str | None = None) -> None:
    """``<name>_rows``, its change log ``<name>_cdc`` and the current rows ``<name>_cur``."""
    CTES[f"{name}_rows"] = rows
    replaced = ""
    if status:
        replaced = (
            f" REPLACE (CASE v WHEN 1 THEN 'updated' WHEN 2 THEN 'deleted' WHEN 3 THEN 'corrected' "
            f"ELSE {status} END AS {status})"
        )
    CTES[f"{name}_cdc"] = f"""
SELECT *{replaced}, {base} AS created_at, {base} + to_hours(CASE WHEN v = 3 THEN 1 ELSE v END) AS updated_at,
       CASE WHEN v = 0 THEN 'c' WHEN v = 2 THEN CASE WHEN {key} % 20 = 19 THEN 'D' ELSE 'd' END ELSE 'u' END AS op,
       {key} * 4 + v AS log_offset
FROM {name}_rows CROSS JOIN (VALUES (0), (1), (2), (3)) AS versions(v)
WHERE v = 0 OR (v = 1 AND {key} % 3 = 0) OR (v = 2 AND {key} % 10 = 9) OR (v = 3 AND {key} % 20 = 0)"""
    CTES[f"{name}_cur"] = f"""
SELECT * EXCLUDE (rn, v, op, log_offset), updated_at AS source_last_change_ts
FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY updated_at DESC, log_offset DESC) AS rn FROM {name}_cdc)
WHERE rn = 1 AND lower(op) <> 'd'"""


def dim_base(key: str) -> str:
    return f"(TIMESTAMP '2023-01-01' + to_days(CAST({key} % 365 AS INTEGER)))"


CTES["places"] = "SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"
add_log(
    "sales_rep",
    "sales_rep_id",
    """SELECT s_suppkey AS sales_rep_id, 'Rep ' || s_name AS rep_name, 'team-' || (s_suppkey % 5) AS team_name,
       r_name AS region, 'manager-' || (s_suppkey % 3) AS manager_name, 'active' AS status
FROM supplier LEFT JOIN places ON s_nationkey = n_nationkey""",
    dim_base("sales_rep_id"),
    "status",
)
add_log(
    "customer",
    "customer_id",
    """SELECT c_custkey AS customer_id, c_name AS first_name, c_mktsegment AS last_name,
       CASE WHEN c_custkey % 50 = 1 THEN 'no-at-sign'
            WHEN c_custkey % 50 <> 0 THEN lower(c_mktsegment) || '.' || c_custkey || '@example.com' END AS email,
       '555-' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone,
       n_name AS city, r_name AS state, lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS zip_code,
       CASE WHEN c_acctbal < 0 THEN 'dormant' ELSE 'active' END AS status
FROM customer LEFT JOIN places ON c_nationkey = n_nationkey""",
    dim_base("customer_id"),
    "status",
)
add_log(
    "advertiser",
    "advertiser_id",
    """SELECT s_suppkey AS advertiser_id, s_name AS advertiser_name, 'industry-' || (s_suppkey % 7) AS industry,
       CASE WHEN s_acctbal >= 6000 THEN 'enterprise' WHEN s_acctbal >= 2000 THEN 'mid_market' ELSE 'small' END AS account_tier,
       r_name AS region, s_suppkey - s_suppkey % 2 AS owner_sales_rep_id, 'active' AS status
FROM supplier LEFT JOIN places ON s_nationkey = n_nationkey""",
    dim_base("advertiser_id"),
    "status",
)
PRICE = "CAST(round(p_retailprice * 100) AS BIGINT)"
add_log(
    "product",
    "product_id",
    f"""SELECT p_partkey AS product_id, 'SKU-' || p_partkey AS sku, p_name AS product_name, p_brand AS brand,
       p_type AS category, 'size-' || p_size AS subcategory, {cents(PRICE)} AS list_price,
       {cents(f"({PRICE} * 6) // 10")} AS cost, p_partkey % 7 <> 0 AS active_flag
FROM part""",
    dim_base("product_id"),
)
add_log(
    "campaign",
    "campaign_id",
    f"""SELECT campaign_id, s_suppkey AS advertiser_id, s_name || '-' || j AS campaign_name,
       {one_of("campaign_id", "search", "display", "video")} AS campaign_type,
       {one_of("campaign_id", "reach", "traffic")} AS objective,
       {cents("(campaign_id % 40 * 250 + 1000) * 100", "DECIMAL(14,2)")} AS budget_amount, start_date,
       CASE WHEN campaign_id % 11 = 0 THEN NULL WHEN campaign_id % 26 = 13 THEN start_date - 2
            ELSE start_date + CAST(campaign_id % 15 + 5 AS INTEGER) END AS end_date,
       {one_of("campaign_id", "active", "paused")} AS status
FROM (SELECT *, s_suppkey * 2 + j AS campaign_id, DATE '2024-01-01' + CAST((s_suppkey * 2 + j) * 3 % 20 AS INTEGER) AS start_date
      FROM supplier CROSS JOIN (VALUES (0), (1)) AS pair(j))""",
    dim_base("campaign_id"),
)
add_log(
    "campaign_product",
    "campaign_product_id",
    f"""SELECT p_partkey AS campaign_product_id, p_partkey // 10 AS campaign_id, p_partkey % 100 AS product_id,
       {cents("p_size * 100 + 25", "DECIMAL(10,2)")} AS bid_amount, CAST(p_size % 5 AS INTEGER) AS priority
FROM part""",
    dim_base("campaign_product_id"),
)
add_log(
    "customer_session",
    "session_id",
    f"""SELECT session_id, customer_id, first_ts AS session_start_ts,
       CASE WHEN session_id % 13 = 0 THEN NULL WHEN session_id % 19 = 0 THEN first_ts - INTERVAL 1 MINUTE ELSE last_ts END AS session_end_ts,
       {one_of("session_id", "mobile", "desktop", "tablet")} AS device_type,
       CASE WHEN session_id % 17 <> 0 THEN {one_of("session_id", "email", "organic", "paid_search", "social")} END AS channel,
       {one_of("session_id", "direct", "partner")} AS referrer_type
FROM (SELECT CAST(user_id AS BIGINT) AS customer_id, user_id * 100 + day(ts) AS session_id, min(ts) AS first_ts, max(ts) AS last_ts
      FROM events GROUP BY 1, 2)""",
    "date_trunc('second', session_start_ts)",
)
TOTAL = "CAST(round(o_totalprice * 100) AS BIGINT)"
add_log(
    "order_header",
    "order_id",
    f"""SELECT o_orderkey AS order_id, o_custkey AS customer_id,
       TIMESTAMP '2023-09-01' + to_days(CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) % 210 AS INTEGER)) + to_minutes(o_orderkey * 7 % 1440) AS order_ts,
       o_orderstatus AS order_status, {cents(TOTAL)} AS subtotal_amount, {cents("0")} AS discount_amount,
       {cents(f"CASE WHEN o_orderkey % 97 = 0 THEN -100 ELSE ({TOTAL} * 8) // 100 END")} AS tax_amount,
       {cents(TOTAL)} AS total_amount, {one_of("o_orderkey", "card", "paypal", "gift_card")} AS payment_type
FROM orders""",
    "order_ts",
)
add_log(
    "sales_activity",
    "sales_activity_id",
    f"""SELECT o_orderkey AS sales_activity_id, o_custkey // 15 AS advertiser_id, o_custkey // 15 AS sales_rep_id,
       TIMESTAMP '2023-09-01' + to_days(CAST((date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) * 5 + 17) % 210 AS INTEGER)) + to_minutes(o_orderkey * 11 % 1440) AS activity_ts,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'call' WHEN '2-HIGH' THEN 'meeting' ELSE 'email' END AS activity_type,
       {one_of("o_orderkey", "positive", "neutral")} AS activity_outcome, 'call ' || o_orderkey AS notes
FROM orders""",
    "activity_ts",
)
EXTENDED = "CAST(round(l_extendedprice * 100) AS BIGINT)"
CTES["order_item_cdc"] = f"""
SELECT l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id, l_partkey % 100 AS product_id,
       CAST(l_quantity AS INTEGER) AS quantity, {cents(f"{EXTENDED} // CAST(l_quantity AS BIGINT)")} AS unit_price,
       {cents(f"({EXTENDED} // CAST(l_quantity AS BIGINT)) * CAST(l_quantity AS BIGINT) + CASE WHEN l_tax = 0.08 THEN 100 ELSE 0 END")} AS line_amount,
       CASE WHEN l_returnflag <> 'R' THEN l_suppkey * 2 + l_linenumber % 2 END AS attributed_campaign_id,
       l_shipdate AS created_at, l_shipdate AS updated_at, CASE WHEN l_suppkey % 25 = 7 THEN 'd' ELSE 'u' END AS op,
       l_shipdate + to_seconds(l_suppkey) AS ingest_ts, l_partkey * 1000000 + {EXTENDED} % 1000000 AS log_offset
FROM lineitem"""
CTES["order_item_cur"] = """
SELECT * EXCLUDE (rn, op, ingest_ts, log_offset), updated_at AS source_last_change_ts
FROM (SELECT *, row_number() OVER (PARTITION BY order_item_id ORDER BY updated_at DESC, ingest_ts DESC, log_offset DESC) AS rn
      FROM order_item_cdc)
WHERE rn = 1 AND op <> 'd'"""
CTES["event_rows"] = """
SELECT event_id, CAST(user_id AS BIGINT) AS customer_id, ts AS event_ts, CAST(ts AS DATE) AS event_date, copy,
       user_id * 100 + day(ts) AS session_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       (user_id * 2 // 3) * 2 + event_id % 2 AS campaign,
       CASE event_type WHEN 'view' THEN CASE WHEN event_id % 2 = 1 THEN 'product_view' ELSE 'ad_impression' END
            WHEN 'click' THEN 'ad_click' WHEN 'signup' THEN 'checkout_start' WHEN 'purchase' THEN 'add_to_cart'
            ELSE event_type END AS kind
FROM events CROSS JOIN (VALUES (0), (1)) AS copies(copy)
WHERE copy = 0 OR event_id % 20 = 0"""
CTES["event_bronze"] = f"""
SELECT 'evt-' || event_id AS event_uuid, event_id, session_id, customer_id, event_ts, event_date, kind AS event_type,
       CASE WHEN kind <> 'ad_impression' THEN k END AS product_id,
       CASE WHEN kind IN ('ad_impression', 'ad_click') OR (kind = 'product_view' AND event_id % 3 = 0) THEN campaign END AS campaign_id,
       {one_of("event_id", "home", "search", "product")} AS page_type,
       CASE WHEN event_id % 5 = 0 THEN 'k' || k END AS search_term, event_id % 10 + copy AS position_in_list,
       event_ts + to_minutes(event_id % 120 + copy * 60) AS ingest_ts, 'v1' AS producer_version, 1 AS schema_version,
       event_id * 2 + copy AS source_offset, event_id % 8 AS source_partition
FROM event_rows"""
TYPES = "('product_view', 'ad_impression', 'ad_click', 'add_to_cart', 'checkout_start')"
CTES["event_latest"] = """
SELECT * EXCLUDE (rn, event_id, source_offset, source_partition)
FROM (SELECT *, row_number() OVER (PARTITION BY event_uuid ORDER BY ingest_ts DESC, source_offset DESC) AS rn FROM event_bronze)
WHERE rn = 1"""
CTES["ev"] = f"SELECT * FROM event_latest WHERE event_type IN {TYPES}"
CTES["ses"] = "SELECT * FROM customer_session_cur WHERE session_end_ts IS NULL OR session_start_ts <= session_end_ts"
CTES["oh"] = """
SELECT * FROM order_header_cur
WHERE subtotal_amount >= 0 AND discount_amount >= 0 AND tax_amount >= 0 AND total_amount >= 0"""
CTES["oi"] = "SELECT * FROM order_item_cur WHERE quantity > 0 AND abs(line_amount - quantity * unit_price) <= 0.01"
CTES["act"] = "SELECT * EXCLUDE (notes) FROM sales_activity_cur"
CTES["cust"] = """
SELECT customer_id, substr(first_name, 1, 1) || '***' AS first_name_masked, substr(last_name, 1, 1) || '***' AS last_name_masked,
       CASE WHEN email IS NULL THEN NULL WHEN contains(email, '@') THEN substr(email, 1, 1) || '***@' || split_part(email, '@', 2)
            ELSE '***' END AS email_masked,
       '***-***-' || right(phone, 4) AS phone_masked, city, state, substr(zip_code, 1, 2) || '***' AS zip_code_masked, status,
       created_at, updated_at, source_last_change_ts
FROM customer_cur"""

# Daily metrics.
CTES["customer_day"] = """
SELECT coalesce(e.metric_date, o.metric_date) AS metric_date, coalesce(e.customer_id, o.customer_id) AS customer_id,
       coalesce(views, 0) AS views, coalesce(ad_clicks, 0) AS ad_clicks, coalesce(add_to_cart, 0) AS add_to_cart,
       coalesce(checkout_starts, 0) AS checkout_starts, coalesce(purchases, 0) AS purchases,
       coalesce(order_amount, 0) AS order_amount, coalesce(avg_order_value, 0) AS avg_order_value
FROM (SELECT event_date AS metric_date, customer_id, count(*) FILTER (event_type = 'product_view') AS views,
             count(*) FILTER (event_type = 'ad_click') AS ad_clicks, count(*) FILTER (event_type = 'add_to_cart') AS add_to_cart,
             count(*) FILTER (event_type = 'checkout_start') AS checkout_starts
      FROM ev GROUP BY 1, 2) AS e
FULL OUTER JOIN (SELECT CAST(order_ts AS DATE) AS metric_date, customer_id, count(DISTINCT order_id) AS purchases,
                        CAST(sum(total_amount) AS DECIMAL(18,2)) AS order_amount,
                        CAST(sum(total_amount) AS DOUBLE) / count(total_amount) AS avg_order_value
                 FROM oh GROUP BY 1, 2) AS o
ON e.metric_date = o.metric_date AND e.customer_id = o.customer_id"""
CTES["item_day"] = "SELECT oi.*, CAST(order_ts AS DATE) AS metric_date FROM oi JOIN oh USING (order_id)"
CTES["item_day"] = """
SELECT oi.order_id, oi.product_id, oi.line_amount, oi.attributed_campaign_id, CAST(oh.order_ts AS DATE) AS metric_date
FROM oi JOIN oh ON oi.order_id = oh.order_id"""
CTES["product_day"] = """
SELECT coalesce(e.metric_date, o.metric_date) AS metric_date, coalesce(e.product_id, o.product_id) AS product_id,
       coalesce(product_views, 0) AS product_views, coalesce(add_to_cart, 0) AS add_to_cart,
       coalesce(attributed_orders, 0) AS attributed_orders, coalesce(attributed_revenue, 0) AS attributed_revenue
FROM (SELECT event_date AS metric_date, product_id, count(*) FILTER (event_type = 'product_view') AS product_views,
             count(*) FILTER (event_type = 'add_to_cart') AS add_to_cart
      FROM ev WHERE product_id IS NOT NULL GROUP BY 1, 2) AS e
FULL OUTER JOIN (SELECT metric_date, product_id, count(DISTINCT order_id) AS attributed_orders,
                        CAST(sum(line_amount) AS DECIMAL(18,2)) AS attributed_revenue
                 FROM item_day GROUP BY 1, 2) AS o
ON e.metric_date = o.metric_date AND e.product_id = o.product_id"""
CTES["campaign_events"] = """
SELECT event_date AS metric_date, campaign_id, count(*) FILTER (event_type = 'ad_impression') AS impressions,
       count(*) FILTER (event_type = 'ad_click') AS clicks
FROM ev WHERE campaign_id IS NOT NULL GROUP BY 1, 2"""
CTES["campaign_sales"] = """
SELECT metric_date, attributed_campaign_id AS campaign_id, count(DISTINCT order_id) AS attributed_orders,
       CAST(sum(line_amount) AS DECIMAL(18,2)) AS attributed_revenue
FROM item_day WHERE attributed_campaign_id IS NOT NULL GROUP BY 1, 2"""
CTES["campaign_contacts"] = """
SELECT CAST(activity_ts AS DATE) AS metric_date, c.campaign_id, count(DISTINCT sales_activity_id) AS sales_contacts
FROM act LEFT JOIN campaign_cur AS c ON act.advertiser_id = c.advertiser_id GROUP BY 1, 2"""


def campaign_day(spine: str) -> str:
    return f"""
SELECT s.metric_date, s.campaign_id, c.advertiser_id, coalesce(impressions, 0) AS impressions, coalesce(clicks, 0) AS clicks,
       coalesce(attributed_orders, 0) AS attributed_orders,
       CAST(coalesce(attributed_revenue, 0) AS DECIMAL(18,2)) AS attributed_revenue, coalesce(sales_contacts, 0) AS sales_contacts
FROM ({spine}) AS s
LEFT JOIN campaign_events AS e ON s.metric_date = e.metric_date AND s.campaign_id = e.campaign_id
LEFT JOIN campaign_cur AS c ON s.campaign_id = c.campaign_id
LEFT JOIN campaign_sales AS o ON s.metric_date = o.metric_date AND s.campaign_id = o.campaign_id
LEFT JOIN campaign_contacts AS k ON s.metric_date = k.metric_date AND s.campaign_id = k.campaign_id"""


CTES["campaign_day"] = campaign_day("SELECT metric_date, campaign_id FROM campaign_events")
CTES["campaign_day_all"] = campaign_day(
    "SELECT metric_date, campaign_id FROM campaign_events UNION SELECT metric_date, campaign_id FROM campaign_sales "
    "UNION SELECT metric_date, campaign_id FROM campaign_contacts WHERE campaign_id IS NOT NULL"
)


def advertiser_day(days: str, spine: str) -> str:
    return f"""
SELECT s.metric_date, s.advertiser_id, coalesce(impressions, 0) AS impressions, coalesce(clicks, 0) AS clicks,
       coalesce(attributed_orders, 0) AS attributed_orders, coalesce(attributed_revenue, 0) AS attributed_revenue,
       coalesce(sales_contacts, 0) AS sales_contacts, coalesce(active_campaigns, 0) AS active_campaigns
FROM ({spine}) AS s
LEFT JOIN (SELECT metric_date, advertiser_id, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks,
                  CAST(sum(attributed_orders) AS BIGINT) AS attributed_orders,
                  CAST(sum(attributed_revenue) AS DECIMAL(18,2)) AS attributed_revenue
           FROM {days} GROUP BY 1, 2) AS d
  ON s.metric_date = d.metric_date AND s.advertiser_id IS NOT DISTINCT FROM d.advertiser_id
LEFT JOIN (SELECT CAST(activity_ts AS DATE) AS metric_date, advertiser_id, count(DISTINCT sales_activity_id) AS sales_contacts
           FROM act GROUP BY 1, 2) AS k
  ON s.metric_date = k.metric_date AND s.advertiser_id = k.advertiser_id
LEFT JOIN (SELECT p.metric_date, p.advertiser_id, count(DISTINCT c.campaign_id) AS active_campaigns
           FROM ({spine}) AS p JOIN campaign_cur AS c ON p.advertiser_id = c.advertiser_id AND p.metric_date >= c.start_date
            AND (c.end_date IS NULL OR p.metric_date <= c.end_date)
           GROUP BY 1, 2) AS r
  ON s.metric_date = r.metric_date AND s.advertiser_id = r.advertiser_id"""


CTES["advertiser_day"] = advertiser_day("campaign_day", "SELECT DISTINCT metric_date, advertiser_id FROM campaign_day")
CTES["metric_days"] = """
SELECT metric_date, advertiser_id FROM campaign_day UNION SELECT CAST(activity_ts AS DATE), advertiser_id FROM act"""
CTES["advertiser_day_all"] = advertiser_day(
    "campaign_day_all",
    "SELECT metric_date, advertiser_id FROM campaign_day_all UNION SELECT CAST(activity_ts AS DATE), advertiser_id FROM act",
)

# Gold.
CTES["dim_customer"] = f"""
SELECT {token("k.customer_id")} AS customer_token, first_name_masked, last_name_masked, email_masked, phone_masked, city, state,
       zip_code_masked, status AS customer_status, created_at, updated_at, source_last_change_ts
FROM (SELECT customer_id FROM cust UNION SELECT customer_id FROM ses WHERE customer_id IS NOT NULL
      UNION SELECT customer_id FROM ev WHERE customer_id IS NOT NULL) AS k
LEFT JOIN cust AS c ON k.customer_id = c.customer_id"""
CTES["dim_date"] = """
SELECT date_day, year(date_day) AS calendar_year, quarter(date_day) AS calendar_quarter, month(date_day) AS calendar_month,
       day(date_day) AS day_of_month, week(date_day) AS week_of_year, strftime(date_day, '%a') AS day_name
FROM (SELECT metric_date AS date_day FROM customer_day UNION SELECT metric_date FROM campaign_day
      UNION SELECT metric_date FROM advertiser_day UNION SELECT CAST(order_ts AS DATE) FROM oh
      UNION SELECT event_date FROM ev UNION SELECT CAST(activity_ts AS DATE) FROM act)
WHERE date_day IS NOT NULL"""
CTES["fct_events"] = f"""
SELECT event_uuid, event_date, event_ts, e.session_id, {token("e.customer_id")} AS customer_token, product_id, campaign_id, event_type,
       page_type, search_term, position_in_list, device_type, channel, referrer_type, producer_version, schema_version, ingest_ts
FROM ev AS e LEFT JOIN ses AS s ON e.session_id = s.session_id"""
CTES["fct_orders"] = f"""
SELECT order_id, {token("customer_id")} AS customer_token, CAST(order_ts AS DATE) AS order_date, order_ts, order_status, payment_type,
       subtotal_amount, discount_amount, tax_amount, total_amount, created_at, updated_at, source_last_change_ts
FROM oh"""
CTES["fct_items"] = f"""
SELECT oi.order_item_id, oi.order_id, CAST(order_ts AS DATE) AS order_date, order_ts, {token("oh.customer_id")} AS customer_token,
       oi.product_id, oi.attributed_campaign_id AS campaign_id, oi.quantity, oi.unit_price, oi.line_amount, oh.order_status,
       oh.payment_type, oi.created_at, oi.updated_at, oi.source_last_change_ts
FROM oi JOIN oh ON oi.order_id = oh.order_id"""
CTES["mart_campaign"] = f"""
SELECT f.metric_date, f.campaign_id, f.advertiser_id, impressions, clicks, {ratio("least(clicks, impressions)", "impressions")} AS ctr,
       attributed_orders, attributed_revenue, sales_contacts, budget_amount, status AS campaign_status
FROM campaign_day AS f LEFT JOIN campaign_cur AS c ON f.campaign_id = c.campaign_id"""
CTES["mart_advertiser"] = f"""
SELECT f.metric_date, f.advertiser_id, advertiser_name, industry, account_tier, a.region, owner_sales_rep_id,
       rep_name AS owner_sales_rep_name, active_campaigns, sales_contacts, impressions, clicks,
       {ratio("least(clicks, impressions)", "impressions")} AS ctr, attributed_orders, attributed_revenue,
       {ratio("attributed_revenue", "sales_contacts")} AS revenue_per_sales_contact
FROM advertiser_day AS f LEFT JOIN advertiser_cur AS a ON f.advertiser_id = a.advertiser_id
LEFT JOIN sales_rep_cur AS r ON a.owner_sales_rep_id = r.sales_rep_id
WHERE f.advertiser_id IS NOT NULL"""
CTES["mart_conversion"] = f"""
SELECT m.metric_date, {token("m.customer_id")} AS customer_token, customer_status, city, state, views, ad_clicks, add_to_cart,
       checkout_starts, purchases, order_amount, avg_order_value, {ratio("purchases", "views")} AS view_to_purchase_rate,
       {ratio("purchases", "ad_clicks")} AS click_to_purchase_rate, {ratio("purchases", "add_to_cart")} AS cart_to_purchase_rate
FROM customer_day AS m LEFT JOIN dim_customer AS c ON {token("m.customer_id")} = c.customer_token"""

# BI.
CTES["funnel_day"] = """
SELECT metric_date, CAST(sum(views) AS BIGINT) AS views, CAST(sum(ad_clicks) AS BIGINT) AS ad_clicks,
       CAST(sum(add_to_cart) AS BIGINT) AS add_to_cart, CAST(sum(checkout_starts) AS BIGINT) AS checkout_starts,
       CAST(sum(purchases) AS BIGINT) AS purchases
FROM mart_conversion GROUP BY 1"""
CTES["funnel"] = " UNION ALL ".join(
    f"SELECT metric_date, '{stage}' AS stage_name, {stage} AS stage_total FROM funnel_day"
    for stage in ("views", "ad_clicks", "add_to_cart", "checkout_starts", "purchases")
)
CTES["contribution"] = """
SELECT i.order_date AS metric_date, coalesce(ch.channel, 'unknown') AS channel, dp.category, i.product_id, dp.product_name,
       count(DISTINCT i.order_id) AS orders, CAST(sum(i.quantity) AS BIGINT) AS quantity_sold,
       CAST(sum(i.line_amount) AS DECIMAL(18,2)) AS revenue, count(DISTINCT i.customer_token) AS purchasing_customers,
       CAST(coalesce(sum(pv.product_views), 0) AS BIGINT) AS product_views
FROM fct_items AS i
JOIN product_cur AS dp ON i.product_id = dp.product_id
LEFT JOIN (SELECT order_id, channel FROM (
             SELECT oi.order_id, e.channel, row_number() OVER (PARTITION BY oi.order_id ORDER BY
                      CASE WHEN e.product_id = oi.product_id THEN 0 ELSE 1 END,
                      date_diff('day', e.event_date, oi.order_date) ASC NULLS LAST, e.event_ts DESC NULLS LAST,
                      e.event_uuid DESC NULLS LAST) AS channel_rank
             FROM fct_items AS oi LEFT JOIN fct_events AS e
               ON e.customer_token = oi.customer_token AND e.event_date <= oi.order_date AND e.event_date >= oi.order_date - 14
              AND (e.product_id = oi.product_id OR e.product_id IS NULL) AND e.channel IS NOT NULL)
           WHERE channel_rank = 1) AS ch ON i.order_id = ch.order_id
LEFT JOIN (SELECT event_date AS metric_date, customer_token, product_id, count(*) AS product_views
           FROM fct_events WHERE event_type = 'product_view' AND product_id IS NOT NULL GROUP BY 1, 2, 3) AS pv
  ON i.order_date = pv.metric_date AND i.customer_token = pv.customer_token AND i.product_id = pv.product_id
GROUP BY 1, 2, 3, 4, 5"""

# Features: the plain self-join form.
MEAN_90D = f"CASE WHEN orders_90d > 0 THEN {mean4('amount_90d', 'orders_90d')} ELSE 0.0 END"
CTES["order_stats"] = """
SELECT d.customer_id, d.metric_date AS as_of_date,
       count(o.order_id) FILTER (date_diff('day', CAST(o.order_ts AS DATE), d.metric_date) BETWEEN 0 AND 29) AS purchases_30d,
       sum(o.total_amount) FILTER (date_diff('day', CAST(o.order_ts AS DATE), d.metric_date) BETWEEN 0 AND 89) AS amount_90d,
       count(o.total_amount) FILTER (date_diff('day', CAST(o.order_ts AS DATE), d.metric_date) BETWEEN 0 AND 89) AS orders_90d,
       coalesce(date_diff('day', max(CAST(o.order_ts AS DATE)) FILTER (CAST(o.order_ts AS DATE) <= d.metric_date), d.metric_date), 9999)
         AS days_since_last_purchase,
       coalesce(max(CASE WHEN CAST(o.order_ts AS DATE) > d.metric_date AND CAST(o.order_ts AS DATE) <= d.metric_date + 7 THEN 1 ELSE 0 END), 0)
         AS label_value
FROM customer_day AS d LEFT JOIN oh AS o ON d.customer_id = o.customer_id GROUP BY 1, 2"""


def trailing(table: str, key: str, column: str, days: int, outer: str = "s", agg: str = "sum") -> str:
    return (
        f"(SELECT {agg}(d.{column}) FROM {table} AS d WHERE d.{key} = {outer}.{key} "
        f"AND date_diff('day', d.metric_date, {outer}.metric_date) BETWEEN 0 AND {days - 1})"
    )


def pit(table: str, key: str, sums: dict[str, tuple[str, int]], extra: str = "") -> str:
    cases = ", ".join(
        f"sum(CASE WHEN date_diff('day', d.metric_date, s.metric_date) BETWEEN 0 AND {days - 1} THEN d.{column} ELSE 0 END) AS {name}"
        for name, (column, days) in sums.items()
    )
    return f"SELECT s.metric_date, s.{key}, {cases}{extra} FROM {table} AS s JOIN {table} AS d ON s.{key} = d.{key} GROUP BY 1, 2"


CTES["customer_week"] = pit(
    "customer_day", "customer_id", {"views_7d": ("views", 7), "ad_clicks_7d": ("ad_clicks", 7), "add_to_cart_7d": ("add_to_cart", 7)}
)
CTES["feat_customer"] = f"""
SELECT s.as_of_date, {token("s.customer_id")} AS customer_token, CAST(views_7d AS BIGINT) AS views_7d,
       CAST(ad_clicks_7d AS BIGINT) AS ad_clicks_7d, CAST(add_to_cart_7d AS BIGINT) AS add_to_cart_7d, purchases_30d,
       {MEAN_90D} AS avg_order_value_90d, days_since_last_purchase, 'customer' AS feature_group,
       'customer_purchase_features_v1' AS feature_definition_version, 'customer_purchase_next_7d' AS label_name, label_value
FROM order_stats AS s JOIN customer_week AS w ON s.customer_id = w.customer_id AND s.as_of_date = w.metric_date"""
CTES["feat_rowframe"] = f"""
SELECT d.metric_date AS as_of_date, {token("d.customer_id")} AS customer_token,
       CAST(sum(purchases) OVER w AS BIGINT) AS purchases_30d,
       {mean4("sum(order_amount) OVER w", "count(order_amount) OVER w")} AS avg_order_value_30d,
       s.label_value AS customer_purchase_next_7d, 'customer_purchase_features_v1' AS feature_version
FROM customer_day AS d JOIN order_stats AS s ON d.customer_id = s.customer_id AND d.metric_date = s.as_of_date
WINDOW w AS (PARTITION BY d.customer_id ORDER BY d.metric_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""
CTES["parity"] = """
SELECT e.customer_id, as_of_ts,
       count(DISTINCT event_uuid) FILTER (event_type = 'product_view' AND event_ts >= as_of_ts - INTERVAL 1 HOUR) AS views_1h,
       count(DISTINCT event_uuid) FILTER (event_type = 'product_view' AND event_ts >= as_of_ts - INTERVAL 24 HOUR) AS views_24h,
       count(DISTINCT event_uuid) FILTER (event_type = 'ad_click' AND event_ts >= as_of_ts - INTERVAL 24 HOUR) AS ad_clicks_24h,
       count(DISTINCT event_uuid) FILTER (event_type = 'add_to_cart' AND event_ts >= as_of_ts - INTERVAL 24 HOUR) AS add_to_cart_24h,
       max(event_ts) AS last_event_ts, 'customer_realtime_features_v1' AS feature_version, as_of_ts AS updated_at,
       86400 AS ttl_seconds
FROM ev AS e JOIN (SELECT customer_id, max(event_ts) AS as_of_ts FROM ev
                   WHERE event_type IN ('product_view', 'ad_click', 'add_to_cart') GROUP BY 1) AS a ON e.customer_id = a.customer_id
WHERE event_type IN ('product_view', 'ad_click', 'add_to_cart')
GROUP BY e.customer_id, as_of_ts"""
CTES["feat_realtime"] = f"""
SELECT s.as_of_date, CAST(s.customer_id AS BIGINT) AS customer_id,
       coalesce(p.views_1h, CASE WHEN d.views > 0 THEN 1 ELSE 0 END) AS views_1h, coalesce(p.views_24h, d.views) AS views_24h,
       coalesce(p.ad_clicks_24h, d.ad_clicks) AS ad_clicks_24h, coalesce(p.add_to_cart_24h, d.add_to_cart) AS add_to_cart_24h,
       purchases_30d, {MEAN_90D} AS avg_order_value_90d, days_since_last_purchase,
       coalesce(p.feature_version, 'customer_realtime_features_v1') AS online_feature_version, p.last_event_ts,
       coalesce(p.ttl_seconds, 0) AS ttl_seconds, 'customer_realtime' AS feature_group,
       'customer_purchase_realtime_features_v1' AS feature_definition_version, 'customer_purchase_next_7d' AS label_name, label_value
FROM order_stats AS s JOIN customer_day AS d ON s.customer_id = d.customer_id AND s.as_of_date = d.metric_date
LEFT JOIN parity AS p ON s.customer_id = p.customer_id AND CAST(p.as_of_ts AS DATE) <= s.as_of_date"""
CTES["campaign_window"] = pit(
    "campaign_day",
    "campaign_id",
    {
        "impressions_7d": ("impressions", 7),
        "clicks_7d": ("clicks", 7),
        "attributed_orders_30d": ("attributed_orders", 30),
        "attributed_revenue_30d": ("attributed_revenue", 30),
    },
    """, any_value(s.advertiser_id) AS advertiser_id, max(CASE WHEN d.metric_date > s.metric_date AND d.metric_date <= s.metric_date + 7
       AND (d.attributed_orders > 0 OR coalesce(CAST(d.clicks AS DOUBLE) / nullif(CAST(d.impressions AS DOUBLE), 0.0), 0.0) >= 0.02)
       THEN 1 ELSE 0 END) AS label_value""",
)
CTES["feat_campaign"] = """
SELECT metric_date AS as_of_date, campaign_id AS entity_id, advertiser_id, CAST(impressions_7d AS BIGINT) AS impressions_7d,
       CAST(clicks_7d AS BIGINT) AS clicks_7d,
       coalesce(CAST(clicks_7d AS DOUBLE) / nullif(CAST(impressions_7d AS DOUBLE), 0.0), 0.0) AS ctr_7d,
       CAST(attributed_orders_30d AS BIGINT) AS attributed_orders_30d, CAST(attributed_revenue_30d AS DOUBLE) AS attributed_revenue_30d,
       'campaign' AS feature_group, 'campaign_success_features_v1' AS feature_definition_version, 'campaign_success_flag' AS label_name,
       label_value
FROM campaign_window"""
CTES["advertiser_known"] = "SELECT * FROM advertiser_day WHERE advertiser_id IS NOT NULL"
CTES["advertiser_window"] = pit(
    "advertiser_known",
    "advertiser_id",
    {
        "sales_contacts_14d": ("sales_contacts", 14),
        "impressions_7d": ("impressions", 7),
        "clicks_7d": ("clicks", 7),
        "attributed_revenue_30d": ("attributed_revenue", 30),
    },
    """, max(CASE WHEN date_diff('day', d.metric_date, s.metric_date) BETWEEN 0 AND 29 THEN d.active_campaigns ELSE 0 END) AS active_campaigns_30d,
       CAST(coalesce(max(CASE WHEN d.metric_date > s.metric_date AND d.metric_date <= s.metric_date + 30 THEN d.active_campaigns * 1000 END), 0) AS DOUBLE)
       - coalesce(max(CASE WHEN d.metric_date <= s.metric_date THEN d.active_campaigns * 1000 END), 0) AS budget_delta_30d""",
)
CTES["feat_advertiser"] = """
SELECT metric_date AS as_of_date, advertiser_id AS entity_id, CAST(active_campaigns_30d AS BIGINT) AS active_campaigns_30d,
       CAST(sales_contacts_14d AS BIGINT) AS sales_contacts_14d, CAST(budget_delta_30d AS DOUBLE) AS budget_delta_30d,
       CAST(impressions_7d AS BIGINT) AS impressions_7d, CAST(clicks_7d AS BIGINT) AS clicks_7d,
       CAST(attributed_revenue_30d AS DOUBLE) AS attributed_revenue_30d, 'advertiser' AS feature_group,
       'advertiser_budget_features_v1' AS feature_definition_version, 'advertiser_budget_increase_next_30d' AS label_name,
       CASE WHEN budget_delta_30d > 0 THEN 1 ELSE 0 END AS label_value
FROM advertiser_window"""


def with_ctes(select: str) -> str:
    """The statement with every CTE it needs in front, in definition order."""
    needed: set[str] = set()
    texts = [select]
    while texts:
        text = texts.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+\(?{name}\b", text):
                needed.add(name)
                texts.append(CTES[name])
    listed = ",\n".join(f"{name} AS ({CTES[name]})" for name in CTES if name in needed)
    return f"WITH {listed}\n{select}" if listed else select


def shaped(
    cte: str,
    days: str = "",
    times: str = "",
    decimals: str = "",
    columns: str = "*",
    tail: str = "",
) -> str:
    """Select over a CTE with dates, timestamps and decimals made portable."""
    replaced = [f"CAST({name} AS VARCHAR) AS {name}" for name in days.split()]
    replaced += [f"epoch_us({name}) AS {name}" for name in times.split()]
    replaced += [f"CAST({name} AS DOUBLE) AS {name}" for name in decimals.split()]
    inner = f"(SELECT {columns} FROM {cte} {tail})"
    return f"SELECT *{' REPLACE (' + ', '.join(replaced) + ')' if replaced else ''} FROM {inner}"


AUDIT = "created_at updated_at source_last_change_ts"
GOVERNED = "*, 'platform_admin' AS data_owner, 'confidential' AS sensitivity_class"
AD = "*, 'ad_platform' AS data_owner, 'confidential' AS sensitivity_class"
ORDER_MONEY = "subtotal_amount discount_amount tax_amount total_amount"
FACT_ORDER = {"days": "order_date", "times": f"order_ts {AUDIT}"}


def dimension(name: str, status: str | None, decimals: str = "", days: str = "") -> str:
    columns = f"* EXCLUDE (status), status AS {status}" if status else "*"
    return shaped(f"{name}_cur", days=days, times=AUDIT, decimals=decimals, columns=columns)


QUERIES: dict[str, str] = {
    "silver_sales_rep": shaped("sales_rep_cur", times=AUDIT, columns=GOVERNED),
    "silver_customer": shaped(
        "cust", times=AUDIT, columns="*, 'commerce_platform' AS data_owner, 'restricted' AS sensitivity_class"
    ),
    "silver_advertiser": shaped("advertiser_cur", times=AUDIT, columns=AD),
    "silver_product": shaped("product_cur", times=AUDIT, decimals="list_price cost", columns=GOVERNED),
    "silver_campaign": shaped("campaign_cur", days="start_date end_date", times=AUDIT, decimals="budget_amount", columns=AD),
    "silver_campaign_product": shaped("campaign_product_cur", times=AUDIT, decimals="bid_amount", columns=GOVERNED),
    "silver_session": shaped("ses", times=f"session_start_ts session_end_ts {AUDIT}"),
    "silver_session_event": shaped("ev", days="event_date", times="event_ts ingest_ts"),
    "silver_order_header": shaped("oh", times=f"order_ts {AUDIT}", decimals=ORDER_MONEY),
    "silver_order_item": shaped("oi", times=AUDIT, decimals="unit_price line_amount"),
    "silver_sales_activity": shaped("act", times=f"activity_ts {AUDIT}"),
    "customer_daily": shaped("customer_day", days="metric_date", decimals="order_amount"),
    "product_daily": shaped("product_day", days="metric_date", decimals="attributed_revenue"),
    "campaign_daily": shaped("campaign_day", days="metric_date", decimals="attributed_revenue"),
    "campaign_daily_complete": shaped("campaign_day_all", days="metric_date", decimals="attributed_revenue"),
    "advertiser_daily": shaped("advertiser_day", days="metric_date", decimals="attributed_revenue"),
    "advertiser_daily_complete": shaped("advertiser_day_all", days="metric_date", decimals="attributed_revenue"),
    "active_campaigns_range_join": """
SELECT CAST(p.metric_date AS VARCHAR) AS metric_date, p.advertiser_id, count(DISTINCT c.campaign_id) AS active_campaigns
FROM metric_days AS p LEFT JOIN campaign_cur AS c ON p.advertiser_id = c.advertiser_id AND p.metric_date >= c.start_date
 AND (c.end_date IS NULL OR p.metric_date <= c.end_date) GROUP BY 1, 2""",
    "dim_customer": shaped("dim_customer", times=AUDIT),
    "dim_product": dimension("product", None, "list_price cost"),
    "dim_advertiser": dimension("advertiser", "advertiser_status"),
    "dim_sales_rep": dimension("sales_rep", "sales_rep_status"),
    "dim_campaign": dimension("campaign", "campaign_status", "budget_amount", "start_date end_date"),
    "dim_date": shaped("dim_date", days="date_day"),
    "fct_session_events": shaped("fct_events", days="event_date", times="event_ts ingest_ts"),
    "fct_orders": shaped("fct_orders", **FACT_ORDER, decimals=ORDER_MONEY),
    "fct_order_items": shaped("fct_items", **FACT_ORDER, decimals="unit_price line_amount"),
    "fct_sales_activity": shaped(
        "act", days="activity_date", times=f"activity_ts {AUDIT}", columns="*, CAST(activity_ts AS DATE) AS activity_date"
    ),
    "fct_campaign_daily": shaped("campaign_day", days="metric_date", decimals="attributed_revenue"),
    "fct_advertiser_daily": shaped("advertiser_known", days="metric_date", decimals="attributed_revenue"),
    "mart_campaign": shaped("mart_campaign", days="metric_date", decimals="attributed_revenue budget_amount"),
    "mart_advertiser": shaped("mart_advertiser", days="metric_date", decimals="attributed_revenue"),
    "mart_conversion": shaped("mart_conversion", days="metric_date", decimals="order_amount"),
    "semantic_campaign": shaped(
        "mart_campaign",
        days="report_date",
        decimals="attributed_revenue budget_amount",
        columns="* EXCLUDE (metric_date, ctr), metric_date AS report_date, ctr AS click_through_rate",
    ),
    "semantic_advertiser": shaped(
        "mart_advertiser",
        days="report_date",
        decimals="attributed_revenue",
        columns="* EXCLUDE (metric_date, ctr, owner_sales_rep_id), metric_date AS report_date, ctr AS click_through_rate",
    ),
    "semantic_conversion": shaped(
        "mart_conversion",
        days="report_date",
        decimals="order_amount",
        columns="* EXCLUDE (metric_date), metric_date AS report_date",
    ),
    "bi_campaign_trend": """
SELECT CAST(metric_date AS VARCHAR) AS metric_date, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks,
       CAST(sum(attributed_orders) AS BIGINT) AS attributed_orders, CAST(sum(attributed_revenue) AS DOUBLE) AS attributed_revenue
FROM mart_campaign GROUP BY 1""",
    "bi_advertiser_effectiveness": shaped(
        "mart_advertiser",
        days="metric_date",
        decimals="attributed_revenue",
        columns="metric_date, advertiser_name, account_tier, active_campaigns, sales_contacts, attributed_revenue, revenue_per_sales_contact",
    ),
    "bi_funnel_long": shaped("funnel", days="metric_date"),
    "bi_channel_contribution": shaped("contribution", days="metric_date", decimals="revenue"),
    "chart_campaign_trend": """
SELECT CAST(metric_date AS VARCHAR) AS metric_date, CAST(sum(impressions) AS BIGINT) AS total_impressions,
       CAST(sum(clicks) AS BIGINT) AS total_clicks, CAST(sum(attributed_revenue) AS DOUBLE) AS total_revenue
FROM mart_campaign GROUP BY 1 ORDER BY 1""",
    "chart_campaign_leaderboard": """
SELECT campaign_id, advertiser_id, campaign_status, CAST(sum(attributed_revenue) AS DOUBLE) AS total_revenue,
       CAST(sum(attributed_orders) AS BIGINT) AS total_orders, round(avg(ctr), 6) AS avg_ctr
FROM mart_campaign GROUP BY 1, 2, 3
ORDER BY sum(attributed_revenue) DESC NULLS LAST, campaign_id, advertiser_id NULLS LAST, campaign_status NULLS LAST LIMIT 20""",
    "chart_advertiser_revenue_contacts": """
SELECT CAST(metric_date AS VARCHAR) AS metric_date, CAST(sum(attributed_revenue) AS DOUBLE) AS total_revenue,
       CAST(sum(sales_contacts) AS BIGINT) AS total_sales_contacts
FROM mart_advertiser GROUP BY 1 ORDER BY 1""",
    "chart_advertiser_tier": """
SELECT advertiser_name, account_tier, owner_sales_rep_name, CAST(sum(attributed_revenue) AS DOUBLE) AS total_revenue,
       CAST(sum(sales_contacts) AS BIGINT) AS total_sales_contacts, round(avg(revenue_per_sales_contact), 4) AS avg_revenue_per_sales_contact,
       round(avg(ctr), 6) AS avg_ctr
FROM mart_advertiser GROUP BY 1, 2, 3
ORDER BY sum(attributed_revenue) DESC NULLS LAST, advertiser_name NULLS LAST, account_tier NULLS LAST, owner_sales_rep_name NULLS LAST LIMIT 25""",
    "chart_customer_funnel_stage": """
SELECT CAST(metric_date AS VARCHAR) AS metric_date, stage_name, CAST(sum(stage_total) AS BIGINT) AS stage_total
FROM funnel GROUP BY 1, 2 ORDER BY 1, 2""",
    "chart_customer_conversion_rates": """
SELECT CAST(metric_date AS VARCHAR) AS metric_date, state, CAST(sum(views) AS BIGINT) AS total_views,
       CAST(sum(ad_clicks) AS BIGINT) AS total_clicks, CAST(sum(add_to_cart) AS BIGINT) AS total_add_to_cart,
       CAST(sum(checkout_starts) AS BIGINT) AS total_checkout_starts, CAST(sum(purchases) AS BIGINT) AS total_purchases,
       CAST(sum(order_amount) AS DOUBLE) AS total_order_amount
FROM mart_conversion GROUP BY 1, 2
ORDER BY sum(views) DESC NULLS LAST, metric_date, state NULLS LAST LIMIT 50""",
    "chart_category_revenue": """
SELECT CAST(metric_date AS VARCHAR) AS metric_date, category, CAST(sum(revenue) AS DOUBLE) AS total_revenue
FROM contribution GROUP BY 1, 2 ORDER BY 1, 2""",
    "chart_category_orders": """
SELECT CAST(metric_date AS VARCHAR) AS metric_date, category, CAST(sum(orders) AS BIGINT) AS total_orders
FROM contribution GROUP BY 1, 2 ORDER BY 1, 2""",
    "chart_product_channel": """
SELECT channel, category, product_name, CAST(sum(orders) AS BIGINT) AS total_orders,
       CAST(sum(quantity_sold) AS BIGINT) AS total_quantity_sold, CAST(sum(revenue) AS DOUBLE) AS total_revenue,
       CAST(sum(product_views) AS BIGINT) AS total_product_views
FROM contribution GROUP BY 1, 2, 3 ORDER BY sum(orders) DESC, channel, category, product_name LIMIT 25""",
    "feat_customer_pit": shaped("feat_customer", days="as_of_date"),
    "feat_customer_rowframe": shaped("feat_rowframe", days="as_of_date"),
    "feat_customer_realtime": shaped("feat_realtime", days="as_of_date", times="last_event_ts"),
    "feat_campaign": shaped("feat_campaign", days="as_of_date"),
    "feat_advertiser": shaped("feat_advertiser", days="as_of_date"),
    "parity_offline": shaped("parity", times="as_of_ts last_event_ts updated_at"),
}


MESSAGE = """
SELECT customer_id, email, status, updated_at, lower(op) AS op, epoch_ms(updated_at) AS source_ts_ms, log_offset AS source_offset,
       FALSE AS is_tombstone FROM customer_cdc
UNION ALL
SELECT customer_id, NULL, NULL, NULL, 't', NULL, log_offset + 1, TRUE FROM customer_cdc WHERE lower(op) = 'd'"""
CTES["campaign_scored"] = """
SELECT *, round(1.0 / (1.0 + exp(-(0.25 + 0.4 * (impressions_7d - 2.0) / 1.5 + 0.7 * (clicks_7d - 4.0) / 2.0
       + -0.2 * (ctr_7d - 1.5) / 2.5 + 0.9 * (attributed_orders_30d - 8.0) / 4.0))), 6) AS p
FROM feat_campaign"""
CTES["drift_categories"] = """
SELECT event_date >= DATE '2024-01-16' AS late, unnest([
  {'column_name': 'event_type', 'category': event_type}, {'column_name': 'page_type', 'category': page_type},
  {'column_name': 'product_id', 'category': CASE WHEN product_id IS NULL THEN 'null' WHEN product_id <= 9 THEN 'b0'
     WHEN product_id <= 24 THEN 'b1' WHEN product_id <= 49 THEN 'b2' WHEN product_id <= 74 THEN 'b3' ELSE 'b4' END}], recursive := true)
FROM ev"""
CTES["drift_shares"] = """
SELECT column_name, greatest(count(*) FILTER (NOT late) / CAST(sum(count(*) FILTER (NOT late)) OVER (PARTITION BY column_name) AS DOUBLE), 1e-6) AS r,
       greatest(count(*) FILTER (late) / CAST(sum(count(*) FILTER (late)) OVER (PARTITION BY column_name) AS DOUBLE), 1e-6) AS c
FROM drift_categories GROUP BY column_name, category"""

BAD_EVENT = f"event_type NOT IN {TYPES}"
BAD_ORDER = "subtotal_amount < 0 OR discount_amount < 0 OR tax_amount < 0 OR total_amount < 0"
BAD_ITEM = "quantity <= 0 OR abs(line_amount - quantity * unit_price) > 0.01"
BAD_SESSION = "session_end_ts IS NOT NULL AND session_start_ts > session_end_ts"
BAD_CAMPAIGN = "end_date IS NOT NULL AND start_date > end_date"
BROKEN = (
    ("session_event", "event_latest", "event_type_enum", BAD_EVENT, "event_uuid"),
    ("order_header", "order_header_cur", "non_negative_amounts", BAD_ORDER, "order_id"),
    ("order_item", "order_item_cur", "line_amount_consistency", BAD_ITEM, "order_item_id"),
    ("customer_session", "customer_session_cur", "session_window", BAD_SESSION, "session_id"),
    ("campaign", "campaign_cur", "campaign_dates", BAD_CAMPAIGN, "campaign_id"),
)
KEYED = {
    "sales_rep": ("sales_rep_cur", "sales_rep_id"),
    "customer": ("cust", "customer_id"),
    "advertiser": ("advertiser_cur", "advertiser_id"),
    "product": ("product_cur", "product_id"),
    "campaign": ("campaign_cur", "campaign_id"),
    "campaign_product": ("campaign_product_cur", "campaign_product_id"),
}


def union_all(parts) -> str:
    return "\nUNION ALL ".join(parts)


def failures(dataset: str, rule: str, table: str, condition: str) -> str:
    return f"SELECT '{dataset}' AS dataset, '{rule}' AS rule_name, count(*) AS failures FROM {table} WHERE {condition}"


def latest(table: str, entity: str, columns: str) -> str:
    return shaped(
        f"(SELECT *, row_number() OVER (PARTITION BY {entity} ORDER BY as_of_date DESC) AS rn FROM {table})",
        days="as_of_date",
        columns=columns,
        tail="WHERE rn = 1",
    )


def split(table: str, entity: str, percent: int) -> str:
    return f"""
SELECT CAST(as_of_date AS VARCHAR) AS as_of_date, {entity},
       CASE WHEN row_number() OVER (ORDER BY as_of_date, {entity}) <= count(*) OVER () * {percent} // 100 THEN 'train' ELSE 'test' END AS side
FROM {table}"""


QUERIES |= {
    "latest_cdc_customer": """
SELECT CAST(customer_id AS VARCHAR) AS record_key, op, epoch_ms(updated_at) AS source_ts_ms, log_offset AS source_offset,
       customer_id AS payload_customer_id, status AS payload_status
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY updated_at DESC, log_offset DESC) AS rn FROM customer_cdc)
WHERE rn = 1 AND lower(op) <> 'd'""",
    "latest_event": """
SELECT event_uuid, event_type, position_in_list, source_offset, epoch_us(ingest_ts) AS ingest_ts
FROM (SELECT *, row_number() OVER (PARTITION BY event_uuid ORDER BY ingest_ts DESC, source_offset DESC) AS rn FROM event_bronze)
WHERE rn = 1""",
    "bronze_candidates": """
SELECT CAST(campaign_id AS VARCHAR) AS record_key, op, log_offset AS source_offset, advertiser_id AS payload_advertiser_id
FROM campaign_cdc WHERE lower(op) <> 'd'""",
    "bronze_valid_events": f"SELECT event_uuid, event_type, source_offset FROM event_bronze WHERE event_type IN {TYPES}",
    "change_envelope_flatten": f"""
SELECT CAST(customer_id AS VARCHAR) AS record_key, op, source_ts_ms, source_offset, CASE WHEN is_tombstone THEN 1 ELSE 3 END AS schema_version,
       CASE WHEN NOT is_tombstone THEN CAST(source_offset AS VARCHAR) END AS transaction_id, is_tombstone,
       CASE WHEN NOT is_tombstone THEN customer_id END AS payload_customer_id, email AS payload_email, status AS payload_status,
       epoch_us(updated_at) AS payload_updated_at
FROM ({MESSAGE})""",
    "change_envelope_current": "SELECT customer_id, email, status, epoch_us(updated_at) AS updated_at FROM customer_cur",
    "change_envelope_dead": """
SELECT 'bronze_customer_cdc-' || customer_id % 8 || '-' || log_offset AS dead_letter_key, log_offset AS source_offset,
       CASE customer_id % 50 WHEN 1 THEN 'malformed json' WHEN 2 THEN 'no operation' WHEN 3 THEN 'unknown operation'
            WHEN 4 THEN 'no row image' ELSE 'no key' END AS reason
FROM customer_cdc WHERE customer_id % 50 BETWEEN 1 AND 5""",
    "change_envelope_valid": """
SELECT customer_id, email, status, epoch_us(updated_at) AS updated_at FROM customer_cur WHERE customer_id % 50 NOT BETWEEN 1 AND 5""",
    "masked_customer": "SELECT * EXCLUDE (created_at, updated_at, source_last_change_ts) FROM cust",
    "tokenized_customer": f"""
SELECT {token("customer_id")} AS customer_token, {token("email")} AS email_token, {token("phone")} AS phone_token, status
FROM customer_cur""",
    "dq_keys": union_all(
        f"""SELECT 'silver.{name}_current' AS dataset, 'primary_key_not_null' AS rule_name, count(*) FILTER ({key} IS NULL) AS failures FROM {table}
UNION ALL SELECT 'silver.{name}_current', 'business_key_uniqueness', count(*) - count(DISTINCT {key}) FROM {table}"""
        for name, (table, key) in KEYED.items()
    ),
    "dq_duplicates": "SELECT order_item_id, count(*) AS row_count FROM order_item_cdc GROUP BY 1 HAVING count(*) > 1",
    "dq_rule_violations": union_all(
        f"SELECT '{rule}' AS rule_name, 'critical' AS severity, count(*) AS failures FROM {table} WHERE {condition}"
        for _, table, rule, condition, _ in BROKEN
    ),
    "dq_violating_rows": union_all(
        f"SELECT '{dataset}' AS dataset, CAST({key} AS VARCHAR) AS row_key FROM {table} WHERE {condition}"
        for dataset, table, _, condition, key in BROKEN
    ),
    "dq_quarantine_orders": f"""
SELECT order_id, CAST(tax_amount AS DOUBLE) AS tax_amount, 'non_negative_amounts' AS reasons FROM order_header_cur WHERE {BAD_ORDER}""",
    "dq_relationships_anti": """
SELECT event_uuid, campaign_id FROM ev
WHERE campaign_id IS NOT NULL AND campaign_id NOT IN (SELECT campaign_id FROM campaign_cur)""",
    "dq_generic_tests": union_all(
        [
            failures("mart_campaign_performance", "not_null:metric_date", "mart_campaign", "metric_date IS NULL"),
            failures("mart_campaign_performance", "not_null:campaign_id", "mart_campaign", "campaign_id IS NULL"),
            failures("mart_campaign_performance", "ratio:ctr", "mart_campaign", "ctr < 0 OR ctr > 1"),
            failures("mart_campaign_performance", "non_negative:attributed_revenue", "mart_campaign", "attributed_revenue < 0"),
            failures("mart_customer_conversion", "not_null:customer_token", "mart_conversion", "customer_token IS NULL"),
            failures("mart_customer_conversion", "non_negative:purchases", "mart_conversion", "purchases < 0"),
            *[
                failures("mart_customer_conversion", f"ratio:{rate}", "mart_conversion", f"{rate} < 0 OR {rate} > 1")
                for rate in ("view_to_purchase_rate", "click_to_purchase_rate", "cart_to_purchase_rate")
            ],
            failures("dim_customer", "not_null:customer_token", "dim_customer", "customer_token IS NULL"),
            "SELECT 'dim_customer', 'unique:customer_token', count(*) FROM "
            "(SELECT customer_token FROM dim_customer GROUP BY 1 HAVING count(*) > 1)",
            failures(
                "dim_campaign",
                "relationships:advertiser_id",
                "campaign_cur",
                "advertiser_id NOT IN (SELECT advertiser_id FROM advertiser_cur)",
            ),
            failures(
                "fct_orders",
                "relationships:customer_token",
                "fct_orders",
                "customer_token NOT IN (SELECT customer_token FROM dim_customer)",
            ),
        ]
    ),
    "dq_control_totals": """
SELECT a.orders, CAST(a.total_amount AS DOUBLE) AS total_amount, b.orders AS expected_orders, CAST(b.total_amount AS DOUBLE) AS expected_total_amount
FROM (SELECT count(order_id) AS orders, sum(total_amount) AS total_amount FROM oh) AS a
CROSS JOIN (SELECT count(order_id) AS orders, sum(total_amount) AS total_amount FROM order_header_cur) AS b
WHERE a.orders <> b.orders OR a.total_amount <> b.total_amount""",
    "dq_reconcile_marts": union_all(
        f"""SELECT x.a, CAST(x.b AS DOUBLE) AS b, y.a AS expected_a, CAST(y.b AS DOUBLE) AS expected_b
FROM (SELECT CAST(sum({first[1]}) AS BIGINT) AS a, sum({first[2]}) AS b FROM {first[0]}) AS x
CROSS JOIN (SELECT CAST(sum({second[1]}) AS BIGINT) AS a, sum({second[2]}) AS b FROM {second[0]}) AS y WHERE x.a <> y.a OR x.b <> y.b"""
        for first, second in (
            (("mart_campaign", "attributed_orders", "attributed_revenue"), ("campaign_day", "attributed_orders", "attributed_revenue")),
            (("mart_conversion", "purchases", "order_amount"), ("oh", "CASE WHEN order_id IS NOT NULL THEN 1 END", "total_amount")),
        )
    ),
    "dq_volume": union_all(
        f"SELECT 'silver.{name}_daily_metrics' AS dataset, 'volume_baseline' AS rule_name, count(*) AS row_count, count(*) >= 1 AS passed FROM {name}_day"
        for name in ("customer", "product", "campaign", "advertiser")
    ),
    "dq_table_counts": union_all(
        f"SELECT '{dataset}' AS dataset, count(*) AS row_count, count(*) >= 1 AS passed FROM {table}"
        for dataset, table in (
            *[
                (f"bronze.{name}", f"{name}_cdc")
                for name in (
                    "sales_rep",
                    "customer",
                    "advertiser",
                    "product",
                    "campaign",
                    "campaign_product",
                    "customer_session",
                    "order_header",
                    "order_item",
                    "sales_activity",
                )
            ],
            ("bronze.session_event", "event_bronze"),
            ("silver.customer_current", "cust"),
            ("silver.session_event_clean", "ev"),
            ("silver.order_header", "oh"),
            ("gold.dim_customer", "dim_customer"),
            ("gold.fct_session_events", "fct_events"),
            ("gold.fct_orders", "fct_orders"),
            ("gold.mart_customer_conversion", "mart_conversion"),
            ("gold.mart_campaign_performance", "mart_campaign"),
            ("silver.customer_daily_metrics", "customer_day"),
            ("silver.customer_purchase_features_v1", "feat_customer"),
            ("silver.customer_purchase_realtime_features_v1", "feat_realtime"),
            ("silver.campaign_success_features_v1", "feat_campaign"),
            ("silver.advertiser_budget_features_v1", "feat_advertiser"),
        )
    ),
    "dq_drift_psi": """
SELECT column_name, round(sum((c - r) * ln(c / r)), 9) AS psi, sum((c - r) * ln(c / r)) < 0.2 AS passed FROM drift_shares GROUP BY 1""",
    "dq_reconcile_layers": """
SELECT CAST(metric_date AS VARCHAR) AS metric_date, coalesce(bronze_rows, 0) AS bronze_rows, coalesce(silver_rows, 0) AS silver_rows,
       coalesce(gold_rows, 0) AS gold_rows, coalesce(bronze_rows, 0) - coalesce(gold_rows, 0) AS lost_rows
FROM (SELECT event_date AS metric_date, count(*) AS bronze_rows FROM event_bronze GROUP BY 1)
FULL OUTER JOIN (SELECT event_date AS metric_date, count(*) AS silver_rows FROM ev GROUP BY 1) USING (metric_date)
FULL OUTER JOIN (SELECT event_date AS metric_date, count(*) AS gold_rows FROM fct_events GROUP BY 1) USING (metric_date)""",
    "parity_mismatch": union_all(
        [
            "SELECT customer_id, 'views_24h' AS field, CAST(views_24h AS VARCHAR) AS expected, "
            "CAST(views_24h + 1 AS VARCHAR) AS actual FROM parity WHERE customer_id % 7 = 0 AND customer_id % 11 <> 0",
            *[
                f"SELECT customer_id, '{field}', CAST({field} AS VARCHAR), NULL FROM parity WHERE customer_id % 11 = 0"
                for field in ("views_1h", "views_24h", "ad_clicks_24h", "add_to_cart_24h")
            ],
        ]
    ),
    "latest_customer_features": latest(
        "feat_realtime", "customer_id", "customer_id, as_of_date, purchases_30d, avg_order_value_90d, days_since_last_purchase"
    ),
    "latest_campaign_features": latest("feat_campaign", "entity_id", "entity_id, as_of_date, impressions_7d, ctr_7d"),
    "latest_advertiser_features": latest("feat_advertiser", "entity_id", "entity_id, as_of_date, sales_contacts_14d, clicks_7d"),
    "scoring_payload": """
SELECT f.customer_id, coalesce(p.views_1h, f.views_1h) AS views_1h, coalesce(p.views_24h, f.views_24h) AS views_24h,
       coalesce(p.ad_clicks_24h, f.ad_clicks_24h) AS ad_clicks_24h, coalesce(p.add_to_cart_24h, f.add_to_cart_24h) AS add_to_cart_24h,
       purchases_30d, avg_order_value_90d, days_since_last_purchase
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY as_of_date DESC) AS rn FROM feat_realtime) AS f
LEFT JOIN parity AS p ON f.customer_id = p.customer_id WHERE rn = 1""",
    "online_key": "SELECT 'features:customer:' || customer_id || ':v1' AS online_key, views_24h, ttl_seconds FROM parity",
    "ml_batch_score": """
SELECT 'scores:campaign:' || entity_id || ':success_propensity:v1' AS score_key, entity_id AS campaign_id,
       'campaign_success_propensity' AS score_name, p AS score, epoch_us(TIMESTAMP '2024-02-01') AS scored_at, 'offline' AS feature_source,
       epoch_us(TIMESTAMP '2024-02-01 01:00:00') AS expires_at
FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY as_of_date DESC) AS rn FROM campaign_scored) WHERE rn = 1""",
    "ml_metrics": """
SELECT 0.6 :: DOUBLE AS threshold, tp_tn / n AS accuracy, tp / nullif(pp, 0) AS precision, tp / nullif(pos, 0) AS recall,
       2 * (tp / pp) * (tp / pos) / (tp / pp + tp / pos) AS f1, round(loss / n, 9) AS log_loss, round(squares / n, 9) AS brier_score,
       CAST(n AS BIGINT) AS support, pos / n AS positive_rate
FROM (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER ((p >= 0.6) = (label_value = 1)) AS DOUBLE) AS tp_tn,
             CAST(count(*) FILTER (p >= 0.6 AND label_value = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (p >= 0.6) AS DOUBLE) AS pp,
             CAST(count(*) FILTER (label_value = 1) AS DOUBLE) AS pos,
             sum(-(label_value * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (1 - label_value) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12)))) AS loss,
             sum((label_value - p) * (label_value - p)) AS squares
      FROM campaign_scored)""",
    "ml_auc": """
SELECT round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END, 9) AS roc_auc
FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT p, count(*) FILTER (label_value = 1) AS pos, count(*) FILTER (label_value = 0) AS neg FROM campaign_scored GROUP BY 1))""",
    "split_chronological": split("feat_campaign", "entity_id", 80),
    "split_chronological_tokens": split("feat_customer", "customer_token", 75),
    "model_registry_latest": """
SELECT feature_group, label_name, epoch_us(CAST(as_of_date AS TIMESTAMP)) AS trained_at,
       'manifests/' || feature_group || '/' || as_of_date AS artifact_manifest_uri, train_rows, positives
FROM (SELECT *, row_number() OVER (PARTITION BY feature_group ORDER BY as_of_date DESC) AS rn
      FROM (SELECT feature_group, label_name, as_of_date, count(*) AS train_rows, CAST(sum(label_value) AS BIGINT) AS positives
            FROM (SELECT feature_group, label_name, as_of_date, label_value FROM feat_campaign
                  UNION ALL SELECT feature_group, label_name, as_of_date, label_value FROM feat_advertiser)
            GROUP BY 1, 2, 3))
WHERE rn = 1""",
}


DAMAGED = "event_id % 50 BETWEEN 7 AND 12"
QUERIES |= {
    "stream_valid_events": f"""
SELECT event_uuid, event_id, session_id, customer_id, epoch_us(event_ts) // 1000 * 1000 AS event_ts, event_type, product_id, campaign_id,
       page_type, search_term, position_in_list, epoch_us(ingest_ts) // 1000 * 1000 AS ingest_ts, producer_version, schema_version,
       CAST(event_date AS VARCHAR) AS event_date, source_partition, source_offset
FROM event_bronze WHERE event_type IN {TYPES} AND NOT {DAMAGED}""",
    "stream_dead_letter": f"""
SELECT 'events.session_event-' || source_partition || '-' || source_offset AS dlq_key, 'events.session_event' AS original_topic,
       source_partition, source_offset, 'events.session_event-value' AS schema_subject,
       CASE WHEN event_id % 50 IN (7, 8, 9) THEN NULL WHEN event_id % 50 = 10 THEN 99 WHEN event_id % 50 = 11 THEN 2 ELSE 1 END AS schema_id,
       CASE event_id % 50 WHEN 7 THEN 'null payload' WHEN 8 THEN 'payload too short for Confluent wire format'
            WHEN 9 THEN 'invalid Confluent wire-format magic byte' WHEN 10 THEN 'schema id 99 not found'
            WHEN 11 THEN 'schema id 2 does not match repository session_event contract' WHEN 12 THEN 'deserialization failed'
            ELSE 'invalid event_type: ' || event_type END AS failure_reason
FROM event_bronze WHERE event_type NOT IN {TYPES} OR {DAMAGED}""",
    "stream_dedup": "SELECT DISTINCT event_uuid, customer_id, event_type, epoch_us(event_ts) AS event_ts FROM event_bronze",
    "stream_daily_funnel": """
SELECT CAST(event_date AS VARCHAR) AS metric_date, customer_id, count(*) FILTER (event_type = 'product_view') AS views,
       count(*) FILTER (event_type = 'ad_click') AS ad_clicks, count(*) FILTER (event_type = 'add_to_cart') AS add_to_cart,
       count(*) FILTER (event_type = 'checkout_start') AS checkout_starts
FROM ev GROUP BY 1, 2""",
    "stream_online_features": """
SELECT customer_id, views_1h, views_24h, ad_clicks_24h, add_to_cart_24h, epoch_us(last_event_ts) AS last_event_ts, feature_version,
       ttl_seconds
FROM parity""",
    "stream_current_state": """
SELECT campaign_product_id AS payload_campaign_product_id, campaign_id AS payload_campaign_id, product_id AS payload_product_id,
       CAST(bid_amount AS DOUBLE) AS payload_bid_amount, op, epoch_us(updated_at) AS source_ts
FROM (SELECT *, row_number() OVER (PARTITION BY campaign_product_id ORDER BY updated_at DESC, log_offset DESC) AS rn FROM campaign_product_cdc)
WHERE rn = 1 AND lower(op) <> 'd'""",
}


# Facts with rules: dataset, its change log, the rows before the rules, the rule, what breaks it, the key.
RULED = (
    ("silver.customer_session", "customer_session_cdc", "customer_session_cur", "session_window", BAD_SESSION, "session_id"),
    ("silver.session_event_clean", "event_bronze", "event_latest", "event_type_enum", BAD_EVENT, "event_uuid"),
    ("silver.order_header", "order_header_cdc", "order_header_cur", "non_negative_amounts", BAD_ORDER, "order_id"),
    ("silver.order_item", "order_item_cdc", "order_item_cur", "line_amount_consistency", BAD_ITEM, "order_item_id"),
)
UNRULED = (("silver.sales_rep_current", "sales_rep_cdc", "sales_rep_cur", "sales_rep_id"), ("silver.campaign_current", "campaign_cdc", "campaign_cur", "campaign_id"))
TESTED = {
    "gold.dim_customer": "dim_customer",
    "gold.dim_product": "product_cur",
    "gold.dim_advertiser": "advertiser_cur",
    "gold.dim_sales_rep": "sales_rep_cur",
    "gold.dim_campaign": "campaign_cur",
    "gold.dim_date": "dim_date",
    "gold.fct_session_events": "fct_events",
    "gold.fct_orders": "fct_orders",
    "gold.fct_order_items": "fct_items",
    "gold.fct_sales_activity": "act",
    "gold.fct_campaign_daily": "campaign_day",
    "gold.fct_advertiser_daily": "advertiser_known",
    "gold.mart_campaign_performance": "mart_campaign",
    "gold.mart_advertiser_engagement": "mart_advertiser",
    "gold.mart_customer_conversion": "mart_conversion",
    "silver.session_event_clean": "ev",
    "silver.order_header": "oh",
    "silver.order_item": "oi",
    "silver.campaign_daily_metrics": "campaign_day",
    "silver.customer_purchase_features_v1": "feat_customer",
    "silver.customer_purchase_realtime_features_v1": "feat_realtime",
    "silver.campaign_success_features_v1": "feat_campaign",
    "silver.advertiser_budget_features_v1": "feat_advertiser",
}


def declared(dataset: str, column: str, test: str) -> str:
    """One declared test as SQL."""
    table, (name, *values) = TESTED[dataset], test.split()
    conditions = {
        "not_null": f"{column} IS NULL",
        "non_negative": f"{column} < 0",
        "ratio": f"{column} < 0 OR {column} > 1",
        "accepted_values": f"{column} NOT IN ({', '.join(repr(v) for v in values)})",
    }
    if name == "unique":
        return f"SELECT '{dataset}' AS dataset, 'unique:{column}' AS rule_name, count(*) AS failures FROM (SELECT {column} FROM {table} WHERE {column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"
    if name == "relationships":
        conditions[name] = f"{column} NOT IN (SELECT {values[1]} FROM {TESTED[values[0]]} WHERE {values[1]} IS NOT NULL)"
    return failures(dataset, f"{name}:{column}", table, conditions[name])


def content(left: str, right: str, group: str, name: str, values: str, amount: str) -> str:
    """Two layers per group: rows, amounts, and whether the sums of the row hashes agree."""
    side = "SELECT {1} AS g, count(*) AS n, sum(CAST({2} AS DECIMAL(18,2))) AS a, sum(CAST(('0x' || substr(md5(concat_ws('|', {3})), 1, 15))::BIGINT AS DECIMAL(20,0))) AS h FROM {0} GROUP BY 1"
    text = ", ".join(f"coalesce(CAST({v} AS VARCHAR), '~')" for v in values.split())
    (l_table, l_group), (r_table, r_group) = (left, group.split(" / ")[0]), (right, group.split(" / ")[1])
    return f"""
SELECT CAST(coalesce(l.g, r.g) AS {name.split()[1]}) AS {name.split()[0]}, CAST(coalesce(l.n, 0) AS BIGINT) AS left_rows, CAST(coalesce(r.n, 0) AS BIGINT) AS right_rows,
       CAST(coalesce(l.a, 0) AS DOUBLE) AS left_amount, CAST(coalesce(r.a, 0) AS DOUBLE) AS right_amount,
       coalesce(l.h, 0) = coalesce(r.h, 0) AND coalesce(l.n, 0) = coalesce(r.n, 0) AS same_content
FROM ({side.format(l_table, l_group, amount, text)}) AS l FULL OUTER JOIN ({side.format(r_table, r_group, amount, text)}) AS r ON l.g IS NOT DISTINCT FROM r.g"""


QUERIES |= {
    "quarantine_tables": union_all(
        f"SELECT '{dataset}' AS dataset, CAST({key} AS VARCHAR) AS row_key, '{rule}' AS reasons FROM {table} WHERE {bad}" for dataset, _, table, rule, bad, key in RULED
    ),
    "quarantine_balance": union_all(
        f"SELECT '{dataset}' AS dataset, count(*) AS candidates, count(*) - count(*) FILTER ({bad}) AS clean, count(*) FILTER ({bad}) AS rejected FROM {table}"
        for dataset, _, table, _, bad, _ in RULED
    ),
    "dq_build_results": union_all(
        [
            *[
                f"""SELECT '{dataset}' AS dataset, '{rule}' AS rule_name, 'critical' AS severity, count(*) FILTER ({bad}) = 0 AS passed, count(*) FILTER ({bad}) AS failures, count(*) AS rows FROM {table}
UNION ALL SELECT '{dataset}', 'volume_baseline', 'warning', count(*) FILTER ({bad}) < count(*), CAST(count(*) FILTER ({bad}) = count(*) AS BIGINT), count(*) - count(*) FILTER ({bad}) FROM {table}"""
                for dataset, _, table, rule, bad, _ in RULED
            ],
            *[f"SELECT '{dataset}', 'volume_baseline', 'warning', count(*) > 0, CAST(count(*) = 0 AS BIGINT), count(*) FROM {table}" for dataset, _, table, _ in UNRULED],
            *[
                f"SELECT '{dataset}', 'primary_key_not_null', 'critical', count({key}) = count(*), count(*) - count({key}), count(*) FROM {log}"
                for dataset, log, key in [(r[0], r[1], r[5]) for r in RULED] + [(u[0], u[1], u[3]) for u in UNRULED]
            ],
        ]
    ),
    "dq_declared_tests": union_all(
        declared(dataset, column, test) for dataset, columns in DECLARED_TESTS.items() for column, tests in columns.items() for test in tests
    ),
    "dq_content_orders": content("order_header_cur", "fct_orders", "CAST(order_ts AS DATE) / order_date", "metric_date VARCHAR", "order_id total_amount", "total_amount"),
    "dq_content_items": content("order_item_cur", "fct_items", "product_id / product_id", "product_id BIGINT", "order_item_id quantity line_amount", "line_amount"),
}


def oracle() -> dict[str, str]:
    return {name: with_ctes(text) for name, text in QUERIES.items()}
