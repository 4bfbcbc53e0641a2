from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.plans import features

D = date(2026, 1, 1)
DAILY = (
    "metric_date date, customer_id bigint, views bigint, ad_clicks bigint, add_to_cart bigint, checkout_starts bigint, "
    "purchases bigint, order_amount decimal(18,2), avg_order_value double"
)


def day(n):
    return D + timedelta(n - 1)


@pytest.fixture(scope="module")
def daily(spark):
    rows = []
    for i in range(5):
        bought = i == 2
        views = (4, 5, 3, 6, 2)[i]
        carts, starts = (0, 1, 1, 1, 0)[i], (0, 1, 1, 1, 0)[i]
        rows.append((day(i + 1), 101, views, (1, 2, 1, 2, 1)[i], carts, starts, int(bought), Decimal(120 if bought else 0), 120.0 if bought else 0.0))
        rows.append((day(i + 1), 202, (1, 2, 1, 2, 1)[i], int(i == 3), 0, 0, 0, Decimal(0), 0.0))
    return spark.createDataFrame(rows, DAILY)


@pytest.fixture(scope="module")
def orders(spark):
    rows = [
        (5001, 101, datetime(2026, 1, 3, 10, 30), Decimal(120)),
        (5002, 101, datetime(2026, 1, 6, 9, 15), Decimal(80)),
        (5003, 202, datetime(2026, 2, 1, 12), Decimal(45)),
    ]
    return spark.createDataFrame(rows, "order_id bigint, customer_id bigint, order_ts timestamp, total_amount decimal(12,2)")


def test_customer_features(daily, orders):
    rows = features.order_history(daily, orders).collect()
    last = next(r for r in rows if r.customer_id == 101 and r.as_of_date == day(5))
    assert (last.purchases_30d, last.avg_order_value_90d, last.days_since_last_purchase, last.label_value) == (1, 120.0, 2, 1)
    others = {(r.purchases_30d, r.avg_order_value_90d, r.days_since_last_purchase, r.label_value) for r in rows if r.customer_id == 202}
    assert others == {(0, 0.0, 9999, 0)}
    table = features.customer_purchase_features(daily, orders)
    assert table.count() == 10 and "label_value" in table.columns
    assert table.filter(F.col("as_of_date") == day(5)).agg(F.max("views_7d")).first()[0] == 20


def test_row_frame_features(daily, orders):
    row = features.customer_rowframe_features(daily, orders).orderBy(F.desc("purchases_30d"), F.desc("as_of_date")).first()
    assert row.purchases_30d == 1 and row.avg_order_value_30d == 24.0 and row.customer_purchase_next_7d == 1


def test_campaign_features(spark):
    rows = [(day(i + 1), 301, 401, (100, 150, 130)[i], (3, 5, 4)[i], (0, 1, 1)[i], Decimal((0, 75, 50)[i])) for i in range(3)]
    schema = (
        "metric_date date, campaign_id bigint, advertiser_id bigint, impressions bigint, clicks bigint, attributed_orders bigint, "
        "attributed_revenue decimal(18,2)"
    )
    got = features.campaign_features(spark.createDataFrame(rows, schema)).orderBy("as_of_date").collect()
    assert [r.impressions_7d for r in got] == [100, 250, 380] and [r.clicks_7d for r in got] == [3, 8, 12]
    assert [r.attributed_orders_30d for r in got] == [0, 1, 2] and [r.attributed_revenue_30d for r in got] == [0, 75, 125]
    assert [r.label_value for r in got] == [1, 1, 0]


def test_advertiser_features_are_not_multiplied_by_budget_rows(spark):
    rows = [
        (day(i + 1), 401, (2, 2, 3)[i], (1, 2, 1)[i], (100, 150, 180)[i], (3, 5, 6)[i], (0, 1, 1)[i], Decimal((0, 75, 90)[i]))
        for i in range(3)
    ]
    schema = (
        "metric_date date, advertiser_id bigint, active_campaigns bigint, sales_contacts bigint, impressions bigint, clicks bigint, "
        "attributed_orders bigint, attributed_revenue decimal(18,2)"
    )
    budget = spark.createDataFrame(
        [(day(1), 401, Decimal(500)), (day(15), 401, Decimal(650))], "snapshot_date date, advertiser_id bigint, budget_amount decimal(14,2)"
    )
    got = features.advertiser_features(spark.createDataFrame(rows, schema), budget).orderBy("as_of_date").collect()
    assert [r.active_campaigns_30d for r in got] == [2, 2, 3] and [r.sales_contacts_14d for r in got] == [1, 3, 4]
    assert [r.impressions_7d for r in got] == [100, 250, 430] and [r.clicks_7d for r in got] == [3, 8, 14]
    assert [r.attributed_revenue_30d for r in got] == [0, 75, 165]
    assert [r.budget_delta_30d for r in got] == [150, 150, 150] and [r.label_value for r in got] == [1, 1, 1]
    proxy = features.advertiser_features(spark.createDataFrame(rows, schema)).orderBy("as_of_date").collect()
    assert [r.budget_delta_30d for r in proxy] == [1000.0, 1000.0, -3000.0]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    days=st.lists(st.tuples(st.integers(1, 3), st.integers(0, 120)), min_size=1, max_size=25, unique=True),
    bought=st.lists(st.tuples(st.integers(1, 4), st.integers(0, 140), st.integers(1, 500)), max_size=25),
)
def test_windows_equal_the_self_join(spark, days, bought):
    rows = [(D + timedelta(n), key, 1, 0, 0, 0, 0, Decimal(0), 0.0) for key, n in days]
    paid = [(i, key, datetime(2026, 1, 1, 12) + timedelta(n), Decimal(amount)) for i, (key, n, amount) in enumerate(bought)]
    daily = spark.createDataFrame(rows, DAILY)
    orders = spark.createDataFrame(paid, "order_id bigint, customer_id bigint, order_ts timestamp, total_amount decimal(12,2)")
    got = {(r.customer_id, r.as_of_date): r for r in features.order_history(daily, orders).collect()}
    assert len(got) == len(days)
    for key, n in days:
        row = got[key, D + timedelta(n)]
        mine = [(n - m, amount) for k, m, amount in bought if k == key]
        assert row.purchases_30d == sum(0 <= age < 30 for age, _ in mine)
        recent = [amount for age, amount in mine if 0 <= age < 90]
        assert row.avg_order_value_90d == pytest.approx(sum(recent) / len(recent) if recent else 0.0)
        assert row.days_since_last_purchase == min((age for age, _ in mine if age >= 0), default=9999)
        assert row.label_value == int(any(-7 <= age < 0 for age, _ in mine))


def test_snapshot_is_not_used_before_its_day(spark, daily, orders):
    parity = spark.createDataFrame(
        [(101, datetime(2026, 1, 4, 8), 9, 99, 9, 9, "customer_realtime_features_v1", datetime(2026, 1, 4, 8), 86400)],
        "customer_id bigint, as_of_ts timestamp, views_1h bigint, views_24h bigint, ad_clicks_24h bigint, add_to_cart_24h bigint, "
        "feature_version string, last_event_ts timestamp, ttl_seconds int",
    )
    got = features.customer_realtime_features(daily, orders, parity).filter("customer_id = 101").orderBy("as_of_date").collect()
    assert [r.views_24h for r in got] == [4, 5, 3, 99, 99] and [r.views_1h for r in got] == [1, 1, 1, 9, 9]


def test_parity_and_payload(spark):
    schema = (
        "customer_id bigint, views_1h bigint, views_24h bigint, ad_clicks_24h bigint, add_to_cart_24h bigint, "
        "last_event_ts timestamp, updated_at timestamp"
    )
    at = datetime(2026, 1, 5, 18)
    realtime = spark.createDataFrame([(101, 2, 6, 2, 1, at, at)], schema)
    history = spark.createDataFrame(
        [(101, 1, 120.0, 2)], "customer_id bigint, purchases_30d bigint, avg_order_value_90d double, days_since_last_purchase int"
    )
    expected = features.expected_online_records(realtime, history)
    assert features.parity_mismatches(expected, expected).count() == 0
    changed = expected.withColumn("views_1h", F.lit(3).cast("bigint")).withColumn("avg_order_value_90d", F.lit(120.5))
    fields = {r.field: (r.expected, r.actual) for r in features.parity_mismatches(expected, changed).collect()}
    assert fields == {"views_1h": ("2", "3"), "avg_order_value_90d": ("120.0", "120.5")}
    payload = features.scoring_payload(history.withColumn("views_1h", F.lit(7)), realtime).first()
    assert (payload.views_1h, payload.purchases_30d, payload.days_since_last_purchase) == (2, 1, 2)
    alone = features.scoring_payload(history.withColumn("views_1h", F.lit(7)), realtime.filter("false")).first()
    assert (alone.views_1h, alone.views_24h) == (7, 0)


def test_offline_counts_at_a_given_time(spark):
    rows = [("u1", 0), ("u2", 30), ("u3", 90), ("u4", 600)]
    events = spark.createDataFrame(
        [(1, uuid, "product_view", datetime(2024, 1, 1) + timedelta(minutes=m)) for uuid, m in rows],
        "customer_id bigint, event_uuid string, event_type string, event_ts timestamp",
    )
    then = features.offline_online_features(events, as_of=datetime(2024, 1, 1, 1, 30)).first()
    assert (then.views_1h, then.views_24h) == (2, 3)
    now = features.offline_online_features(events).first()
    assert (now.views_1h, now.views_24h) == (1, 4)
