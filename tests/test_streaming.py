import json
import random
import struct
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from query_catalog import stream_queries
from tidemark.operators import cdc
from tidemark.plans.features import offline_online_features
from tidemark.plans.metrics import CUSTOMER_FUNNEL
from tidemark.schemas import EVENT_RECORD
from tidemark.sources.sample import SampleBronze
from tidemark.streaming import events as streams
from tidemark.streaming import once, online, tables
from tidemark.streaming.decode import avro_schema, bronze_events, contract_ids, dead_letters, decode_events

T0 = datetime(2024, 1, 1)
EVENT = "event_uuid string, customer_id bigint, event_type string, event_ts timestamp"


def view(uuid, minutes, customer=1, kind="product_view"):
    return (uuid, customer, kind, T0 + timedelta(minutes=minutes))


class Files:
    """A folder that grows by one file per call, read as a stream of one file per batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, str(folder), schema, 0

    def add(self, rows):
        self.n += 1
        frame = self.spark.createDataFrame(rows, self.schema).coalesce(1)
        frame.write.parquet(f"{self.folder}/part={self.n:03d}")

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/*")


def body(values):
    return json.dumps({name: value for name, value in values.items() if value is not None}).encode()


def event(**changes):
    base = {
        "event_uuid": "u-1",
        "event_id": 1,
        "session_id": -5,
        "customer_id": 300,
        "event_ts": 1_704_067_200_123,
        "event_type": "ad_click",
        "campaign_id": 70_000,
        "page_type": "home",
        "ingest_ts": 1_704_067_260_000,
        "producer_version": "v1",
        "schema_version": 1,
    }
    return {**base, **changes}


def framed(body, schema=1, magic=0):
    return bytearray(struct.pack(">bI", magic, schema) + body)


def test_framed_events_and_every_refusal(spark):
    good = body(event())
    payloads = [
        framed(good),
        None,
        bytearray(b"\x00\x01\x02"),
        framed(good, magic=1),
        framed(good, schema=99),
        framed(good, schema=2),
        framed(good[:-3]),
        framed(body(event(customer_id=None))),
        framed(body(event(event_type="purchase"))),
    ]
    rows = [(payload, 3, offset, T0) for offset, payload in enumerate(payloads)]
    raw = spark.createDataFrame(rows, "value binary, partition int, offset bigint, timestamp timestamp")
    decoded = decode_events(raw, {1: True, 2: False}, body="json")
    (kept,) = bronze_events(decoded).collect()
    assert (kept.event_uuid, kept.session_id, kept.customer_id, kept.campaign_id, kept.product_id) == ("u-1", -5, 300, 70_000, None)
    assert kept.event_ts == T0 + timedelta(milliseconds=123) and str(kept.event_date) == "2024-01-01" and kept.source_offset == 0
    reasons = {r.source_offset: r.failure_reason for r in dead_letters(decoded).collect()}
    assert reasons == {
        1: "null payload",
        2: "payload too short for Confluent wire format",
        3: "invalid Confluent wire-format magic byte",
        4: "schema id 99 not found",
        5: "schema id 2 does not match repository session_event contract",
        6: "deserialization failed",
        7: "deserialization failed",
        8: "invalid event_type: purchase",
    }
    keys = {r.dlq_key for r in dead_letters(decoded).collect()}
    assert "events.session_event-3-4" in keys


def test_avro_bodies_need_their_package(spark):
    fields = {field["name"]: field["type"] for field in json.loads(avro_schema())["fields"]}
    assert list(fields) == list(EVENT_RECORD)
    assert (fields["event_ts"], fields["product_id"]) == ("long", ["null", "long"])
    raw = spark.createDataFrame([(framed(b""), 0, 0, T0)], "value binary, partition int, offset bigint, timestamp timestamp")
    with pytest.raises(Exception, match="(?i)avro"):
        decode_events(raw, {1: True}).collect()


def test_contract_ids():
    assert contract_ids({1: {"a": 1, "b": 2}, 2: {"a": 1}}, {"b": 2, "a": 1}) == {1: True, 2: False}


def test_routing_is_exact_after_a_repeated_batch(spark, tmp_path):
    rows = [(framed(body(event(event_uuid=f"u{i}"))) if i % 3 else None, 0, i, T0) for i in range(9)]
    raw = spark.createDataFrame(rows, "value binary, partition int, offset bigint, timestamp timestamp")
    decoded = decode_events(raw, {1: True}, body="json")
    for _ in range(2):
        tables.write_batch(bronze_events(decoded), 7, f"{tmp_path}/bronze", ["event_date"])
        tables.write_batch(dead_letters(decoded), 7, f"{tmp_path}/dead")
    assert tables.read_batches(spark, f"{tmp_path}/bronze").count() == 6
    assert tables.read_batches(spark, f"{tmp_path}/dead").count() == 3


STEPS = [
    ([view("u1", 0)], 1, 1),
    ([view("u2", 30), view("u2", 30)], 2, 2),
    ([view("u3", 90)], 2, 3),
    ([view("u4", 45)], 3, 4),
    ([view("u5", 24 * 60 + 91)], 1, 1),
]


@pytest.mark.parametrize("salts", [1, 3])
def test_trailing_counts_step_by_step_with_restarts(spark, tmp_path, salts):
    files = Files(spark, tmp_path / "in", EVENT)
    for rows, views_1h, views_24h in STEPS:
        files.add(rows)
        query = online.start_online_features(
            files.stream(), f"{tmp_path}/out", f"{tmp_path}/checkpoint", salts=salts, state_partitions=2
        )
        query.awaitTermination(120)
        (row,) = tables.online_records(spark, f"{tmp_path}/out").collect()
        assert (row.views_1h, row.views_24h) == (views_1h, views_24h)
    assert row.last_event_ts == T0 + timedelta(minutes=24 * 60 + 91) and row.ttl_seconds == 86400
    assert tables.online_records(spark, f"{tmp_path}/out", now=row.updated_at + timedelta(days=2)).count() == 0
    folded = tables.compact(spark, f"{tmp_path}/out", f"{tmp_path}/compacted", ["customer_id"])
    assert folded >= 4 and tables.online_records(spark, f"{tmp_path}/compacted").count() == 1


def test_stream_counts_equal_batch_counts(spark, tmp_path, sample_folder):
    clean = cdc.latest_by_event_uuid(SampleBronze(spark, sample_folder).session_event).select(*EVENT.replace(",", "").split()[::2])
    files = Files(spark, tmp_path / "in", EVENT)
    rows = [tuple(row) for row in clean.orderBy("event_ts").collect()]
    for part in range(3):
        files.add(rows[part::3])
    query = online.start_online_features(files.stream(), f"{tmp_path}/out", f"{tmp_path}/checkpoint", state_partitions=2)
    query.awaitTermination(180)
    columns = ["customer_id", "views_1h", "views_24h", "ad_clicks_24h", "add_to_cart_24h", "last_event_ts"]
    streamed = tables.online_records(spark, f"{tmp_path}/out").select(*columns)
    batch = offline_online_features(clean).select(*columns)
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch).count() == 0


def brute_force_counts(rows, kind, seconds):
    """Distinct ids per customer within ``seconds`` of the customer's newest event."""
    used = [row for row in rows if row[1] is not None and row[3] is not None and row[2] != "checkout_start"]
    newest = {}
    for _, customer, _, at in used:
        newest[customer] = max(at, newest.get(customer, at))
    ids = {c: {u for u, customer, k, at in used if customer == c and u and k == kind and at >= newest[c] - timedelta(seconds=seconds)} for c in newest}
    return {c: len(found) for c, found in ids.items()}


def test_online_events_are_a_table_that_forgets(spark, tmp_path):
    files, path = Files(spark, tmp_path / "in", EVENT), f"{tmp_path}/out"
    kinds = ("product_view", "ad_click", "add_to_cart", "checkout_start")
    draw = random.Random(7)
    rows = [view(f"u{n}", draw.randrange(6 * 24 * 60), draw.choice([1, 1, 1, 2, 3, None]), draw.choice(kinds)) for n in range(400)]
    rows += [view(None, 7 * 24 * 60, 2), view("timeless", 0, 4)[:3] + (None,), view("edge", 24 * 60, 5), view("edge2", 48 * 60, 5)]
    rows.sort(key=lambda row: (row[3] or T0) + timedelta(hours=draw.randrange(30)))  # late by up to 30 hours
    parts = [rows[start : start + 81] for start in range(0, len(rows), 81)]
    for number, part in enumerate(parts):
        files.add(part + draw.sample(rows[: 81 * number + 1], min(20, 81 * number + 1)))  # copies of earlier events
        online.start_online_features(files.stream(), path, f"{tmp_path}/checkpoint").awaitTermination(180)
    got = {row.customer_id: row for row in tables.online_records(spark, path).collect()}
    for name, kind, seconds in (("views_1h", "product_view", 3600), ("views_24h", "product_view", 86400), ("ad_clicks_24h", "ad_click", 86400), ("add_to_cart_24h", "add_to_cart", 86400)):
        assert {customer: row[name] for customer, row in got.items()} == brute_force_counts(rows, kind, seconds)
    assert got[2].last_event_ts == T0 + timedelta(days=7) and got[5].views_24h == 2
    kept = tables.read_batches(spark, f"{path}-state")
    assert 0 < kept.count() < len(rows) / 2
    before = [row for row in tables.online_records(spark, path).drop("updated_at", "expires_at").orderBy("customer_id").collect()]
    again = online.online_batch(online.online_features(spark.createDataFrame(parts[-1], EVENT), len(parts) - 1, f"{path}-state"))
    tables.upsert_online(again, len(parts), path)
    assert tables.online_records(spark, path).drop("updated_at", "expires_at").orderBy("customer_id").collect() == before


def test_dedup_and_late_rows(spark, tmp_path):
    files = Files(spark, tmp_path / "in", EVENT)
    files.add([view("a", 0), view("a", 0), view("b", 300)])
    files.add([view("b", 300), view("c", 290), view("z", 400)])
    files.add([view("late", 1)])
    query = tables.start(
        streams.dedup_stream(files.stream()),
        lambda batch, n: tables.write_batch(batch, n, f"{tmp_path}/out"),
        f"{tmp_path}/checkpoint",
        state_partitions=2,
    )
    query.awaitTermination(120)
    got = sorted(r.event_uuid for r in tables.read_batches(spark, f"{tmp_path}/out").collect())
    assert got == ["a", "b", "c", "z"] and tables.late_rows(query) == 1


def test_late_events_are_kept_and_counted_once(spark, tmp_path, monkeypatch):
    columns = f"{EVENT}, ingest_ts timestamp"
    # Each arrival is newer than the one before by ingest time; "late" comes two days behind the watermark.
    arrivals = [
        [view("a", 10), view("b", 20, kind="ad_click")],
        [view("c", 3 * 24 * 60)],
        [view("d", 3 * 24 * 60 + 5)],
        [view("late", 15), view("late", 15), view("a", 10), view("e", 3 * 24 * 60 + 6)],
    ]
    rows = [(*row, T0 + timedelta(days=10, hours=n)) for n, part in enumerate(arrivals) for row in part for _ in range(20)]
    events = spark.createDataFrame(rows, columns)
    monkeypatch.setattr(stream_queries, "event_rows", lambda spark, folder: events)
    once = stream_queries.stream_dedup(spark, "").collect()
    assert sorted(r.event_uuid for r in once) == ["a", "b", "c", "d", "e", "late"]
    days = stream_queries.stream_daily_funnel(spark, "").collect()
    assert sorted((str(r.metric_date), r.views, r.ad_clicks) for r in days) == [("2024-01-01", 2, 1), ("2024-01-04", 3, 0)]


def once_rows(spark, path):
    return sorted(r.event_uuid or "" for r in once.events_once(spark, path, T._parse_datatype_string(EVENT)).collect())


def test_late_rows_are_a_side_output_of_one_write(spark, tmp_path):
    files = Files(spark, tmp_path / "in", EVENT)
    path, schema = f"{tmp_path}/out", T._parse_datatype_string(EVENT)
    for rows in ([view("a", 0), view("b", 300)], [view("b", 300), view("z", 400)], [view("late", 1), view("late", 1), view("a", 0)]):
        files.add(rows)
        once.start_once(files.stream(), path, f"{tmp_path}/checkpoint").awaitTermination(120)
    assert sorted(r.event_uuid for r in once.on_time(spark, path, schema).collect()) == ["a", "b", "z"]
    assert [r.event_uuid for r in once.only_late(spark, path, schema).collect()] == ["late"]
    assert once_rows(spark, path) == ["a", "b", "late", "z"]


def test_once_keeps_nulls_and_repeats_a_batch(spark, tmp_path):
    path = f"{tmp_path}/out"
    batches = [
        [view("a", 0), view("a", 0), view(None, 5), ("no time", 1, "product_view", None)],
        [view("a", 0), view(None, 5), view(None, 6), ("no time", 1, "product_view", None), view("b", 30)],
        [],
        [view("b", 30), view("c", 60)],
    ]
    for number, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, EVENT)
        for _ in range(2):
            written = once.write_once(batch, number, path)
        assert written.columns[-1] == "late"
        assert written.count() == [3, 1, 0, 1][number]
    assert once_rows(spark, path) == ["", "a", "b", "c", "no time"]
    with pytest.raises(ValueError):
        once.write_once(spark.createDataFrame([(1, True)], "event_uuid long, late boolean"), 0, path)


def test_only_open_batches_are_looked_up(spark, tmp_path):
    path = f"{tmp_path}/out"
    for number in range(8):
        rows = [view(f"u{n}", 60 * n) for n in (number, max(number - 1, 0))]
        once.write_once(spark.createDataFrame(rows, EVENT), number, path, delay="90 minutes")
    marks = tables.read_batches(spark, f"{path}-marks").orderBy("batch_id").collect()
    # The newest time is 60 n minutes; batches that end two delays (180 minutes) before it are closed.
    assert [r.first_open for r in marks] == [0, 0, 0, 1, 2, 3, 4, 5]
    assert once_rows(spark, path) == [f"u{n}" for n in range(8)]


def test_daily_funnel_over_batches(spark, tmp_path):
    files = Files(spark, tmp_path / "in", EVENT)
    files.add([view("a", 10), view("b", 20, kind="ad_click")])
    files.add([view("c", 30), view("d", 24 * 60 + 5, customer=2)])
    query = tables.start(
        streams.daily_funnel_stream(files.stream(), ["customer_id"], CUSTOMER_FUNNEL),
        lambda batch, n: tables.write_batch(batch, n, f"{tmp_path}/out"),
        f"{tmp_path}/checkpoint",
        output_mode="update",
        state_partitions=2,
    )
    query.awaitTermination(120)
    got = tables.latest_by_batch(spark, f"{tmp_path}/out", ["metric_date", "customer_id"]).collect()
    assert {(str(r.metric_date), r.customer_id, r.views, r.ad_clicks) for r in got} == {
        ("2024-01-01", 1, 2, 1),
        ("2024-01-02", 2, 1, 0),
    }


def test_incremental_state_equals_batch(spark, tmp_path, sample_folder):
    log = SampleBronze(spark, sample_folder).campaign
    rows = log.orderBy(F.col("_cdc.offset") % 7, "_cdc.offset").collect()
    files = Files(spark, tmp_path / "in", log.schema)
    for part in range(3):
        files.add(rows[part::3])
        query = tables.current_state_stream(files.stream(), "campaign_id", f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        query.awaitTermination(120)
    streamed = tables.current_state(spark, f"{tmp_path}/out", "campaign_id")
    batch = cdc.latest_cdc(log, "campaign_id").select(*streamed.columns)
    assert streamed.count() == batch.count() > 0 and streamed.exceptAll(batch).count() == 0


def test_kafka_needs_its_package(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        tables.kafka_stream(spark, "nowhere:1", "t")



def test_compaction_keeps_the_newest_change_not_the_newest_batch(spark, tmp_path):
    columns = "record_key string, payload_id long, payload_v string, op string, source_ts_ms long, ingest_ts timestamp, source_offset long, source_partition int"
    now = T0
    for batch_id, (value, ms) in enumerate([("new", 20), ("old", 10)]):
        row = [("k", 1, value, "u", ms, now, ms, 0)]
        tables.write_batch(spark.createDataFrame(row, columns), batch_id, f"{tmp_path}/state")
    assert tables.compact_current_state(spark, f"{tmp_path}/state", f"{tmp_path}/folded", "id") == 1
    assert [r.payload_v for r in tables.read_batches(spark, f"{tmp_path}/folded").collect()] == ["new"]
