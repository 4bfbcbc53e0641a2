"""Registered streaming queries over the given tables, results read back.

The rows of a table arrive in ``ARRIVALS`` parts, in order of arrival.  After each part the stream is
started from its checkpoint, takes what is new and stops, so every query carries its state, watermark
and tables over several micro-batches and restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import wire
from tidemark.operators.filters import valid_event_types
from tidemark.plans.metrics import CUSTOMER_FUNNEL
from tidemark.schemas import EVENT_COLUMNS
from tidemark.session import shared_dir, tune
from tidemark.sources.sample import campaign_product_log, raw_event_rows
from tidemark.streaming import once, online, tables
from tidemark.streaming.decode import decode_events

# Schema ids of the sample stream: 1 is the contract, 2 some other schema.
SCHEMAS = {1: True, 2: False}


ARRIVALS = 4


def _in_arrivals(rows: DataFrame, order: str, *runs: Callable[[DataFrame], StreamingQuery]) -> None:
    """Write the rows part by part into one folder; after each part run every stream over it."""
    spark = tune(rows.sparkSession)
    root = shared_dir(spark, "arrivals")
    ranges = ARRIVALS * max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // ARRIVALS)
    part = F.floor(F.spark_partition_id() * ARRIVALS / ranges).cast("int")
    rows.repartitionByRange(ranges, order).withColumn("_part", part).write.partitionBy("_part").parquet(f"{root}/all")
    staged = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(f"{root}/all")
    for number in range(ARRIVALS):
        staged.filter(F.col("_part") == number).select(*rows.columns).write.mode("append").parquet(f"{root}/landing")
        for run in runs:
            run(tables.event_stream(spark, f"{root}/landing", rows.schema)).awaitTermination()


def event_rows(spark: SparkSession, folder: str) -> DataFrame:
    return raw_event_rows(tune(spark).read.parquet(f"{folder}/events.parquet"))


def wire_rows(events: DataFrame) -> DataFrame:
    """Events as framed JSON payloads, with every kind of damage at fixed event ids."""
    fields = [
        (F.unix_millis(name) if kind == "timestamp" else F.col(name)).alias(name) for name, kind in EVENT_COLUMNS.items()
    ]
    body = F.to_json(F.struct(*fields)).cast("binary")
    case = F.col("event_id") % 50
    value = (
        F.when(case == 7, F.lit(None).cast("binary"))
        .when(case == 8, F.unhex(F.lit("000102")))
        .when(case == 9, F.concat(F.unhex(F.lit("0100000001")), body))
        .when(case == 10, wire.frame(99, body))
        .when(case == 11, wire.frame(2, body))
        .when(case == 12, wire.frame(1, F.lit("{").cast("binary")))
        .otherwise(wire.frame(1, body))
    )
    return events.select(
        value.alias("value"),
        F.col("source_partition").alias("partition"),
        F.col("source_offset").alias("offset"),
        F.col("ingest_ts").alias("timestamp"),
    )


def _routed(spark: SparkSession, folder: str) -> tuple[str, str]:
    root = shared_dir(spark, "route")

    def run(events: DataFrame) -> StreamingQuery:
        return tables.route(decode_events(wire_rows(events), SCHEMAS, body="json"), f"{root}/bronze", f"{root}/dead", f"{root}/checkpoint")

    _in_arrivals(event_rows(spark, folder), "ingest_ts", run)
    return f"{root}/bronze", f"{root}/dead"


def stream_valid_events(spark: SparkSession, folder: str) -> DataFrame:
    bronze, _ = _routed(spark, folder)
    return tables.read_batches(spark, bronze).select(*EVENT_COLUMNS, "event_date", "source_partition", "source_offset")


def stream_dead_letter(spark: SparkSession, folder: str) -> DataFrame:
    _, dead = _routed(spark, folder)
    return tables.read_batches(spark, dead).select(
        "dlq_key", "original_topic", "source_partition", "source_offset", "schema_subject", "schema_id", "failure_reason"
    )


EVENT_PARTS = ("event_uuid", "customer_id", "event_type", "event_ts")


def _run_once(spark: SparkSession, folder: str, root: str, then: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Keep the events of the table once under root; returns every event, late ones too."""
    rows = event_rows(spark, folder)

    def run(events: DataFrame) -> StreamingQuery:
        return once.start_once(events.select(*EVENT_PARTS), f"{root}/clean", f"{root}/checkpoint", then=then)

    _in_arrivals(rows, "ingest_ts", run)
    return once.events_once(spark, f"{root}/clean", rows.select(*EVENT_PARTS).schema)


def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return _run_once(spark, folder, shared_dir(spark, "dedup"))


def stream_daily_funnel(spark: SparkSession, folder: str) -> DataFrame:
    """One stream: each batch leaves its new events and their counts by day and customer, which add up.

    Events that only came late are counted when the table is read."""
    root = shared_dir(spark, "funnel")
    keys = ["customer_id"]

    def count(events: DataFrame, batch_id: int) -> None:
        parts = once.funnel_counts(valid_event_types(events), keys, CUSTOMER_FUNNEL)
        tables.write_batch(parts, batch_id, f"{root}/counts")

    schema = _run_once(spark, folder, root, count).schema
    late = once.only_late(spark, f"{root}/clean", schema)
    late_counts = once.funnel_counts(valid_event_types(late), keys, CUSTOMER_FUNNEL)
    counted = spark.read.schema(late_counts.schema).parquet(f"{root}/counts").select(*late_counts.columns)
    return once.add_up(counted.unionByName(late_counts), keys, CUSTOMER_FUNNEL)


def stream_online_features(spark: SparkSession, folder: str) -> DataFrame:
    root = shared_dir(spark, "online")

    def run(events: DataFrame) -> StreamingQuery:
        return online.start_online_features(events, f"{root}/table", f"{root}/checkpoint")

    _in_arrivals(event_rows(spark, folder), "ingest_ts", run)
    return tables.online_records(spark, f"{root}/table").drop("updated_at", "expires_at")


def stream_current_state(spark: SparkSession, folder: str) -> DataFrame:
    root = shared_dir(spark, "current")

    def run(changes: DataFrame) -> StreamingQuery:
        return tables.current_state_stream(changes, "campaign_product_id", f"{root}/table", f"{root}/checkpoint")

    changes = campaign_product_log(tune(spark).read.parquet(f"{folder}/part.parquet"))
    _in_arrivals(changes, "_kafka_metadata_timestamp", run)
    current = tables.current_state(spark, f"{root}/table", "campaign_product_id")
    return current.select(
        "payload_campaign_product_id", "payload_campaign_id", "payload_product_id", "payload_bid_amount", "op", "source_ts"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    build.__name__: build
    for build in (
        stream_valid_events,
        stream_dead_letter,
        stream_dedup,
        stream_daily_funnel,
        stream_online_features,
        stream_current_state,
    )
}
