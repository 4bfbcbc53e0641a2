"""Streaming sources, sinks and tables that grow by micro-batch (SRC3, SNK4-SNK6, STR2, STR8, STR9).

Sinks write one folder per micro-batch and replace it when the batch is repeated, so a
restarted query leaves no duplicates.  Keyed tables are levelled (``keyed``) and merged when
they are read: a micro-batch costs what it brings and its share of the folding.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.cdc import PAYLOAD, latest_row, live_rows, normalize_cdc
from tidemark.streaming import keyed
from tidemark.streaming.decode import bronze_events, dead_letters

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UNLOAD = "spark.sql.streaming.stateStore.unloadOnCommit"


def event_stream(
    spark: SparkSession, path: str, schema: Any, files: str | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of Parquet files from the first one on, oldest first (SRC3)."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Stream of raw records from the earliest offset; needs the Kafka package on the cluster (SRC3)."""
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    raw = source.option("subscribe", topic).option("startingOffsets", "earliest").load()
    return raw.select("key", "value", "partition", "offset", "timestamp")


def start(
    stream: DataFrame,
    on_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    interval: str | None = None,
    output_mode: str = "append",
    state_partitions: int | None = None,
) -> StreamingQuery:
    """Start a query that hands micro-batches to ``on_batch`` (STR8).

    Without an interval it takes everything that is there and stops; its state stores then leave
    the executors' disks with each commit, as the next run opens stores of its own.  The checkpoint
    folder makes a restart continue where the last run ended.  The number of state partitions is
    fixed by the first run of a checkpoint.
    """
    spark = stream.sparkSession
    settings = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE, UNLOAD: str(interval is None).lower()}
    if state_partitions:
        settings["spark.sql.shuffle.partitions"] = str(state_partitions)
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        writer = stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).foreachBatch(on_batch)
        writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
        return writer.start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, over the kept progress reports (STR6)."""
    reports = [report for report in query.recentProgress if report]
    return sum(state.get("numRowsDroppedByWatermark", 0) for report in reports for state in report["stateOperators"])


def write_batch(batch: DataFrame, batch_id: int, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write the folder of one micro-batch, replacing an earlier attempt."""
    writer = batch.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all micro-batches with their ``batch_id``; of a keyed table those of its live folders."""
    live = keyed.live_rows(spark, path)
    return spark.read.parquet(path) if live is None else live


def route(decoded: DataFrame, bronze: str, dead: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Valid events to Bronze and refused payloads to the dead-letter table, one scan for both (STR2)."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            write_batch(bronze_events(batch), batch_id, bronze, ["event_date"])
            write_batch(dead_letters(batch), batch_id, dead)
        finally:
            batch.unpersist()

    return start(decoded, on_batch, checkpoint, interval)


def latest_by_batch(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest row per key of a table that is written batch by batch."""
    return latest_row(read_batches(spark, path), [F.col(key) for key in keys], [F.col("batch_id").desc()]).drop("batch_id")


def compact(spark: SparkSession, path: str, target: str, keys: Sequence[str | Column], order: Sequence[Column] = ()) -> int:
    """Fold all batches of a keyed table into one folder of ``target``; returns the last batch folded.

    ``order`` says which row of a key is the newest; by default the one of the last batch.  Later
    batches go to ``target`` as well, their ids are larger.
    """
    batches = read_batches(spark, path)
    last = batches.agg(F.max("batch_id")).first()[0]
    newest = [*order, F.col("batch_id").desc()]
    folded = latest_row(batches, [F.col(key) if isinstance(key, str) else key for key in keys], newest).drop("batch_id")
    write_batch(folded, last, target)
    return last


def compact_current_state(spark: SparkSession, path: str, target: str, business_key: str) -> int:
    """``compact`` for the table of ``current_state_stream``: the newest change of a key stays, whichever batch brought it."""
    key = F.coalesce(F.col("record_key"), F.col(PAYLOAD + business_key).cast("string"))
    return compact(spark, path, target, [key], _change_order())


def upsert_online(records: DataFrame, batch_id: int, path: str, key: str = "customer_id") -> None:
    """Online records of one micro-batch with their expiry, into a keyed table (SNK6)."""
    expires = F.timestamp_seconds(F.unix_seconds("updated_at") + F.col("ttl_seconds"))
    keyed.upsert(records.withColumn("expires_at", expires), batch_id, path, [F.col(key)])


def online_records(spark: SparkSession, path: str, key: str = "customer_id", now: datetime | None = None) -> DataFrame:
    """Current online record per key; with ``now`` only those that have not expired."""
    latest = latest_by_batch(spark, path, [key])
    return latest.filter(F.col("expires_at") > F.lit(now).cast("timestamp")) if now else latest


CHANGE_ORDER = ("source_ts_ms", "ingest_ts", "source_offset")


def _change_order() -> list:
    return [F.col(name).desc_nulls_last() for name in (*CHANGE_ORDER, "source_partition")]


def current_state_stream(
    changes: DataFrame, business_key: str, path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Change log to current state, incrementally (STR9).

    Every micro-batch brings its newest change per key, deletes too, and folds the levels it
    fills; ``current_state`` merges what is live.  The result is that of the batch operator over
    the whole log.
    """
    key = F.coalesce(F.col("record_key"), F.col(PAYLOAD + business_key).cast("string"))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        keyed.upsert(normalize_cdc(batch, business_key), batch_id, path, [key], _change_order())

    return start(changes, on_batch, checkpoint, interval)


def current_state(spark: SparkSession, path: str, business_key: str) -> DataFrame:
    """Current rows of a table kept by ``current_state_stream``."""
    key = F.coalesce(F.col("record_key"), F.col(PAYLOAD + business_key).cast("string"))
    newest = [*_change_order(), F.col("batch_id").desc()]
    return live_rows(latest_row(read_batches(spark, path), [key], newest)).drop("batch_id")
