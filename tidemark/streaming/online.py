"""Per-customer trailing counts of a stream (STR3-STR5, UDF2, D19).

The anchor of a customer's windows is its latest event time so far.  Late events count
while they are inside the longest window; copies of an event carry the same event time
and count once.

What the stream knows is a keyed table of the events inside the longest window (``keyed``),
one row per customer, event and minute.  A micro-batch adds its own events, and every fold
forgets what has left the window, so the table holds one window a customer and folder however
long the stream runs.  The counts of the customers that a batch touches are one grouping over it;
an active customer is spread over a few salts where events meet their anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import policies
from tidemark.operators.cdc import latest_row
from tidemark.streaming import keyed
from tidemark.streaming.tables import start, upsert_online

SLOT_MICROS = 60 * 1_000_000
SALTS = 4


def _event_keys() -> list[Column]:
    """A copy of an event has its customer, its id and its minute."""
    return [F.col("customer_id"), F.col("event_uuid"), F.expr(f"ts - pmod(ts, {SLOT_MICROS})")]


def _first_copy() -> list[Column]:
    """The first batch that brought an event decides.

    Events without id move the anchor and do not count, so the newest of a minute stands for them."""
    return [F.expr("if(event_uuid is null, ts, null)").desc_nulls_last(), F.col("batch_id").asc(), F.col("ts").desc(), F.col("event_type")]


def counted_events(events: DataFrame, definition: Mapping = policies.ONLINE_FEATURES) -> DataFrame:
    """The events that a definition uses; without customer or time an event has no place in a window."""
    key = definition["entity_key"]
    used = F.col("event_type").isin(*definition["event_types"]) & F.col(key).isNotNull() & F.col("event_ts").isNotNull()
    return events.filter(used).select(
        F.col(key).cast("bigint").alias("customer_id"),
        "event_uuid",
        "event_type",
        F.unix_micros(F.col("event_ts").cast("timestamp")).alias("ts"),
        F.current_timestamp().alias("seen_at"),
    )


def _longest(definition: Mapping) -> int:
    return max(entry["window_seconds"] for entry in definition["aggregations"]) * 1_000_000


def _anchors(rows: DataFrame) -> DataFrame:
    return rows.groupBy("customer_id").agg(F.max("ts").alias("anchor"))


def _inside(rows: DataFrame, anchors: DataFrame, longest: int, salts: int) -> DataFrame:
    """Rows of the customers in ``anchors`` that are inside the longest window, with the anchor."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("event_uuid", "ts"), F.lit(salts)).cast("int"))
    copies = anchors.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, ["customer_id", "_salt"]).filter(F.col("ts") >= F.col("anchor") - longest).drop("_salt")


def _remembered(longest: int, salts: int, idle_seconds: int | None) -> Callable[[DataFrame], DataFrame]:
    """What is worth keeping of some events, judged by these alone: newer ones elsewhere only narrow the window."""

    def narrow(rows: DataFrame) -> DataFrame:
        fresh = _not_idle(rows, idle_seconds)
        return _inside(fresh, _anchors(fresh), longest, salts).select(*rows.columns)

    return narrow


def _not_idle(rows: DataFrame, idle_seconds: int | None) -> DataFrame:
    if idle_seconds is None:
        return rows
    return rows.filter(F.unix_micros("seen_at") >= F.unix_micros(F.current_timestamp()) - idle_seconds * 1_000_000)


def online_features(
    batch: DataFrame,
    batch_id: int,
    state: str,
    definition: Mapping = policies.ONLINE_FEATURES,
    salts: int = SALTS,
    expire_idle: bool = False,
) -> DataFrame:
    """Add a micro-batch to the events at ``state``; counts of the customers it touches, a row each.

    A batch that is already there is not added again and gives the same counts.  ``expire_idle`` forgets
    events that came more than twice the lifetime of a record ago, by the clock, so it is for continuous
    queries only.
    """
    longest, idle_seconds = _longest(definition), 2 * definition["ttl_seconds"] if expire_idle else None
    used, narrow = counted_events(batch, definition), _remembered(longest, salts, idle_seconds)
    keyed.upsert(narrow(used), batch_id, state, _event_keys(), _first_copy(), narrow=narrow)
    live = _not_idle(keyed.live_rows(batch.sparkSession, state), idle_seconds)
    touched = _anchors(live).join(used.select("customer_id").distinct(), "customer_id", "left_semi")
    events = latest_row(_inside(live, touched, longest, salts), _event_keys(), _first_copy())
    counts = []
    for entry in definition["aggregations"]:
        kind, inside = entry.get("event_type"), F.col("ts") >= F.col("anchor") - entry["window_seconds"] * 1_000_000
        counted = F.col("event_uuid").isNotNull() & inside & (F.lit(True) if kind is None else F.col("event_type") == kind)
        counts.append(F.count_if(counted).alias(entry["as"]))
    return events.groupBy("customer_id").agg(F.max("anchor").alias("anchor"), *counts)


def online_batch(counts: DataFrame, definition: Mapping = policies.ONLINE_FEATURES) -> DataFrame:
    """The online records of a micro-batch, one a customer (STR5)."""
    return counts.select(
        F.col("customer_id").alias(definition["entity_key"]),
        *[entry["as"] for entry in definition["aggregations"]],
        F.timestamp_micros("anchor").alias("last_event_ts"),
        F.current_timestamp().alias("updated_at"),
        F.lit(definition["name"]).alias("feature_version"),
        F.lit(definition["ttl_seconds"]).alias("ttl_seconds"),
    )


def start_online_features(
    events: DataFrame,
    path: str,
    checkpoint: str,
    definition: Mapping = policies.ONLINE_FEATURES,
    salts: int = SALTS,
    interval: str | None = None,
    state_partitions: int | None = None,
) -> StreamingQuery:
    """Keep the online record of every customer up to date in the table at ``path``; its events are at ``path``-state."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        counts = online_features(batch, batch_id, f"{path.rstrip('/')}-state", definition, salts, expire_idle=interval is not None)
        upsert_online(online_batch(counts, definition), batch_id, path, definition["entity_key"])

    return start(events, on_batch, checkpoint, interval, state_partitions=state_partitions)
