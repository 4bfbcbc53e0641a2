"""Decode and validate framed session events (STR1, UDF1, FLT10, SCA17, SCA18).

Header checks and bodies are column expressions.  Avro bodies need Spark's Avro package on the
cluster; JSON bodies need nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import wire
from tidemark.schemas import EVENT_COLUMNS, EVENT_RECORD, EVENT_SUBJECT, EVENT_TOPIC, EVENT_TYPES

# Reasons a payload is refused.
NULL_PAYLOAD = "null payload"
TOO_SHORT = "payload too short for Confluent wire format"
BAD_MAGIC = "invalid Confluent wire-format magic byte"
UNKNOWN_SCHEMA = "schema id %d not found"
OTHER_SCHEMA = "schema id %d does not match repository session_event contract"
BROKEN_BODY = "deserialization failed"
BAD_TYPE = "invalid event_type: %s"

REQUIRED = tuple(name for name, kind in EVENT_RECORD.items() if not kind.endswith("?"))
# Body types: event times travel as epoch milliseconds.
BODY_DDL = ", ".join(f"{name} {'bigint' if kind == 'timestamp' else kind}" for name, kind in EVENT_COLUMNS.items())


def contract_ids(catalogue: Mapping[int, Mapping], contract: Mapping) -> dict[int, bool]:
    """Schema id -> whether that schema is the session event contract."""
    return {number: json.dumps(found, sort_keys=True) == json.dumps(contract, sort_keys=True) for number, found in catalogue.items()}


def avro_schema(record: Mapping[str, str] = EVENT_RECORD) -> str:
    """The event record as an Avro schema; types with ``?`` are nullable, times are plain longs."""
    names = {"bigint": "long", "timestamp": "long", "int": "int", "string": "string"}
    fields = []
    for name, kind in record.items():
        plain = names[kind.rstrip("?")]
        fields.append({"name": name, "type": ["null", plain] if kind.endswith("?") else plain})
    return json.dumps({"type": "record", "name": "session_event", "fields": fields})


def _avro_body(body: Column) -> Column:
    return F.call_function("from_avro", body, F.lit(avro_schema()), F.create_map(F.lit("mode"), F.lit("PERMISSIVE")))


def decode_events(df: DataFrame, schemas: Mapping[int, bool], body: str = "avro", types: Iterable[str] = EVENT_TYPES) -> DataFrame:
    """Events with ``error`` null, or a reason and the raw payload.

    Input columns ``value``, ``partition``, ``offset``, ``timestamp``.  ``schemas`` maps the known
    schema ids to whether they are the contract; ``body`` is ``avro`` or ``json``.
    """
    value = F.col("value")
    number = wire.schema_id(value)
    known = list(schemas)
    matching = [key for key, same in schemas.items() if same]
    framed = (F.length(value) >= wire.HEADER_BYTES) & (wire.magic_byte(value) == 0) & number.isin(*matching)
    content = F.when(framed, wire.body(value))
    event = _avro_body(content) if body == "avro" else wire.json_struct(content.cast("string"), BODY_DDL)
    opened = df.withColumn("_event", event)
    broken = F.col("_event").isNull()
    for name in REQUIRED:
        broken = broken | F.col(f"_event.{name}").isNull()
    error = (
        F.when(value.isNull(), NULL_PAYLOAD)
        .when(F.length(value) < wire.HEADER_BYTES, TOO_SHORT)
        .when(wire.magic_byte(value) != 0, BAD_MAGIC)
        .when(~number.isin(*known), F.format_string(UNKNOWN_SCHEMA, number))
        .when(~number.isin(*matching), F.format_string(OTHER_SCHEMA, number))
        .when(broken, BROKEN_BODY)
        .when(~F.col("_event.event_type").isin(*types), F.format_string(BAD_TYPE, F.col("_event.event_type")))
    )
    columns = [
        (F.timestamp_millis(F.col(f"_event.{name}")) if kind == "timestamp" else F.col(f"_event.{name}")).alias(name)
        for name, kind in EVENT_COLUMNS.items()
    ]
    has_header = (F.length(value) >= wire.HEADER_BYTES) & (wire.magic_byte(value) == 0)
    return opened.select(
        *columns,
        F.when(has_header, number).cast("int").alias("schema_id"),
        F.lit(EVENT_SUBJECT).alias("schema_subject"),
        F.base64(value).alias("raw_payload"),
        error.alias("error"),
        F.col("partition").cast("int").alias("source_partition"),
        F.col("offset").cast("bigint").alias("source_offset"),
        F.col("timestamp").alias("kafka_timestamp"),
    )


def bronze_events(decoded: DataFrame) -> DataFrame:
    """Valid events in the Bronze shape (SNK4)."""
    return decoded.filter(F.col("error").isNull()).select(
        *EVENT_COLUMNS,
        F.to_date("event_ts").alias("event_date"),
        F.to_date("ingest_ts").alias("ingest_date"),
        "source_partition",
        "source_offset",
    )


def dead_letters(decoded: DataFrame, topic: str = EVENT_TOPIC) -> DataFrame:
    """Refused payloads with their reason (SNK5)."""
    return decoded.filter(F.col("error").isNotNull()).select(
        wire.dead_letter_key(topic, "source_partition", "source_offset").alias("dlq_key"),
        "raw_payload",
        F.lit(topic).alias("original_topic"),
        "source_partition",
        "source_offset",
        "schema_subject",
        "schema_id",
        F.col("error").alias("failure_reason"),
        "kafka_timestamp",
        F.current_timestamp().alias("dlq_emitted_ts"),
    )
