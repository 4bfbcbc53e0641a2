"""Every event once, late ones as a side output, without a state store (STR6, STR7, STR10).

The table that a stream writes is also its memory: a micro-batch looks its keys up among the
rows that are still inside the horizon.  Rows are split into on time and late in one write, so a
row passes a batch once.  The watermark of each batch is a row beside the table, hence a
repeated batch finds the same rows late and the same rows known.

    <path>/batch_id=<n>/late=false    rows on time, each key once within the horizon
    <path>/batch_id=<n>/late=true     rows behind the watermark, once a batch
    <path>-marks/batch_id=<n>         newest event time so far, first batch still open
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.streaming.events import LATENESS
from tidemark.streaming.tables import start, write_batch

MARK = "newest bigint, first_open bigint"


class Watermark(NamedTuple):
    """What a batch knows of those before it: newest event time in microseconds, first open batch."""

    newest: int | None = None
    first_open: int = 0


def _mark(spark: SparkSession, path: str, batch_id: int) -> Watermark:
    if batch_id == 0:
        return Watermark()
    row = spark.read.schema(MARK).parquet(f"{path}-marks/batch_id={batch_id - 1}").first()
    return Watermark(row.newest, row.first_open)


def _behind(mark: Watermark, column: str, delay: str, times: int = 1) -> Column:
    """Whether a row is ``times`` delays or more behind the newest event time; null times never are."""
    bound = F.timestamp_micros(F.lit(mark.newest).cast("bigint"))
    for _ in range(times):
        bound = bound - F.expr(f"interval {delay}")
    return F.coalesce(F.col(column) <= bound, F.lit(False))


def _folders(spark: SparkSession, path: str, schema: T.StructType, first: int, last: int) -> DataFrame:
    """Rows of the batches ``first`` to ``last``, by their folders: the others are not even listed."""
    whole = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType()), T.StructField("late", T.BooleanType())])
    names = [f"{path}/batch_id={number}" for number in range(first, last + 1)]
    return spark.read.schema(whole).option("basePath", path).parquet(*names)


def _close(spark: SparkSession, path: str, batch_id: int, mark: Watermark, written: DataFrame, column: str, delay: str) -> None:
    """Write the mark of this batch: newest time with it, and the first batch that may still hold a copy.

    All rows up to a batch are at most as new as its mark, so batches close in their order.  The marks
    read are those of open batches: as many as fit into the horizon.
    """
    newest = written.agg(F.greatest(F.max(F.unix_micros(column)), F.lit(mark.newest).cast("bigint")).alias("newest"))
    newest = newest.first()["newest"]
    first = mark.first_open
    if newest is not None and batch_id > first:
        marks = spark.read.schema(f"{MARK}, batch_id bigint").option("basePath", f"{path}-marks")
        opened = marks.parquet(*[f"{path}-marks/batch_id={number}" for number in range(first, batch_id)])
        closed = opened.withColumn("newest_at", F.timestamp_micros("newest"))
        closed = closed.filter(_behind(Watermark(newest), "newest_at", delay, 2) & F.col("newest").isNotNull())
        last = closed.agg(F.max("batch_id")).first()[0]
        first = first if last is None else last + 1
    write_batch(spark.createDataFrame([(newest, first)], MARK).coalesce(1), batch_id, f"{path}-marks")


def write_once(
    batch: DataFrame, batch_id: int, path: str, key: str = "event_uuid", column: str = "event_ts", delay: str = LATENESS
) -> DataFrame:
    """Write the rows of a batch that are new, split by lateness; returns them as written.

    A row is late if it is ``delay`` or more behind the newest event time of the batches before.  Of
    copies in a batch one stays; a copy on time and a late one both stay, ``events_once`` merges them.  A row on time is
    dropped if its key was written by a row at most two delays behind.  Copies with the same event
    time are therefore always found, others while their times are within one delay.  A null key is a
    key; a row without event time is on time and looked up in the open batches.
    """
    if {"late", "batch_id"} & set(batch.columns):
        raise ValueError("the table keeps columns named late and batch_id of its own")
    spark = batch.sparkSession
    mark = _mark(spark, path, batch_id)
    rows = batch.withColumn("late", _behind(mark, column, delay)).dropDuplicates([key, "late"])
    if batch_id > 0:
        known = _folders(spark, path, batch.schema, mark.first_open, batch_id - 1)
        known = known.filter(~F.col("late") & ~_behind(mark, column, delay, 2)).select(F.col(key).alias("_known"))
        rows = rows.join(known, F.col(key).eqNullSafe(F.col("_known")) & ~F.col("late"), "left_anti")
    write_batch(rows, batch_id, path, ["late"])
    written = _folders(spark, path, batch.schema, batch_id, batch_id).drop("batch_id")
    _close(spark, path, batch_id, mark, written, column, delay)
    return written


def start_once(
    events: DataFrame,
    path: str,
    checkpoint: str,
    key: str = "event_uuid",
    column: str = "event_ts",
    delay: str = LATENESS,
    interval: str | None = None,
    then: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Keep the table at ``path``; ``then`` gets the rows on time of each batch, as written.

    ``then`` runs again with the same rows when a batch is repeated, so it must replace what it wrote.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        written = write_once(batch, batch_id, path, key, column, delay)
        if then is not None:
            then(written.filter(~F.col("late")).drop("late"), batch_id)

    return start(events, on_batch, checkpoint, interval)


def _all(spark: SparkSession, path: str, schema: T.StructType, late: bool) -> DataFrame:
    whole = T.StructType([*schema.fields, T.StructField("late", T.BooleanType())])
    return spark.read.schema(whole).parquet(path).filter(F.col("late") == late).select(*schema.names)


def on_time(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows written on time."""
    return _all(spark, path, schema, False)


def only_late(spark: SparkSession, path: str, schema: T.StructType, key: str = "event_uuid") -> DataFrame:
    """Events that came late and never on time, each once."""
    known = on_time(spark, path, schema).select(F.col(key).alias("_known"))
    late = _all(spark, path, schema, True).dropDuplicates([key])
    return late.join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti")


def events_once(spark: SparkSession, path: str, schema: T.StructType, key: str = "event_uuid") -> DataFrame:
    """Every event once; the copy that came on time stays."""
    return on_time(spark, path, schema).unionByName(only_late(spark, path, schema, key))


def funnel_counts(events: DataFrame, keys: Sequence[str], types: Mapping[str, str], column: str = "event_ts") -> DataFrame:
    """Counts per day and key of some events; such parts add up (AGG1)."""
    counts = [F.count_if(F.col("event_type") == kind).alias(name) for name, kind in types.items()]
    return events.groupBy(F.to_date(column).alias("metric_date"), *keys).agg(*counts)


def add_up(parts: DataFrame, keys: Sequence[str], types: Mapping[str, str]) -> DataFrame:
    """The counts of all parts (STR10)."""
    return parts.groupBy("metric_date", *keys).agg(*[F.sum(name).alias(name) for name in types])
