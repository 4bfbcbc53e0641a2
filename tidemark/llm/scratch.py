"""Intermediate tables in the shared folder, running totals without a single task, skew-safe lookups."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return memory that this Python worker holds but does not use, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def as_rows(df: DataFrame) -> DataFrame:
    """Each row as one struct, ``row``: helper columns beside it never meet the names of its own columns."""
    return df.select(F.struct("*").alias("row"))


def inside(column: str) -> Column:
    """A column of the struct that ``as_rows`` makes."""
    return F.col(f"row.`{column}`")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered_ranges(df: DataFrame, *keys: str | Column, purpose: str) -> DataFrame:
    """The frame in global order of its keys, written, with columns _part and _row.

    _part is the range partition, _row the place inside it: both follow the order of the keys."""
    count = partitions(df.sparkSession)
    ranged = df.repartitionByRange(count, *keys).sortWithinPartitions(*keys)
    number = F.monotonically_increasing_id()
    placed = ranged.withColumn("_number", number).select(
        *df.columns,
        F.shiftright("_number", 33).cast("int").alias("_part"),
        F.col("_number").bitwiseAND((1 << 33) - 1).alias("_row"),
    )
    return written(placed, purpose)


def range_offsets(placed: DataFrame, amount: Column) -> DataFrame:
    """Per _part: sum of the amount over all parts before it, as _before; one row per partition."""
    from pyspark.sql import Window

    sums = placed.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long").alias("_before"))


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, spread: Column, share: float = 0.001, salts: int = 64) -> DataFrame:
    """Inner join on ``key`` where a few keys of ``table`` may own most of the ``rows``.

    ``table`` has one row a key, ``weight`` the rows that have it.  Keys with more than ``share``
    of the ``total``, at most 1/share of them, are told to all tasks as hashes; rows that have one
    are dealt over ``salts`` copies of the key's row by ``spread``.  No row is dropped."""
    large = table.filter(F.col(weight) > share * max(total, 1)).select(F.xxhash64(key).alias("hash"))
    hot = [row["hash"] for row in large.collect()]  # no more than 1/share rows
    if not hot:
        return rows.join(table, key)
    is_hot = F.xxhash64(key).isin(hot)
    dealt = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(is_hot, F.lit(salts - 1)).otherwise(F.lit(0)))))
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def having(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, share: float = 0.001) -> DataFrame:
    """Rows whose ``key`` is in ``table``, which has one row a key and as ``weight`` the rows that have it.

    Keys with more than ``share`` of the ``total``, at most 1/share of them, are told to all tasks, so
    their rows are not shuffled; the others meet the table in a semi join.  No row is dropped."""
    hot = [row[key] for row in table.filter(F.col(weight) > share * max(total, 1)).select(key).collect()]  # no more than 1/share rows
    if not hot:
        return rows.join(table.select(key), key, "left_semi")
    is_hot = F.col(key).isin(hot)
    return rows.filter(is_hot).unionByName(rows.filter(~is_hot).join(table.filter(~is_hot).select(key), key, "left_semi"))


def first_by_hash(rows: DataFrame, group: str, key: str, count: int, groups: int) -> DataFrame:
    """Rows with ``_turn`` from 1 to ``count`` in their group, by (hash of key, key); the first ``groups`` groups at most.

    Counts by group and range of the hash tell where each group reaches ``count`` rows, and only rows
    up to there are ranked: what a group sends to its task hardly grows with the input."""
    from pyspark.sql import Window

    ranges = rows.groupBy(group, F.shiftright(F.xxhash64(key), 52).alias("_range")).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    reached = ranges.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < count)
    last = reached.groupBy(F.col(group).alias("_group")).agg(F.max("_range").alias("_last")).orderBy("_group").limit(groups)
    # One row a group and at most ``groups`` of them: a proven bound for the broadcast.
    near = rows.join(F.broadcast(last), (F.col(group) == F.col("_group")) & (F.shiftright(F.xxhash64(key), 52) <= F.col("_last")))
    turn = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(key), key))
    return near.select(*rows.columns).withColumn("_turn", turn).filter(F.col("_turn") <= count)
