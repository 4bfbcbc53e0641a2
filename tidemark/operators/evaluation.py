"""Classifier metrics, ROC-AUC and the chronological split (ML3, ML4, SRT4)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clip

EPSILON = 1e-12


def classifier_metrics(df: DataFrame, label: str = "label", score: str = "p", threshold: float = 0.5) -> DataFrame:
    """Threshold metrics, log-loss and Brier score in one aggregation (ML3)."""
    y, p = F.col(label).cast("int"), F.col(score)
    hit = p >= threshold
    clipped = clip(p, EPSILON, 1 - EPSILON)
    loss = -(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))

    def rate(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part.cast("double") / whole).otherwise(0.0)

    sums = df.agg(
        F.count("*").alias("support"),
        F.count_if(hit == (y == 1)).alias("correct"),
        F.count_if(hit & (y == 1)).alias("true_positive"),
        F.count_if(hit).alias("predicted_positive"),
        F.count_if(y == 1).alias("positive"),
        F.sum(loss).alias("loss"),
        F.sum((y - p) * (y - p)).alias("squares"),
    )
    n = F.col("support")
    precision = rate(F.col("true_positive"), F.col("predicted_positive"))
    recall = rate(F.col("true_positive"), F.col("positive"))
    return sums.select(
        F.lit(threshold).alias("threshold"),
        rate(F.col("correct"), n).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"),
        F.coalesce(F.col("loss") / n, F.lit(0.0)).alias("log_loss"),
        F.coalesce(F.col("squares") / n, F.lit(0.0)).alias("brier_score"),
        n,
        rate(F.col("positive"), n).alias("positive_rate"),
    )


def roc_auc(df: DataFrame, label: str = "label", score: str = "p") -> DataFrame:
    """Exact ROC-AUC as one row, ties counted half, null when a class is absent (ML4).

    Equal scores are folded and dealt to range partitions, whose borders Spark draws from the scores.  Each
    sorted partition counts its own pairs in one pass and leaves one row; the negatives of all partitions
    before it are then added, a row a partition.
    """
    y = F.col(label).cast("int")
    folded = (
        df.filter(F.col(score).isNotNull() & y.isNotNull())
        .groupBy(F.col(score).alias("s"))
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    )
    ranged = folded.repartitionByRange("s").sortWithinPartitions("s").select("pos", "neg")
    parts = ranged.mapInArrow(_pairs_inside, "part int, wins double, pos long, neg long")
    before = F.coalesce(F.sum("neg").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = parts.withColumn("before", before).agg(
        F.sum(F.col("wins") + F.col("pos").cast("double") * F.col("before")).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n")
    )
    pairs = F.col("p").cast("double") * F.col("n")
    return totals.select(F.when(pairs > 0, F.col("wins") / pairs).alias("roc_auc"))


def _pairs_inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs won inside one partition of folded scores in ascending order, with its positives and negatives."""
    wins, positives, negatives, rows = 0.0, 0, 0, 0
    for batch in batches:
        pos, neg = (batch.column(name).to_numpy() for name in ("pos", "neg"))
        below = negatives + np.cumsum(neg) - neg
        wins += float(pos.astype(np.float64) @ (below + neg / 2))
        positives, negatives, rows = positives + int(pos.sum()), negatives + int(neg.sum()), rows + len(pos)
    if rows:
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "wins": [wins], "pos": [positives], "neg": [negatives]})


def rows_before_cut(total: int, ratio: float) -> int:
    """Whole rows in the first ``ratio`` of ``total``; either side of two or more rows gets one at least."""
    return sorted((1, math.floor(ratio * total), total - 1))[1] if total > 1 else total


def chronological_split(
    df: DataFrame, day: str = "as_of_date", entity: str = "entity_id", ratio: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """(train, test): the first ``ratio`` of the rows by day, then entity (SRT4).

    Both sides get at least one row when there are two.  The cut is the row of that place in the order of
    (day, entity), which must be unique; rows without a day come first, and within a day those without an
    entity.  It is found by ``kth_key`` without sorting or numbering the rows.
    """
    columns = [day, entity]
    total = df.count()
    if not total:
        return df, df.limit(0)
    last = kth_key(df, columns, rows_before_cut(total, ratio))
    before = _key(columns) <= _key_literal(df, columns, last)
    return df.filter(before), df.filter(~before)


#: Keys collected in a round of a selection, and borders that each round counts below.
ROUND_KEYS, BORDERS = 4096, 48


def _key(columns: Sequence[str]) -> Column:
    """A sortable key; nulls are its least values."""
    return F.struct(*[F.col(f"`{name}`") for name in columns])


def _key_literal(df: DataFrame, columns: Sequence[str], values: Sequence[Any]) -> Column:
    return F.struct(*[F.lit(value).cast(df.schema[name].dataType).alias(name) for name, value in zip(columns, values, strict=True)])


def kth_key(df: DataFrame, columns: Sequence[str], k: int) -> tuple:
    """The k-th smallest key of a frame, counted from 1, for columns of any ordered type (SRT4).

    Each round draws at most ``ROUND_KEYS`` keys of what is left by their hash, counts the rows up to
    ``BORDERS`` of them in one pass and goes on between the two that enclose the place, until what is left
    can be sorted here.  A key that is repeated very often is told by the least and greatest being equal."""
    key, rest = _key(columns), df.select(*[F.col(f"`{name}`") for name in columns])
    seed = 0
    while True:
        about = rest.agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).first()
        if about["low"] == about["high"]:
            return tuple(about["low"])
        if about["n"] <= ROUND_KEYS:
            ordered = rest.orderBy(*[F.col(f"`{name}`").asc_nulls_first() for name in columns]).collect()
            return tuple(ordered[k - 1])
        share = ROUND_KEYS / 4 / about["n"]
        drawn = rest.filter(F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{name}`") for name in columns]), F.lit(1 << 40)) < int(share * (1 << 40)))
        # Hashes of one key are equal: a key repeated often is drawn once.
        sample = drawn.distinct().orderBy(*[F.col(f"`{name}`").asc_nulls_first() for name in columns]).limit(ROUND_KEYS).collect()
        inner = [tuple(row) for row in sample if tuple(row) != tuple(about["high"])]
        borders = [inner[at] for at in sorted({place * len(inner) // BORDERS for place in range(BORDERS)})] if inner else [tuple(about["low"])]
        literals = [_key_literal(df, columns, border) for border in borders]
        counts = list(rest.agg(*[F.count_if(key <= literal).alias(f"b{place}") for place, literal in enumerate(literals)]).first())
        at = next((place for place, count in enumerate(counts) if k <= count), len(counts))
        if at < len(counts):
            rest = rest.filter(key <= literals[at])
        if at:
            rest, k = rest.filter(key > literals[at - 1]), k - counts[at - 1]
        seed += 1
