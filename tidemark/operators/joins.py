"""Join operators: range joins, as-of attribution, salted lookups, comparisons.

JOI7-JOI9, JOI13, JOI16, JOI17, WIN4, WIN5.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.cdc import latest_row

PARTS = 1024


def heavy_keys(rows: DataFrame, keys: Sequence[str], parts: int = PARTS) -> DataFrame:
    """Hash of every key with more than one ``parts``-th of all rows, and how many such parts it has.

    One pass over the key columns: each task keeps a frequency sketch, and the sketches are merged.
    A sketch of 12 items a part is wrong by less than a third of a part, so no heavy key is missed;
    there are at most ``parts`` of them, and their parts sum to at most twice ``parts``.
    """
    hashed = rows.select(F.xxhash64(*keys).alias("_heavy"))
    top = F.expr(f"approx_top_k(_heavy, {parts}, {12 * parts})")
    counted = hashed.agg(top.alias("_top"), F.count("*").alias("_all"))
    items = counted.select("_all", F.inline("_top").alias("_heavy", "_rows")).filter(F.col("_rows") * parts > F.col("_all"))
    return items.select("_heavy", F.ceil(F.col("_rows") * parts / F.col("_all")).cast("int").alias("_copies"))


def salted_join(big: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner", parts: int = PARTS) -> DataFrame:
    """Join a frame that may have hot keys to a lookup with one row per key.

    Only keys with more than one ``parts``-th of the rows are salted: their rows are spread by a hash
    of the row, their lookup row is repeated once per salt, every other lookup row stays single.  The
    heavy keys are at most ``parts`` rows and are broadcast.  No key then sends all its rows to one
    task, also where an aggregation on the same keys follows and an adaptive split is ruled out.
    Null keys match nothing and are spread as well.  Only inner and left joins keep their meaning.
    """
    if how not in ("inner", "left"):
        raise ValueError("a salted join is an inner or left join")
    heavy = F.broadcast(heavy_keys(big, keys, parts))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{name}`") for name in big.columns]), F.col("_copies")).cast("int")

    def marked(frame: DataFrame) -> DataFrame:
        return frame.withColumn("_heavy", F.xxhash64(*keys)).join(heavy, "_heavy", "left")

    salted = marked(big).withColumn("_salt", F.coalesce(spread, F.lit(0))).drop("_heavy", "_copies")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))
    repeated = marked(lookup).withColumn("_salt", copies).drop("_heavy", "_copies")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def latest_snapshot(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the latest by the order columns (JOI13, WIN4)."""
    return latest_row(df, [F.col(key) for key in keys], [F.col(name).desc_nulls_last() for name in order])


def active_intervals(
    days: DataFrame, intervals: DataFrame, key: str, day: str, start: str, end: str, name: str
) -> DataFrame:
    """How many intervals of the key cover each day: start <= day, and day <= end or no end (JOI7).

    Counting a running balance of starts and ends replaces the range join, so the work is
    linear and a key with many intervals is first reduced to one row per day.  ``days`` has
    one row per (key, day) and keeps its other columns; intervals that end before they start
    never count.
    """
    others = [column for column in days.columns if column not in (key, day)]
    usable = intervals.filter(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(start) <= F.col(end))))
    marks = usable.select(
        F.col(key),
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.col(start).alias("d"), F.lit(1).alias("step")),
                    F.when(F.col(end).isNotNull(), F.struct(F.date_add(F.col(end), 1).alias("d"), F.lit(-1).alias("step"))),
                )
            )
        ).alias("m"),
    )
    steps = marks.select(key, F.col("m.d").alias(day), F.col("m.step").cast("bigint").alias("_step"), F.lit(0).alias("_spine"))
    spine = days.withColumns({"_step": F.lit(0).cast("bigint"), "_spine": F.lit(1)})
    kept = [F.max(column).alias(column) for column in (*others, "_spine")]
    per_day = spine.unionByName(steps, allowMissingColumns=True).groupBy(key, day).agg(F.sum("_step").alias("_step"), *kept)
    running = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    balance = F.when(F.col(key).isNull(), F.lit(0)).otherwise(F.sum("_step").over(running))
    return per_day.withColumn(name, balance.cast("bigint")).filter(F.col("_spine") == 1).select(day, key, *others, name)


def best_in_lookback(
    needs: DataFrame, per_day: DataFrame, keys: Sequence[str], day: str, days: int, name: str
) -> DataFrame:
    """For every needed (keys, day) the largest ``name`` of that day or the ``days`` days before it (JOI9).

    ``per_day`` holds one candidate per keys and day, ``name`` being an orderable struct.  Needs
    shrink to one row per keys and day as well, so no pair of a need and a candidate is ever
    built and a window partition is bounded by the calendar.  Other columns of ``per_day`` are
    those of the needed day itself.
    """
    others = [column for column in per_day.columns if column not in (*keys, day, name)]
    wanted = needs.select(*keys, day).distinct().withColumn("_need", F.lit(True))
    both = per_day.unionByName(wanted, allowMissingColumns=True)
    merged = both.groupBy(*keys, day).agg(*[F.max(column).alias(column) for column in [name, *others, "_need"]])
    frame = Window.partitionBy(*keys).orderBy(F.unix_date(day)).rangeBetween(-days, 0)
    return merged.withColumn(name, F.max(name).over(frame)).filter(F.col("_need")).drop("_need")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent (JOI17)."""
    keys = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.filter(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def compare_totals(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """The single-row totals side by side, kept only when some measure differs (JOI16)."""
    names = actual.columns
    renamed = expected.select(*[F.col(name).alias(f"expected_{name}") for name in names])
    both = actual.join(renamed, F.lit(True))
    differs = F.lit(False)
    for name in names:
        differs = differs | ~F.col(name).eqNullSafe(F.col(f"expected_{name}"))
    return both.filter(differs)
