"""Mix sources to target weights by whole repetitions and one seeded Bernoulli copy.

Method.  Sizes are summed per source.  Each source has a weight; targets share the whole size by
weight, but none exceeds ``max_repeats`` times its source, and what a source cannot take is shared
among the others by weight.  A source's rate is target / size, and each document is emitted
floor(rate) times, plus once more if a hash of its id, read as a number in [0, 1), lies below the
fraction.  The same documents give the same mix at every run and on every cluster.

The shares come in closed form: sources sorted by cap / weight reach their cap in this order, so one
running sum finds the level up to which all are capped.  There is one row per source in that step.

Edge cases: null text has size 0, a null source is a source of its own and comes last, a null doc_id
is hashed as the empty string, rows with one doc_id are decided alike, a source without words has
target 0; extra columns are ignored by ``plan_mix`` and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import as_rows, inside, lookup, numbered_ranges, range_offsets, written

# Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_share(key: Column, seed: str = "") -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the key and the seed."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(seed)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def running(df: DataFrame, order: list[Column], amounts: dict[str, str], purpose: str) -> DataFrame:
    """The frame with, for each named column, the sum over all rows before in the given order.

    Rows are sorted in ranges; each range sums on its own and starts from the sum of those before."""
    placed = numbered_ranges(df, *order, purpose=purpose)
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    out = placed
    for name, amount in amounts.items():
        offsets = F.broadcast(range_offsets(placed, F.col(amount)))  # a row a shuffle partition
        out = out.join(offsets, "_part").withColumn(name, F.col("_before") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).drop("_before")
    return out.drop("_part", "_row")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sizes`` (source, docs, source_size), one row a source, with column target.

    Sources by code point, null last, take the weights in turn."""
    by_name = [F.col("source").isNull(), F.col("source")]
    ranked = running(sizes.withColumn("_one", F.lit(1)), by_name, {"_rank": "_one"}, "sources")
    turn = F.pmod(F.col("_rank"), F.lit(len(weights))) + 1
    weighted = ranked.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")).cast("long"))
    weighted = weighted.withColumn("_cap", F.lit(max_repeats) * F.col("source_size"))
    total = weighted.agg(F.sum("source_size").alias("size"), F.sum("_weight").alias("weight")).first()
    size, weight = total["size"] or 0, total["weight"] or 0
    # All sources before this one in the order of cap / weight are at their cap.
    level = running(weighted, [F.col("_cap") / F.col("_weight"), *by_name], {"_capped": "_cap", "_passed": "_weight"}, "source-levels")
    rest = (F.lit(size) - F.col("_capped")) / (F.lit(weight) - F.col("_passed"))
    open_rate = level.withColumn("_rest", rest).filter(F.col("_cap") >= F.col("_weight") * F.col("_rest")).agg(F.min(F.struct("_capped", "_rest")).alias("_first")).first()["_first"]
    share = F.col("_weight") * F.lit(open_rate["_rest"] if open_rate else 0.0)
    return level.select("source", "docs", "source_size", F.least(F.col("_cap").cast("double"), share).alias("target"))


def plan_mix(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix"
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken."""
    rows = df.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{source_column}`").alias("source"), word_count(F.col(f"`{text_column}`")).alias("size"))
    rows = written(rows, "document-sizes")
    sizes = written(rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size")), "source-sizes")
    targets = _with_key(source_targets(sizes, weights, max_repeats)).drop("source")
    total = sizes.agg(F.sum("docs")).first()[0] or 0
    joined = lookup(_with_key(rows), targets, "_source", "docs", total, F.col("doc_id"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (seeded_share(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("copies", F.floor(rate) + extra).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _with_key(df: DataFrame) -> DataFrame:
    """A source name that no null can break: '=' before a name, empty for none."""
    return df.withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))


def mixed(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix"
) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with all columns and no others.

    Rates are per source, so the texts meet only the table of sources and are not shuffled."""
    rows = df.select(F.col(f"`{source_column}`").alias("source"), word_count(F.col(f"`{text_column}`")).alias("size"))
    sizes = written(rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size")), "source-sizes")
    rates = _with_key(source_targets(sizes, weights, max_repeats)).select("_source", "docs", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("_rate"))
    rates = written(rates, "source-rates")
    total = sizes.agg(F.sum("docs")).first()[0] or 0
    keyed = as_rows(df).withColumn("_source", F.coalesce(F.concat(F.lit("="), inside(source_column)), F.lit("")))
    rated = lookup(keyed, rates, "_source", "docs", total, inside(id_column))
    extra = (seeded_share(inside(id_column), seed) < F.col("_rate") - F.floor("_rate")).cast("int")
    copies = F.floor("_rate").cast("int") + extra
    out = rated.withColumn("_copies", copies).filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.select("row.*")
