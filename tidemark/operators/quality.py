"""Data-quality rules, quarantine, drift and reconciliation (DQ1-DQ12, UDF4)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import policies
from tidemark.operators.aggregates import control_totals, duplicates
from tidemark.operators.cdc import latest_row
from tidemark.operators.filters import is_consistent_line, is_event_type, is_non_negative, is_valid_interval
from tidemark.operators.joins import compare_totals, orphans


@dataclass(frozen=True)
class RowRule:
    """A rule that one row can break.  ``ok`` is the condition for a good row; null counts as broken."""

    name: str
    ok: Column
    severity: str = "critical"

    @property
    def broken(self) -> Column:
        return ~F.coalesce(self.ok, F.lit(False))


def event_rules() -> list[RowRule]:
    return [RowRule("event_type_enum", is_event_type())]


def order_rules() -> list[RowRule]:
    return [RowRule("non_negative_amounts", is_non_negative("subtotal_amount", "discount_amount", "tax_amount", "total_amount"))]


def item_rules() -> list[RowRule]:
    return [RowRule("line_amount_consistency", is_consistent_line())]


def session_rules() -> list[RowRule]:
    return [RowRule("session_window", is_valid_interval("session_start_ts", "session_end_ts"))]


def campaign_rules() -> list[RowRule]:
    return [RowRule("campaign_dates", is_valid_interval("start_date", "end_date"))]


def not_null_rule(column: str) -> RowRule:
    return RowRule(f"not_null:{column}", F.col(column).isNotNull())


def accepted_values_rule(column: str, values: Sequence[str]) -> RowRule:
    return RowRule(f"accepted_values:{column}", F.col(column).isNull() | F.col(column).isin(*values))


def non_negative_rule(column: str) -> RowRule:
    return RowRule(f"non_negative:{column}", F.col(column).isNull() | (F.col(column) >= 0))


def ratio_rule(column: str) -> RowRule:
    return RowRule(f"ratio:{column}", F.col(column).isNull() | F.col(column).between(0, 1))


def violations(df: DataFrame, rules: Sequence[RowRule]) -> DataFrame:
    """Failures per row rule, (rule_name, severity, failures), all counted in one pass (DQ1, DQ3)."""
    counted = df.agg(*[F.count_if(rule.broken).alias(f"r{index}") for index, rule in enumerate(rules)])
    rows = [
        F.struct(
            F.lit(rule.name).alias("rule_name"), F.lit(rule.severity).alias("severity"), F.col(f"r{index}").alias("failures")
        )
        for index, rule in enumerate(rules)
    ]
    return counted.select(F.inline(F.array(*rows)))


def violating_rows(df: DataFrame, rule: RowRule) -> DataFrame:
    """The rows that break one rule (DQ4, UDF4)."""
    return df.filter(rule.broken)


CLEAN = "clean"


def verdict(rules: Sequence[RowRule]) -> Column:
    """``clean``, or the names of the broken rules joined by ``+``: the value that ``tables.write_split`` deals rows by."""
    broken = F.array_join(F.array_compact(F.array(*[F.when(rule.broken, F.lit(rule.name)) for rule in rules])), "+")
    return F.when(broken == "", F.lit(CLEAN)).otherwise(broken)


def observed_metrics(rules: Sequence[RowRule]) -> dict[str, Column]:
    """Counts to observe while rows are written: all, clean ones, and those that break each rule (DQ1-DQ5)."""
    counts = {"candidates": F.count(F.lit(1)), "rows": F.count_if(verdict(rules) == CLEAN) if rules else F.count(F.lit(1))}
    return counts | {f"rule:{rule.name}": F.count_if(rule.broken) for rule in rules}


def observed_results(dataset: str, metrics: Mapping[str, int], rules: Sequence[RowRule]) -> list[tuple[str, str, bool, dict]]:
    """Rows for ``result_rows`` from what a write has observed."""
    out = [(rule.name, dataset, metrics[f"rule:{rule.name}"] == 0, {"failures": metrics[f"rule:{rule.name}"], "rows": metrics["candidates"]}) for rule in rules]
    if "null_keys" in metrics:
        out.append(("primary_key_not_null", dataset, metrics["null_keys"] == 0, {"failures": metrics["null_keys"], "rows": metrics["rows_read"]}))
    out.append(("volume_baseline", dataset, metrics["rows"] > 0, {"failures": int(metrics["rows"] == 0), "rows": metrics["rows"]}))
    return out


def quarantine(df: DataFrame, rules: Sequence[RowRule]) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected) where rejected rows carry ``reasons``, the names of the broken rules (DQ9)."""
    marked = df.withColumn("reasons", F.array_compact(F.array(*[F.when(rule.broken, F.lit(rule.name)) for rule in rules])))
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)


def key_checks(df: DataFrame, key: str, dataset: str) -> DataFrame:
    """Null keys and repeated keys of a table (DQ1, DQ2).

    Both come from one grouping by key, so the table is read and shuffled once.
    """
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    counted = per_key.agg(
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count_if(F.col("n") > 1).alias("repeated"),
    )
    rows = [
        F.struct(F.lit(dataset).alias("dataset"), F.lit(name).alias("rule_name"), F.col(column).alias("failures"))
        for name, column in (("primary_key_not_null", "nulls"), ("business_key_uniqueness", "repeated"))
    ]
    return counted.select(F.inline(F.array(*rows)))


def volume(df: DataFrame, dataset: str, min_rows: int = 1) -> DataFrame:
    """Row count against a minimum (DQ5)."""
    return df.agg(F.count("*").alias("row_count")).select(
        F.lit(dataset).alias("dataset"),
        F.lit("volume_baseline").alias("rule_name"),
        "row_count",
        (F.col("row_count") >= min_rows).alias("passed"),
    )


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table in one result, (dataset, row_count, passed) (DQ11)."""
    counts = [volume(frame, name).drop("rule_name") for name, frame in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def run_generic_tests(df: DataFrame, dataset: str, row_rules: Sequence[RowRule], unique: Sequence[str] = ()) -> DataFrame:
    """Schema tests of one table: row rules and unique columns, (dataset, rule_name, failures) (DQ6)."""
    parts = []
    if row_rules:
        parts.append(violations(df, row_rules).select("rule_name", "failures"))
    for column in unique:
        repeated = duplicates(df.filter(F.col(column).isNotNull()), column)
        parts.append(repeated.agg(F.count("*").alias("failures")).select(F.lit(f"unique:{column}").alias("rule_name"), "failures"))
    return reduce(DataFrame.unionByName, parts).select(F.lit(dataset).alias("dataset"), "rule_name", "failures")


DECLARED_SCHEMA = "dataset string, rule_name string, failures bigint"


def declared_rule(column: str, test: str) -> RowRule | None:
    """The row rule of a declared test such as ``accepted_values a b``; None for ``unique`` and ``relationships``."""
    name, *values = test.split()
    makers = {"not_null": not_null_rule, "non_negative": non_negative_rule, "ratio": ratio_rule}
    if name == "accepted_values":
        return accepted_values_rule(column, values)
    return makers[name](column) if name in makers else None


def tested_table(df: DataFrame, dataset: str, tests: Mapping[str, Sequence[str]]) -> DataFrame:
    """All declared tests of one table but relationships, in one scan (DQ6).

    Row rules are counted while the rows are grouped by the unique column, so that a table with one is
    shuffled once, by its key, and one without not at all; more unique columns take a grouping each."""
    rules = [rule for column, own in tests.items() for test in own if (rule := declared_rule(column, test))]
    unique = [column for column, own in tests.items() if "unique" in own]
    counted = [F.count_if(rule.broken).alias(f"r{k}") for k, rule in enumerate(rules)]
    sums = [F.coalesce(F.sum(f"r{k}"), F.lit(0)).alias(f"r{k}") for k in range(len(rules))]
    names, parts = [rule.name for rule in rules], []
    for place, column in enumerate(unique or [None]):
        own, added = (counted, sums) if place == 0 else ([], [])
        if column is None:
            row, labels = df.agg(*own), names
        else:
            per_key = df.groupBy(F.col(column).alias("_key")).agg(F.count("*").alias("_n"), *own)
            row, labels = per_key.agg(*added, F.count_if(F.col("_key").isNotNull() & (F.col("_n") > 1)).alias("_repeated")), [*names[: len(own)], f"unique:{column}"]
        structs = [F.struct(F.lit(dataset).alias("dataset"), F.lit(label).alias("rule_name"), F.col(c).cast("bigint").alias("failures")) for label, c in zip(labels, row.columns, strict=True)]
        parts.append(row.select(F.inline(F.array(*structs))))
    return reduce(DataFrame.unionByName, parts)


def tested_relationships(table: Callable[[str], DataFrame], parent: str, field: str, children: Sequence[tuple[str, str]]) -> DataFrame:
    """All relationship tests with one parent in one join (DQ6, JOI17): keys of all children, counted, against the parent."""
    keys = [
        table(dataset).filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_key")).agg(F.count("*").alias("_n")).withColumn("_test", F.lit(k))
        for k, (dataset, column) in enumerate(children)
    ]
    known = table(parent).select(F.col(field).alias("_key")).distinct()
    missing = reduce(DataFrame.unionByName, keys).join(known, "_key", "left_anti")
    counts = missing.agg(*[F.coalesce(F.sum(F.when(F.col("_test") == k, F.col("_n"))), F.lit(0)).alias(f"t{k}") for k in range(len(children))])
    rows = [F.struct(F.lit(d).alias("dataset"), F.lit(f"relationships:{c}").alias("rule_name"), F.col(f"t{k}").alias("failures")) for k, (d, c) in enumerate(children)]
    return counts.select(F.inline(F.array(*rows)))


def run_declared_tests(table: Callable[[str], DataFrame], declared: Mapping[str, Mapping[str, Sequence[str]]] = policies.DECLARED_TESTS) -> DataFrame:
    """Every declared test with its failures: (dataset, rule_name, failures) (DQ6).  ``table`` gives a dataset by name."""
    parts, parents = [], {}
    for dataset, tests in declared.items():
        parts.append(tested_table(table(dataset), dataset, tests))
        for column, own in tests.items():
            for test in own:
                if test.startswith("relationships "):
                    _, parent, field = test.split()
                    parents.setdefault((parent, field), []).append((dataset, column))
    parts += [tested_relationships(table, parent, field, children) for (parent, field), children in parents.items()]
    return reduce(DataFrame.unionByName, parts)


def relationship_test(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, dataset: str) -> DataFrame:
    """Child rows without a parent, as a failure count (DQ6, JOI17)."""
    missing = orphans(child, parent, child_key, parent_key).agg(F.count("*").alias("failures"))
    return missing.select(F.lit(dataset).alias("dataset"), F.lit(f"relationships:{child_key}").alias("rule_name"), "failures")


def reconcile(actual: DataFrame, expected: DataFrame, actual_measures: Mapping[str, Column], expected_measures: Mapping[str, Column]) -> DataFrame:
    """Control totals of two tables; empty when they agree (DQ7, AGG9, JOI16)."""
    return compare_totals(control_totals(actual, actual_measures), control_totals(expected, expected_measures))


def reconcile_layers(layers: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Rows per day of every layer side by side (DQ12).

    ``layers`` maps a name to (frame, day expression), upstream first.  The result has
    ``<name>_rows`` per day and ``lost_rows``, the first layer minus the last.
    """
    parts = []
    for name, (frame, day) in layers.items():
        counts = frame.groupBy(day.cast("date").alias("metric_date")).agg(F.count("*").alias("n"))
        parts.append(counts.withColumn("layer", F.lit(name)))
    stacked = reduce(DataFrame.unionByName, parts)
    names = list(layers)
    columns = [F.coalesce(F.sum(F.when(F.col("layer") == name, F.col("n"))), F.lit(0)).alias(f"{name}_rows") for name in names]
    per_day = stacked.groupBy("metric_date").agg(*columns)
    return per_day.withColumn("lost_rows", F.col(f"{names[0]}_rows") - F.col(f"{names[-1]}_rows"))


def row_hash(*values: Column) -> Column:
    """The first 60 bits of the MD5 of a row's values as text, wide enough to be summed."""
    text = F.concat_ws("|", *[F.coalesce(value.cast("string"), F.lit("~")) for value in values])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")


def content_differences(
    left: DataFrame, right: DataFrame, group: Mapping[str, Column], left_values: Sequence[Column], right_values: Sequence[Column], amount: str
) -> DataFrame:
    """Groups of two layers side by side: rows, amount, and whether the rows themselves are the same (DQ7, DQ12).

    The rows of a group are compared by the sum of their hashes, which no order changes: amounts swapped
    between two rows leave counts and sums alike, but not the hashes.  One grouping over both layers, combined
    in the map tasks."""
    sides = []
    for side, frame, values in (("left", left, left_values), ("right", right, right_values)):
        columns = [value.alias(name) for name, value in group.items()]
        sides.append(frame.select(*columns, F.col(amount).cast("decimal(18,2)").alias("_amount"), row_hash(*values).alias("_hash"), F.lit(side).alias("_side")))

    def of(side: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_side") == side, value)), F.lit(0))

    both = sides[0].unionByName(sides[1]).groupBy(*group).agg(
        *[of(s, F.lit(1)).alias(f"{s}_rows") for s in ("left", "right")],
        *[of(s, F.col("_amount")).cast("decimal(28,2)").alias(f"{s}_amount") for s in ("left", "right")],
        (of("left", F.col("_hash")) == of("right", F.col("_hash"))).alias("same_hash"),
    )
    return both.withColumn("same_content", F.col("same_hash") & (F.col("left_rows") == F.col("right_rows"))).drop("same_hash")


def bucketed(column: str, bounds: Sequence[float]) -> Column:
    """Bucket label of a number under ascending upper bounds, for drift over numeric columns."""
    label = F.when(F.col(column).isNull(), F.lit("null"))
    for index, bound in enumerate(bounds):
        label = label.when(F.col(column) <= bound, F.lit(f"b{index}"))
    return label.otherwise(F.lit(f"b{len(bounds)}"))


def drift_psi(
    current: DataFrame, reference: DataFrame, columns: Mapping[str, Column], threshold: float = 0.2, floor: float = 1e-6
) -> DataFrame:
    """Population stability index per column between two frames (DQ8).

    ``columns`` maps a name to a category expression.  All columns are counted in one pass
    per frame; shares below ``floor`` are raised to it so that new categories count.
    """

    def counts(frame: DataFrame, side: str) -> DataFrame:
        pairs = [
            F.struct(F.lit(name).alias("column_name"), F.coalesce(value.cast("string"), F.lit("null")).alias("category"))
            for name, value in columns.items()
        ]
        return frame.select(F.inline(F.array(*pairs))).groupBy("column_name", "category").agg(F.count("*").alias(side))

    both = counts(reference, "ref").join(counts(current, "cur"), ["column_name", "category"], "full_outer").na.fill(0, ["ref", "cur"])
    totals = both.groupBy("column_name").agg(F.sum("ref").alias("ref_all"), F.sum("cur").alias("cur_all"))

    def share(part: str, whole: str) -> Column:
        return F.greatest(F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0)), F.lit(floor))

    shares = both.join(totals, "column_name").select(
        "column_name", share("ref", "ref_all").alias("r"), share("cur", "cur_all").alias("c")
    )
    psi = shares.groupBy("column_name").agg(F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))).alias("psi"))
    return psi.withColumn("passed", F.col("psi") < threshold)


RESULT_SCHEMA = (
    "rule_name string, severity string, dataset string, passed boolean, details map<string,string>, "
    "run_id string, recorded_at timestamp"
)


def result_rows(
    spark: SparkSession, results: Sequence[tuple[str, str, bool, Mapping]], run_id: str, recorded_at: datetime
) -> DataFrame:
    """DQ log rows from (rule, dataset, passed, details) (DQ10)."""
    rows = [
        (
            rule,
            policies.RULE_SEVERITY.get(rule, "warning"),
            dataset,
            passed,
            {name: str(value) for name, value in details.items()},
            run_id,
            recorded_at,
        )
        for rule, dataset, passed, details in results
    ]
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def latest_results(log: DataFrame) -> DataFrame:
    """Latest result per dataset and rule (DQ10)."""
    order = [F.col("recorded_at").desc_nulls_last(), F.col("run_id").desc_nulls_last()]
    return latest_row(log, [F.col("dataset"), F.col("rule_name")], order)
