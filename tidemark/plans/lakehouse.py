"""All datasets by name, lazily or as written tables (SRC11, SNK7, D9, D17).

``Lakehouse.table`` gives any dataset as a lazy frame built from Bronze.  ``build`` writes
datasets in dependency order; later builders then read the written tables, so a layer is
computed once however many datasets use it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.plans import bi, features, gold, metrics, silver
from tidemark.schemas import TABLE_SPECS
from tidemark.session import shared_dir
from tidemark.sources import tables

Build = Callable[..., DataFrame]


@dataclass(frozen=True)
class Dataset:
    """A named table: its inputs by name, its builder, its partition columns and its time column."""

    layer: str
    inputs: tuple[str, ...]
    build: Build
    partition_by: tuple[str, ...] = ()
    stamped: str | None = None
    ranged: bool = False


def _bronze(name: str) -> str:
    return f"bronze.{name}"


def _dimension(name: str) -> Build:
    return lambda bronze, processed_at=None: silver.current_dimension(bronze, name, processed_at)


def _calendar(*frames: DataFrame, loaded_at: datetime | None = None) -> DataFrame:
    columns = ("metric_date", "metric_date", "metric_date", "order_ts", "event_date", "activity_ts")
    return gold.dim_date(list(zip(frames, columns)), loaded_at)


def _semantic(name: str) -> Build:
    return lambda mart: gold.semantic(mart, name)


def _charted(name: str) -> Build:
    return lambda df: bi.chart(df, name)


_CAMPAIGN_INPUTS = (
    "silver.session_event_clean",
    "silver.order_item",
    "silver.order_header",
    "silver.campaign_current",
    "silver.sales_activity",
)

DATASETS: dict[str, Dataset] = {
    **{
        f"silver.{name}_current": Dataset("silver", (_bronze(name),), _dimension(name), stamped="processed_at")
        for name in silver.DIMENSIONS
    },
    "silver.customer_session": Dataset(
        "silver", (_bronze("customer_session"),), silver.customer_session, stamped="processed_at", ranged=True
    ),
    "silver.session_event_clean": Dataset(
        "silver", (_bronze("session_event"),), silver.session_event_clean, ("event_date",), "processed_at", True
    ),
    "silver.order_header": Dataset(
        "silver", (_bronze("order_header"),), silver.order_header, stamped="processed_at", ranged=True
    ),
    "silver.order_item": Dataset("silver", (_bronze("order_item"),), silver.order_item, stamped="processed_at", ranged=True),
    "silver.sales_activity": Dataset(
        "silver", (_bronze("sales_activity"),), silver.sales_activity, stamped="processed_at", ranged=True
    ),
    "silver.customer_daily_metrics": Dataset(
        "silver",
        ("silver.session_event_clean", "silver.order_header"),
        metrics.customer_daily,
        ("metric_date",),
        "processed_at",
    ),
    "silver.product_daily_metrics": Dataset(
        "silver",
        ("silver.session_event_clean", "silver.order_item", "silver.order_header"),
        metrics.product_daily,
        ("metric_date",),
        "processed_at",
    ),
    "silver.campaign_daily_metrics": Dataset(
        "silver", _CAMPAIGN_INPUTS, metrics.campaign_daily, ("metric_date",), "processed_at"
    ),
    "silver.advertiser_daily_metrics": Dataset(
        "silver",
        ("silver.campaign_daily_metrics", "silver.campaign_current", "silver.sales_activity"),
        metrics.advertiser_daily,
        ("metric_date",),
        "processed_at",
    ),
    "silver.customer_realtime_features_v1_parity": Dataset(
        "silver", ("silver.session_event_clean",), features.offline_online_features
    ),
    "silver.customer_purchase_features_v1": Dataset(
        "silver",
        ("silver.customer_daily_metrics", "silver.order_header"),
        features.customer_purchase_features,
        ("as_of_date",),
        "generated_at",
    ),
    "silver.customer_rowframe_features_v1": Dataset(
        "silver",
        ("silver.customer_daily_metrics", "silver.order_header"),
        features.customer_rowframe_features,
        ("as_of_date",),
        "generated_at",
    ),
    "silver.customer_purchase_realtime_features_v1": Dataset(
        "silver",
        (
            "silver.customer_daily_metrics",
            "silver.order_header",
            "silver.customer_realtime_features_v1_parity",
        ),
        features.customer_realtime_features,
        ("as_of_date",),
        "generated_at",
    ),
    "silver.campaign_success_features_v1": Dataset(
        "silver", ("silver.campaign_daily_metrics",), features.campaign_features, ("as_of_date",), "generated_at"
    ),
    "silver.advertiser_budget_features_v1": Dataset(
        "silver", ("silver.advertiser_daily_metrics",), features.advertiser_features, ("as_of_date",), "generated_at"
    ),
    "gold.dim_customer": Dataset(
        "gold",
        ("silver.customer_current", "silver.customer_session", "silver.session_event_clean"),
        gold.dim_customer,
        stamped="loaded_at",
    ),
    "gold.dim_product": Dataset("gold", ("silver.product_current",), gold.dim_product, stamped="loaded_at"),
    "gold.dim_advertiser": Dataset("gold", ("silver.advertiser_current",), gold.dim_advertiser, stamped="loaded_at"),
    "gold.dim_sales_rep": Dataset("gold", ("silver.sales_rep_current",), gold.dim_sales_rep, stamped="loaded_at"),
    "gold.dim_campaign": Dataset("gold", ("silver.campaign_current",), gold.dim_campaign, stamped="loaded_at"),
    "gold.dim_date": Dataset(
        "gold",
        (
            "silver.customer_daily_metrics",
            "silver.campaign_daily_metrics",
            "silver.advertiser_daily_metrics",
            "silver.order_header",
            "silver.session_event_clean",
            "silver.sales_activity",
        ),
        _calendar,
        stamped="loaded_at",
    ),
    "gold.fct_session_events": Dataset(
        "gold",
        ("silver.session_event_clean", "silver.customer_session"),
        gold.fct_session_events,
        ("event_date",),
        "loaded_at",
    ),
    "gold.fct_orders": Dataset("gold", ("silver.order_header",), gold.fct_orders, ("order_date",), "loaded_at"),
    "gold.fct_order_items": Dataset(
        "gold", ("silver.order_item", "silver.order_header"), gold.fct_order_items, ("order_date",), "loaded_at"
    ),
    "gold.fct_sales_activity": Dataset(
        "gold", ("silver.sales_activity",), gold.fct_sales_activity, ("activity_date",), "loaded_at"
    ),
    "gold.fct_campaign_daily": Dataset(
        "gold", ("silver.campaign_daily_metrics",), gold.fct_campaign_daily, ("metric_date",), "loaded_at"
    ),
    "gold.fct_advertiser_daily": Dataset(
        "gold", ("silver.advertiser_daily_metrics",), gold.fct_advertiser_daily, ("metric_date",), "loaded_at"
    ),
    "gold.mart_campaign_performance": Dataset(
        "gold",
        ("gold.fct_campaign_daily", "gold.dim_campaign"),
        gold.mart_campaign_performance,
        ("metric_date",),
        "loaded_at",
    ),
    "gold.mart_advertiser_engagement": Dataset(
        "gold",
        ("gold.fct_advertiser_daily", "gold.dim_advertiser", "gold.dim_sales_rep"),
        gold.mart_advertiser_engagement,
        ("metric_date",),
        "loaded_at",
    ),
    "gold.mart_customer_conversion": Dataset(
        "gold",
        ("silver.customer_daily_metrics", "gold.dim_customer"),
        gold.mart_customer_conversion,
        ("metric_date",),
        "loaded_at",
    ),
    "gold.semantic_campaign_performance": Dataset(
        "gold", ("gold.mart_campaign_performance",), _semantic("campaign_performance")
    ),
    "gold.semantic_advertiser_engagement": Dataset(
        "gold", ("gold.mart_advertiser_engagement",), _semantic("advertiser_engagement")
    ),
    "gold.semantic_customer_conversion": Dataset(
        "gold", ("gold.mart_customer_conversion",), _semantic("customer_conversion")
    ),
    "bi.campaign_performance_over_time": Dataset(
        "bi", ("gold.mart_campaign_performance",), bi.campaign_performance_over_time
    ),
    "bi.advertiser_effectiveness": Dataset("bi", ("gold.mart_advertiser_engagement",), bi.advertiser_effectiveness),
    "bi.funnel": Dataset("bi", ("gold.mart_customer_conversion",), bi.browse_to_purchase_funnel),
    "bi.channel_contribution": Dataset(
        "bi",
        ("gold.fct_order_items", "gold.fct_session_events", "gold.dim_product"),
        bi.product_channel_contribution,
    ),
}
_CHART_SOURCE = {
    "campaign_performance": "gold.mart_campaign_performance",
    "advertiser_engagement": "gold.mart_advertiser_engagement",
    "customer_conversion": "gold.mart_customer_conversion",
    "funnel_stage_totals": "bi.funnel",
    "product_channel_contribution": "bi.channel_contribution",
}
DATASETS.update(
    {
        f"bi.chart_{name}": Dataset("bi", (_CHART_SOURCE[about["dataset"]],), _charted(name))
        for name, about in bi.CHARTS.items()
    }
)


class Lakehouse:
    """Datasets over one Bronze layer.

    ``bronze`` has ``table(name)`` for the change logs and ``session_event``.  ``start`` and
    ``end`` limit the Silver facts; ``at`` fixes every processing time for reproducible output.
    """

    def __init__(
        self, spark: SparkSession, bronze: Any, start: Any = None, end: Any = None, at: datetime | None = None
    ):
        self.spark, self.bronze, self.at = spark, bronze, at
        self.range = {"start": start, "end": end}
        self._frames: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """Dataset ``layer.name`` (``bronze.customer``, ``gold.dim_date``, …)."""
        if name not in self._frames:
            if name.startswith("bronze."):
                self._frames[name] = self.bronze.table(name.removeprefix("bronze."))
            else:
                self._frames[name] = self._built(DATASETS[name])
        return self._frames[name]

    def _built(self, dataset: Dataset, inputs: list[DataFrame] | None = None) -> DataFrame:
        options: dict[str, Any] = {dataset.stamped: self.at} if dataset.stamped else {}
        if dataset.ranged:
            options |= {key: value for key, value in self.range.items() if value is not None}
        return dataset.build(*(inputs or [self.table(name) for name in dataset.inputs]), **options)

    def order(self, names: Iterable[str]) -> list[str]:
        """The datasets and everything they need, inputs first."""
        done: list[str] = []

        def visit(name: str) -> None:
            if name in done or name.startswith("bronze."):
                return
            for source in DATASETS[name].inputs:
                visit(source)
            done.append(name)

        for name in names:
            visit(name)
        return done

    def materialize(self, *names: str, columns: Iterable[str] = ()) -> Lakehouse:
        """Write datasets that several readers need to the shared folder and read them from there.

        The stored columns, all or those listed, are read as often as needed without repeating
        the work behind them, and the tables outlive a lost executor.
        """
        root, wanted = shared_dir(self.spark, "lakehouse"), set(columns)
        for name in names:
            path = f"{root}/{name.replace('.', '/')}"
            frame = self.table(name)
            kept = [column for column in frame.columns if not wanted or column in wanted]
            tables.write_table(frame.select(*kept), path)
            self._frames[name] = tables.read_table(self.spark, path)
        return self

    def build(self, root: str, names: Iterable[str] = DATASETS, lineage: str | None = None, results: str | None = None) -> dict[str, int]:
        """Write datasets under ``root`` with their inputs first; returns rows written per dataset.

        Facts with rules are split in the write: rejected rows go to ``<root>/quarantine/<layer>/<name>`` (D8,
        DQ9).  What the writes observe, rows read and null keys of the change log before the latest row is cut,
        rows and failures of every rule, is appended to the result log (DQ1-DQ5, DQ10)."""
        run_id, at = tables.new_run_id("lakehouse"), self.at or datetime.now(UTC)
        written, found = {}, []
        for name in self.order(names):
            dataset = DATASETS[name]
            path = f"{root.rstrip('/')}/{name.replace('.', '/')}"
            source, read = self._observed_log(dataset)
            rules, verdict, rejected = [], None, None
            if ruled := silver.RULED.get(name.removeprefix("silver.")):
                candidates, rules_of = ruled
                rules, rejected = rules_of(), f"{root.rstrip('/')}/quarantine/{name.replace('.', '/')}"
                verdict = quality.verdict(rules)
                frame = silver.stamp(candidates(source, **{k: v for k, v in self.range.items() if v is not None}), "silver_processed_ts", self.at)
            else:
                frame = self.table(name) if source is None else self._built(dataset, [source])
            seen = tables.write_observed(
                frame,
                path,
                job=f"build_{dataset.layer}",
                upstream=list(dataset.inputs),
                run_id=run_id,
                lineage_table=lineage or f"{root.rstrip('/')}/metadata/lineage",
                metrics=quality.observed_metrics(rules),
                partition_by=dataset.partition_by,
                verdict=verdict,
                rejected=rejected,
            )
            written[name] = seen["rows"]
            found += quality.observed_results(name, seen | (read.get if read else {}), rules)
            self._frames[name] = tables.read_table(self.spark, path)
        if found:
            log = quality.result_rows(self.spark, found, run_id, at)
            tables.write_table(log.coalesce(1), results or f"{root.rstrip('/')}/metadata/dq_results", mode="append")
        return written

    def _observed_log(self, dataset: Dataset) -> tuple[DataFrame | None, Observation | None]:
        """The change log of a dataset built from one alone, with an observer of its rows and null keys."""
        if len(dataset.inputs) != 1 or not dataset.inputs[0].startswith("bronze."):
            return None, None
        name = dataset.inputs[0].removeprefix("bronze.")
        key = TABLE_SPECS[name].key if name in TABLE_SPECS else "event_uuid"
        read = Observation(f"log-{uuid4().hex}")
        null_keys = F.count_if(F.col(key).isNull()).alias("null_keys")
        return self.table(dataset.inputs[0]).observe(read, F.count(F.lit(1)).alias("rows_read"), null_keys), read

    def backfill(self, root: str, name: str, start: Any, end: Any) -> None:
        """Rebuild only the days of the range of one written, day-partitioned dataset (SNK2)."""
        (day,) = DATASETS[name].partition_by
        tables.backfill(self._built(DATASETS[name]), f"{root.rstrip('/')}/{name.replace('.', '/')}", day, start, end)
