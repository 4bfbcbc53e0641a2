"""Registered queries for operators that are not a dataset of their own."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import policies
from tidemark.functions import wire
from tidemark.operators import aggregates, cdc, evaluation, governance, joins, quality
from tidemark.operators import model as models
from tidemark.plans import features, silver, training
from tidemark.plans.lakehouse import DATASETS, Lakehouse
from tidemark.schemas import TABLE_SPECS
from tidemark.session import shared_dir, tune
from tidemark.sources import tables
from tidemark.sources.sample import SampleBronze

Query = Callable[[SparkSession, str], DataFrame]

FIXED_AT = datetime(2024, 2, 1)


def lake(spark: SparkSession, folder: str) -> Lakehouse:
    return Lakehouse(tune(spark), SampleBronze(spark, folder), at=FIXED_AT)


def bronze(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return lake(spark, folder).table(f"bronze.{name}")


# Change data capture.


def latest_cdc_customer(spark: SparkSession, folder: str) -> DataFrame:
    latest = cdc.latest_cdc(bronze(spark, folder, "customer"), "customer_id")
    return latest.select("record_key", "op", "source_ts_ms", "source_offset", "payload_customer_id", "payload_status")


def latest_event(spark: SparkSession, folder: str) -> DataFrame:
    latest = cdc.latest_by_event_uuid(bronze(spark, folder, "session_event"))
    return latest.select("event_uuid", "event_type", "position_in_list", "source_offset", "ingest_ts")


def bronze_candidates(spark: SparkSession, folder: str) -> DataFrame:
    rows = cdc.bronze_candidates(bronze(spark, folder, "campaign"), "campaign_id")
    return rows.select("record_key", "op", "source_offset", "payload_advertiser_id")


def bronze_valid_events(spark: SparkSession, folder: str) -> DataFrame:
    rows = cdc.bronze_valid_events(bronze(spark, folder, "session_event"))
    return rows.select("event_uuid", "event_type", "source_offset")


def customer_messages(log: DataFrame) -> DataFrame:
    """The customer change log as envelope messages, every delete followed by a tombstone.

    The log is dealt over the tasks by its positions: making and parsing messages is the work, and a file of
    few row groups is read by as few tasks."""
    log = log.repartition("_kafka_metadata_partition", "_kafka_metadata_offset")
    row = F.struct("customer_id", "email", "status", F.unix_millis("updated_at").alias("updated_at"))
    deleted = F.lower("_cdc.op") == "d"
    payload = F.struct(
        F.when(deleted, row).alias("before"),
        F.when(~deleted, row).alias("after"),
        F.struct(F.unix_millis("_cdc.ts").alias("ts_ms"), F.col("_cdc.offset").cast("string").alias("txId")).alias("source"),
        F.lower("_cdc.op").alias("op"),
    )
    text = F.to_json(F.struct(F.struct(F.lit(3).alias("version")).alias("schema"), payload.alias("payload")))
    key = F.to_json(F.struct(F.struct("customer_id").alias("payload")))
    message = F.struct(text.cast("binary").alias("value"), F.lit(0).alias("step"))
    tombstone = F.struct(F.lit(None).cast("binary").alias("value"), F.lit(1).alias("step"))
    exploded = log.select(
        key.cast("binary").alias("key"),
        F.explode(F.when(deleted, F.array(message, tombstone)).otherwise(F.array(message))).alias("m"),
        F.col("_kafka_metadata_partition").alias("partition"),
        F.col("_kafka_metadata_offset").alias("position"),
        F.col("_kafka_metadata_timestamp").alias("timestamp"),
    )
    return exploded.select(
        "key", F.col("m.value").alias("value"), "partition", (F.col("position") + F.col("m.step")).alias("offset"), "timestamp"
    )


def change_envelope_flatten(spark: SparkSession, folder: str) -> DataFrame:
    flat = cdc.flatten_change_envelope(customer_messages(bronze(spark, folder, "customer")), TABLE_SPECS["customer"])
    return flat.select(
        "record_key",
        "op",
        "source_ts_ms",
        "source_offset",
        "schema_version",
        "transaction_id",
        "is_tombstone",
        "payload_customer_id",
        "payload_email",
        "payload_status",
        "payload_updated_at",
    )


def change_envelope_current(spark: SparkSession, folder: str) -> DataFrame:
    """Envelope messages all the way to current customers."""
    spec = TABLE_SPECS["customer"]
    flat = cdc.flatten_change_envelope(customer_messages(bronze(spark, folder, "customer")), spec)
    return silver.business_rows(cdc.envelope_to_bronze(flat, spec), "customer").select("customer_id", "email", "status", "updated_at")


def damaged_messages(log: DataFrame) -> DataFrame:
    """The customer messages with those of five in fifty customers broken, each in its own way."""
    kind = F.floor(F.col("offset") / 4) % 50
    text = F.col("value").cast("string")
    broken = (
        F.when(kind == 1, F.substring(text, 1, 30))
        .when(kind == 2, F.regexp_replace(text, '"op":"[a-z]"', '"was":"u"'))
        .when(kind == 3, F.regexp_replace(text, '"op":"[a-z]"', '"op":"x"'))
        .when(kind == 4, F.regexp_replace(text, '"(before|after)":', '"not_$1":'))
        .when(kind == 5, F.regexp_replace(text, '"customer_id":', '"no_id":'))
        .otherwise(text)
    )
    key = F.when((kind == 5), F.lit(None).cast("binary")).otherwise(F.col("key"))
    return customer_messages(log).withColumns({"value": broken.cast("binary"), "key": key})


def change_envelope_dead(spark: SparkSession, folder: str) -> DataFrame:
    dead = cdc.broken_change_envelopes(damaged_messages(bronze(spark, folder, "customer")), TABLE_SPECS["customer"])
    return dead.select("dead_letter_key", "source_offset", "reason")


def change_envelope_valid(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of damaged messages becomes current customers, in order."""
    spec = TABLE_SPECS["customer"]
    flat = cdc.flatten_change_envelope(damaged_messages(bronze(spark, folder, "customer")), spec)
    return silver.business_rows(cdc.envelope_to_bronze(flat, spec), "customer").select("customer_id", "email", "status", "updated_at")


# Governance.


def masked_customer(spark: SparkSession, folder: str) -> DataFrame:
    rows = silver.business_rows(bronze(spark, folder, "customer"), "customer").drop("created_at", "updated_at", "source_last_change_ts")
    return governance.mask_table(rows, policies.MASKING["customer"])


def tokenized_customer(spark: SparkSession, folder: str) -> DataFrame:
    rows = silver.business_rows(bronze(spark, folder, "customer"), "customer").select("customer_id", "email", "phone", "status")
    return governance.tokenize_table(rows, policies.TOKENIZATION["customer"])


# Data quality.


def dq_keys(spark: SparkSession, folder: str) -> DataFrame:
    house = lake(spark, folder)
    parts = [
        quality.key_checks(house.table(f"silver.{name}_current"), TABLE_SPECS[name].key, f"silver.{name}_current")
        for name in silver.DIMENSIONS
    ]
    return _stack(parts)


def dq_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.duplicates(bronze(spark, folder, "order_item"), "order_item_id")


def _candidates(house: Lakehouse) -> dict[str, tuple[DataFrame, list[quality.RowRule], str]]:
    return {
        "session_event": (silver.candidate_events(house.table("bronze.session_event")), quality.event_rules(), "event_uuid"),
        "order_header": (silver.candidate_orders(house.table("bronze.order_header")), quality.order_rules(), "order_id"),
        "order_item": (silver.candidate_items(house.table("bronze.order_item")), quality.item_rules(), "order_item_id"),
        "customer_session": (
            silver.candidate_sessions(house.table("bronze.customer_session")),
            quality.session_rules(),
            "session_id",
        ),
        "campaign": (silver.business_rows(house.table("bronze.campaign"), "campaign"), quality.campaign_rules(), "campaign_id"),
    }


def _stack(parts: list[DataFrame]) -> DataFrame:
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked


def dq_rule_violations(spark: SparkSession, folder: str) -> DataFrame:
    candidates = _candidates(lake(spark, folder))
    return _stack([quality.violations(frame, rules) for frame, rules, _ in candidates.values()])


def dq_violating_rows(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        quality.violating_rows(frame, rules[0]).select(F.lit(name).alias("dataset"), F.col(key).cast("string").alias("row_key"))
        for name, (frame, rules, key) in _candidates(lake(spark, folder)).items()
    ]
    return _stack(parts)


def dq_quarantine_orders(spark: SparkSession, folder: str) -> DataFrame:
    frame, rules, _ = _candidates(lake(spark, folder))["order_header"]
    _, rejected = quality.quarantine(frame, rules)
    return rejected.select("order_id", "tax_amount", F.array_join("reasons", ",").alias("reasons"))


def dq_relationships_anti(spark: SparkSession, folder: str) -> DataFrame:
    house = lake(spark, folder)
    child = house.table("silver.session_event_clean").select("event_uuid", "campaign_id")
    return joins.orphans(child, house.table("silver.campaign_current"), "campaign_id", "campaign_id")


def _built(spark: SparkSession, folder: str, names) -> tuple[Lakehouse, str, dict[str, int]]:
    """Datasets written to the shared folder, with quarantine and result log beside them."""
    house, root = lake(spark, folder), shared_dir(spark, "built")
    return house, root, house.build(root, names)


RULED = [f"silver.{name}" for name in silver.RULED]
ROW_KEYS = {"customer_session": "session_id", "session_event_clean": "event_uuid", "order_header": "order_id", "order_item": "order_item_id"}


def quarantine_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that a build has rejected, with the rules they break."""
    _, root, _ = _built(spark, folder, RULED)
    parts = []
    for name, key in ROW_KEYS.items():
        rejected = tables.read_rejected(spark, f"{root}/quarantine/silver/{name}")
        parts.append(rejected.select(F.lit(f"silver.{name}").alias("dataset"), F.col(key).cast("string").alias("row_key"), F.array_join("reasons", ",").alias("reasons")))
    return _stack(parts)


def quarantine_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of the four ruled facts, and the rows of the two tables that a build makes of them."""
    house, root, _ = _built(spark, folder, RULED)
    parts = []
    for name, (candidates, _) in silver.RULED.items():
        source = house.table(DATASETS[f"silver.{name}"].inputs[0])
        sides = {"candidates": candidates(source), "clean": house.table(f"silver.{name}"), "rejected": tables.read_rejected(spark, f"{root}/quarantine/silver/{name}")}
        counted = _stack([frame.agg(F.count("*").alias("n")).withColumn("side", F.lit(side)) for side, frame in sides.items()])
        parts.append(counted.groupBy(F.lit(f"silver.{name}").alias("dataset")).agg(*[F.sum(F.when(F.col("side") == side, F.col("n"))).alias(side) for side in sides]))
    return _stack(parts)


def dq_build_results(spark: SparkSession, folder: str) -> DataFrame:
    """Latest result per dataset and rule of what the writes of a build have observed."""
    _, root, _ = _built(spark, folder, [*RULED, "silver.sales_rep_current", "silver.campaign_current"])
    latest = quality.latest_results(spark.read.parquet(f"{root}/metadata/dq_results"))
    return latest.select("dataset", "rule_name", "severity", "passed", F.col("details")["failures"].cast("bigint").alias("failures"), F.col("details")["rows"].cast("bigint").alias("rows"))


def dq_declared_tests(spark: SparkSession, folder: str) -> DataFrame:
    """Every declared test; the tables that several others are made of are written once."""
    daily = [f"silver.{name}_daily_metrics" for name in ("customer", "campaign", "advertiser")]
    house = lake(spark, folder).materialize("silver.session_event_clean", "silver.order_header", "silver.order_item", *daily, "gold.dim_customer")
    return quality.run_declared_tests(house.table)


def dq_content_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and revenue per day, before the rules and in the fact table, compared row by row."""
    house = lake(spark, folder)
    before, fact = silver.candidate_orders(house.table("bronze.order_header")), house.table("gold.fct_orders")
    values = [F.col("order_id"), F.col("total_amount")]
    return quality.content_differences(before, fact, {"metric_date": F.to_date("order_ts")}, values, values, "total_amount")


def dq_content_items(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines per product, before the rules and in the fact table, compared row by row."""
    house = lake(spark, folder)
    before, fact = silver.candidate_items(house.table("bronze.order_item")), house.table("gold.fct_order_items")
    values = [F.col("order_item_id"), F.col("quantity"), F.col("line_amount")]
    return quality.content_differences(before, fact, {"product_id": F.col("product_id")}, values, values, "line_amount")


def dq_generic_tests(spark: SparkSession, folder: str) -> DataFrame:
    house = lake(spark, folder)
    performance = house.table("gold.mart_campaign_performance")
    conversion = house.table("gold.mart_customer_conversion")
    rates = ["view_to_purchase_rate", "click_to_purchase_rate", "cart_to_purchase_rate"]
    parts = [
        quality.run_generic_tests(
            performance,
            "mart_campaign_performance",
            [
                quality.not_null_rule("metric_date"),
                quality.not_null_rule("campaign_id"),
                quality.ratio_rule("ctr"),
                quality.non_negative_rule("attributed_revenue"),
            ],
        ),
        quality.run_generic_tests(
            conversion,
            "mart_customer_conversion",
            [quality.not_null_rule("customer_token"), quality.non_negative_rule("purchases"), *map(quality.ratio_rule, rates)],
        ),
        quality.run_generic_tests(
            house.table("gold.dim_customer"), "dim_customer", [quality.not_null_rule("customer_token")], ["customer_token"]
        ),
        quality.relationship_test(
            house.table("gold.dim_campaign"), house.table("gold.dim_advertiser"), "advertiser_id", "advertiser_id", "dim_campaign"
        ),
        quality.relationship_test(
            house.table("gold.fct_orders"), house.table("gold.dim_customer"), "customer_token", "customer_token", "fct_orders"
        ),
    ]
    return _stack(parts)


def dq_control_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Orders before and after the rules: they differ by what was rejected."""
    house = lake(spark, folder)
    measures = {"orders": F.count("order_id"), "total_amount": F.sum("total_amount").cast("decimal(18,2)")}
    before = silver.candidate_orders(house.table("bronze.order_header"))
    return quality.reconcile(house.table("silver.order_header"), before, measures, measures)


def dq_reconcile_marts(spark: SparkSession, folder: str) -> DataFrame:
    """Marts against their facts: no row unless they disagree."""
    house = lake(spark, folder)
    campaign = {"a": F.sum("attributed_orders").cast("bigint"), "b": F.sum("attributed_revenue").cast("decimal(18,2)")}
    bought = {"a": F.sum("purchases").cast("bigint"), "b": F.sum("order_amount").cast("decimal(18,2)")}
    ordered = {"a": F.count("order_id"), "b": F.sum("total_amount").cast("decimal(18,2)")}
    parts = [
        quality.reconcile(house.table("gold.mart_campaign_performance"), house.table("gold.fct_campaign_daily"), campaign, campaign),
        quality.reconcile(house.table("gold.mart_customer_conversion"), house.table("gold.fct_orders"), bought, ordered),
    ]
    return _stack(parts)


def dq_volume(spark: SparkSession, folder: str) -> DataFrame:
    house = lake(spark, folder)
    names = [f"silver.{name}_daily_metrics" for name in ("customer", "product", "campaign", "advertiser")]
    return _stack([quality.volume(house.table(name), name) for name in names])


COUNTED = (
    *[f"bronze.{name}" for name in TABLE_SPECS],
    "bronze.session_event",
    "silver.customer_current",
    "silver.session_event_clean",
    "silver.order_header",
    "gold.dim_customer",
    "gold.fct_session_events",
    "gold.fct_orders",
    "gold.mart_customer_conversion",
    "gold.mart_campaign_performance",
    "silver.customer_daily_metrics",
    "silver.customer_purchase_features_v1",
    "silver.customer_purchase_realtime_features_v1",
    "silver.campaign_success_features_v1",
    "silver.advertiser_budget_features_v1",
)


def dq_table_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Change logs are counted, all other tables as the writes of a build have observed them."""
    house, _, written = _built(spark, folder, [name for name in COUNTED if not name.startswith("bronze.")])
    logs = quality.table_counts({name: house.table(name) for name in COUNTED if name.startswith("bronze.")})
    seen = [(name, written[name], written[name] > 0) for name in COUNTED if name in written]  # a row a table
    return logs.unionByName(spark.createDataFrame(seen, "dataset string, row_count long, passed boolean"))


def dq_drift_psi(spark: SparkSession, folder: str) -> DataFrame:
    """Second half of the month against the first."""
    events = lake(spark, folder).table("silver.session_event_clean")
    middle = F.lit("2024-01-16").cast("date")
    columns = {
        "event_type": F.col("event_type"),
        "page_type": F.col("page_type"),
        "product_id": quality.bucketed("product_id", [9, 24, 49, 74]),
    }
    drift = quality.drift_psi(events.filter(F.col("event_date") >= middle), events.filter(F.col("event_date") < middle), columns)
    return drift.withColumn("psi", F.round("psi", 9))


def dq_reconcile_layers(spark: SparkSession, folder: str) -> DataFrame:
    house = lake(spark, folder)
    day = F.col("event_date")
    return quality.reconcile_layers(
        {
            "bronze": (house.table("bronze.session_event"), day),
            "silver": (house.table("silver.session_event_clean"), day),
            "gold": (house.table("gold.fct_session_events"), day),
        }
    )


# Online features and scoring.


def parity_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    """Recomputed records against a store with every 7th count changed and every 11th record missing."""
    expected = lake(spark, folder).table("silver.customer_realtime_features_v1_parity")
    stored = expected.filter(F.col("customer_id") % 11 != 0).withColumn(
        "views_24h", F.col("views_24h") + F.when(F.col("customer_id") % 7 == 0, 1).otherwise(0)
    )
    fields = ["views_1h", "views_24h", "ad_clicks_24h", "add_to_cart_24h"]
    return features.parity_mismatches(expected, stored, fields=fields)


def latest_customer_features(spark: SparkSession, folder: str) -> DataFrame:
    table = lake(spark, folder).table("silver.customer_purchase_realtime_features_v1")
    return features.latest_features(table, "customer_id").select(
        "customer_id", "as_of_date", "purchases_30d", "avg_order_value_90d", "days_since_last_purchase"
    )


def latest_campaign_features(spark: SparkSession, folder: str) -> DataFrame:
    table = lake(spark, folder).table("silver.campaign_success_features_v1")
    return features.latest_features(table, "entity_id").select("entity_id", "as_of_date", "impressions_7d", "ctr_7d")


def latest_advertiser_features(spark: SparkSession, folder: str) -> DataFrame:
    table = lake(spark, folder).table("silver.advertiser_budget_features_v1")
    return features.latest_features(table, "entity_id").select("entity_id", "as_of_date", "sales_contacts_14d", "clicks_7d")


def scoring_payload(spark: SparkSession, folder: str) -> DataFrame:
    house = lake(spark, folder)
    offline = features.latest_features(house.table("silver.customer_purchase_realtime_features_v1"), "customer_id")
    return features.scoring_payload(offline, house.table("silver.customer_realtime_features_v1_parity"))


# Fixed weights, so that a score is a formula any engine can check: feature -> (centre, spread, weight).
CAMPAIGN_TERMS = {
    "impressions_7d": (2.0, 1.5, 0.4),
    "clicks_7d": (4.0, 2.0, 0.7),
    "ctr_7d": (1.5, 2.5, -0.2),
    "attributed_orders_30d": (8.0, 4.0, 0.9),
}
CAMPAIGN_INTERCEPT = 0.25


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    rows = lake(spark, folder).table("silver.campaign_success_features_v1")
    return rows.withColumn("p", F.round(models.weighted_score(CAMPAIGN_TERMS, CAMPAIGN_INTERCEPT), 6))


def ml_batch_score(spark: SparkSession, folder: str) -> DataFrame:
    latest = features.latest_features(lake(spark, folder).table("silver.campaign_success_features_v1"), "entity_id")
    scored = latest.withColumn("score", models.weighted_score(CAMPAIGN_TERMS, CAMPAIGN_INTERCEPT))
    return training.score_records(scored, "campaign", "entity_id", FIXED_AT)


def ml_metrics(spark: SparkSession, folder: str) -> DataFrame:
    metrics = evaluation.classifier_metrics(_scored(spark, folder), "label_value", "p", threshold=0.6)
    return metrics.withColumns({name: F.round(name, 9) for name in ("log_loss", "brier_score")})


def ml_auc(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.roc_auc(_scored(spark, folder), "label_value", "p").select(F.round("roc_auc", 9).alias("roc_auc"))


def split_chronological(spark: SparkSession, folder: str) -> DataFrame:
    house = lake(spark, folder).materialize("silver.campaign_success_features_v1")
    rows = house.table("silver.campaign_success_features_v1").select("as_of_date", "entity_id")
    train, test = evaluation.chronological_split(rows)
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


def split_chronological_tokens(spark: SparkSession, folder: str) -> DataFrame:
    house = lake(spark, folder).materialize("silver.customer_purchase_features_v1")
    rows = house.table("silver.customer_purchase_features_v1").select("as_of_date", "customer_token")
    train, test = evaluation.chronological_split(rows, entity="customer_token", ratio=0.75)
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


def model_registry_latest(spark: SparkSession, folder: str) -> DataFrame:
    """A registry with one version per feature group and as-of day; the newest per group."""
    house = lake(spark, folder)
    parts = [
        house.table(f"silver.{name}").select("feature_group", "label_name", "as_of_date", "label_value")
        for name in ("campaign_success_features_v1", "advertiser_budget_features_v1")
    ]
    versions = _stack(parts).groupBy("feature_group", "label_name", "as_of_date").agg(
        F.count("*").alias("train_rows"), F.sum("label_value").alias("positives")
    )
    registry = versions.select(
        "feature_group",
        "label_name",
        F.col("as_of_date").cast("timestamp").alias("trained_at"),
        F.concat_ws("/", F.lit("manifests"), "feature_group", F.col("as_of_date").cast("string")).alias("artifact_manifest_uri"),
        "train_rows",
        "positives",
    )
    return training.latest_models(registry)


def ml_train_score(spark: SparkSession, folder: str) -> DataFrame:
    """Fit on the campaign features, score every row of the later part."""
    house = lake(spark, folder).materialize("silver.campaign_success_features_v1")
    rows = house.table("silver.campaign_success_features_v1")
    early, late = evaluation.chronological_split(rows)
    fitted = models.fit(early, models.feature_columns(rows))
    return models.score(fitted, late).select("as_of_date", "entity_id", "label_value", F.round("score", 4).alias("score"))


def online_key(spark: SparkSession, folder: str) -> DataFrame:
    """Store keys of the online records."""
    table = lake(spark, folder).table("silver.customer_realtime_features_v1_parity")
    key = wire.pattern_key(policies.ONLINE_FEATURES["key_pattern"], "customer_id", "customer_id")
    return table.select(key.alias("online_key"), "views_24h", "ttl_seconds")


QUERIES: dict[str, Query] = {
    build.__name__: build
    for build in (
        latest_cdc_customer,
        latest_event,
        bronze_candidates,
        bronze_valid_events,
        change_envelope_flatten,
        change_envelope_current,
        change_envelope_dead,
        change_envelope_valid,
        masked_customer,
        tokenized_customer,
        dq_keys,
        dq_duplicates,
        dq_rule_violations,
        dq_violating_rows,
        dq_quarantine_orders,
        dq_relationships_anti,
        dq_generic_tests,
        dq_declared_tests,
        quarantine_tables,
        quarantine_balance,
        dq_build_results,
        dq_content_orders,
        dq_content_items,
        dq_control_totals,
        dq_reconcile_marts,
        dq_volume,
        dq_table_counts,
        dq_drift_psi,
        dq_reconcile_layers,
        parity_mismatch,
        latest_customer_features,
        latest_campaign_features,
        latest_advertiser_features,
        scoring_payload,
        online_key,
        ml_batch_score,
        ml_metrics,
        ml_auc,
        split_chronological,
        split_chronological_tokens,
        model_registry_latest,
        ml_train_score,
    )
}
