"""Training runs, model registry and score records (ML1-ML5, SNK8-SNK10, SRT2)."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import UTC, datetime
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import policies
from tidemark.functions.wire import pattern_key
from tidemark.operators import model as models
from tidemark.operators.cdc import latest_row
from tidemark.operators.evaluation import chronological_split, classifier_metrics, roc_auc
from tidemark.sources.tables import write_table

# Columns of the model registry.
REGISTRY_SCHEMA = (
    "feature_group string, label_name string, feature_definition_version string, trained_at timestamp, "
    "artifact_manifest_uri string, artifact_model_uri string, artifact_metrics_uri string, artifact_dataset_uri string, "
    "train_rows bigint, test_rows bigint, accuracy double, precision double, recall double, roc_auc double, status string"
)


def evaluate(df: DataFrame, label: str = "label", score: str = "p") -> dict[str, Any]:
    """All classifier metrics of a scored frame as plain values (ML3, ML4)."""
    values = classifier_metrics(df, label, score).first().asDict()
    return {**values, "roc_auc": roc_auc(df, label, score).first()["roc_auc"]}


def train(features: DataFrame, group: str) -> tuple[PipelineModel, dict[str, Any]]:
    """Fit on the earlier rows, measure on the later ones."""
    about = policies.FEATURE_GROUPS[group]
    rows = models.normalize_training_rows(features, group)
    early, late = chronological_split(rows, "as_of_date", about["entity"])
    names = models.feature_columns(features)
    fitted = models.fit(early, names)
    tested = models.score(fitted, late, "p").select(F.col("label_value").alias("label"), "p")
    metrics = evaluate(tested)
    metrics |= {
        "feature_group": group,
        "label_name": about["label"],
        "feature_names": names,
        "feature_definition_version": about["version"],
        "train_rows": early.count(),
        "test_rows": metrics["support"],
    }
    return fitted, metrics


def _write_json(spark: SparkSession, value: Mapping, path: str) -> None:
    spark.createDataFrame([(json.dumps(value, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)


def read_json(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path).first()[0])


def load_model(spark: SparkSession, manifest_path: str) -> PipelineModel:
    """The model a manifest points to."""
    return PipelineModel.load(read_json(spark, manifest_path)["artifact_uris"]["model"])


def publish_training_run(
    features: DataFrame, group: str, root: str, registry: str | None = None, status: str = "candidate"
) -> dict[str, Any]:
    """Write the dataset, train from it as written, then write model, metrics and manifest, and
    register the version (SNK10, SNK8).  The plan behind the features runs once."""
    spark = features.sparkSession
    trained_at = datetime.now(UTC).replace(microsecond=0)
    stem = f"{group}_{policies.FEATURE_GROUPS[group]['label']}_{trained_at:%Y%m%dT%H%M%SZ}"
    uris = {kind: f"{root.rstrip('/')}/{kind}/{stem}" for kind in ("datasets", "models", "metrics", "manifests")}
    features.write.mode("overwrite").json(uris["datasets"])
    fitted, metrics = train(spark.read.schema(features.schema).json(uris["datasets"]), group)
    fitted.write().overwrite().save(uris["models"])
    _write_json(spark, {**metrics, "trained_at": trained_at.isoformat()}, uris["metrics"])
    manifest = {
        "feature_group": group,
        "label_name": metrics["label_name"],
        "feature_definition_version": metrics["feature_definition_version"],
        "trained_at": trained_at.isoformat(),
        "artifact_uris": {kind.rstrip("s") if kind != "metrics" else kind: uri for kind, uri in uris.items()},
    }
    _write_json(spark, manifest, uris["manifests"])
    if registry:
        register_model(spark, registry, {**manifest, **metrics, "trained_at": trained_at, "status": status})
    return {"model": fitted, "metrics": metrics, "manifest": uris["manifests"]}


def register_model(spark: SparkSession, table: str, record: Mapping[str, Any]) -> None:
    """Append one version to the registry (SNK8, ML5)."""
    uris = record.get("artifact_uris", {})
    row = (
        record["feature_group"],
        record["label_name"],
        record["feature_definition_version"],
        record["trained_at"],
        *[uris.get(kind) for kind in ("manifest", "model", "metrics", "dataset")],
        record["train_rows"],
        record["test_rows"],
        float(record["accuracy"]),
        float(record["precision"]),
        float(record["recall"]),
        float(record["roc_auc"] or 0.0),
        record.get("status", "candidate"),
    )
    write_table(spark.createDataFrame([row], REGISTRY_SCHEMA), table, mode="append")


def latest_models(registry: DataFrame) -> DataFrame:
    """The newest version of every feature group (SRT2, ML5)."""
    order = [F.col("trained_at").desc_nulls_last(), F.col("artifact_manifest_uri").desc_nulls_last()]
    return latest_row(registry, [F.col("feature_group")], order)


def latest_model(registry: DataFrame, group: str) -> DataFrame:
    """The newest version of one feature group, one row (SRT2)."""
    return latest_models(registry.filter(F.col("feature_group") == group))


def score_records(
    scored: DataFrame, group: str, entity: str, scored_at: datetime | None = None
) -> DataFrame:
    """Keyed records of every scored entity (column ``score``), six decimals, with an expiry (ML2, SNK9)."""
    name, score_name, suffix, source = policies.SCORES[group]
    at = F.current_timestamp() if scored_at is None else F.lit(scored_at).cast("timestamp")
    return scored.select(
        pattern_key(f"scores:{name}:{{id}}:{suffix}:v1", "id", entity).alias("score_key"),
        F.col(entity).alias(f"{name}_id"),
        F.lit(score_name).alias("score_name"),
        F.round("score", 6).alias("score"),
        at.alias("scored_at"),
        F.lit(source).alias("feature_source"),
        F.timestamp_seconds(F.unix_seconds(at) + policies.SCORE_TTL_SECONDS).alias("expires_at"),
    )


def write_scores(scores: DataFrame, table: str) -> None:
    """Append a scoring run; readers take the latest row per key that has not expired (SNK9)."""
    write_table(scores, table, mode="append")


def live_scores(scores: DataFrame, now: datetime | None = None) -> DataFrame:
    """Current value per key, expired ones left out."""
    latest = latest_row(scores, [F.col("score_key")], [F.col("scored_at").desc_nulls_last(), F.col("score").desc_nulls_last()])
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return latest.filter(F.col("expires_at") > at)
