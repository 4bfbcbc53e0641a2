"""Masking, tokenising, ownership and lineage (GOV1-GOV4, PRJ8)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import policies
from tidemark.functions.privacy import MASKS, token
from tidemark.operators.cdc import latest_row

LINEAGE_SCHEMA = (
    "run_id string, job_name string, dataset string, upstream array<string>, row_count bigint, "
    "duration_ms bigint, recorded_at timestamp"
)


def mask_table(df: DataFrame, policy: dict[str, str | None]) -> DataFrame:
    """Replace restricted columns by ``<column>_masked``, drop those without a mask (GOV1)."""
    columns = []
    for name in df.columns:
        if name not in policy:
            columns.append(F.col(f"`{name}`"))
        elif policy[name] is not None:
            columns.append(MASKS[policy[name]](F.col(f"`{name}`")).alias(f"{name}_masked"))
    return df.select(*columns)


def tokenize_table(df: DataFrame, policy: dict[str, str], salt: str | None = None) -> DataFrame:
    """Replace identifying columns by tokens (GOV2)."""
    return df.select(
        *[token(F.col(f"`{name}`"), salt).alias(policy[name]) if name in policy else F.col(f"`{name}`") for name in df.columns]
    )


def owner_for(dataset: str) -> str:
    """Owning team of ``layer.table`` (GOV3)."""
    return next((owner for owner, owned in policies.OWNERS.items() if dataset in owned), policies.DEFAULT_OWNER)


def sensitivity_for(dataset: str) -> str:
    """Sensitivity class of ``layer.table``: restricted tables first, then the layer's default (GOV3)."""
    if dataset in policies.RESTRICTED:
        return policies.RESTRICTED_CLASS
    return policies.SENSITIVITY_BY_LAYER.get(dataset.partition(".")[0], "internal")


def enrich_metadata(df: DataFrame, dataset: str) -> DataFrame:
    """Owner and sensitivity as constant columns (PRJ8)."""
    return df.withColumns(
        {"data_owner": F.lit(owner_for(dataset)), "sensitivity_class": F.lit(sensitivity_for(dataset))}
    )


def lineage_record(
    spark: SparkSession,
    run_id: str,
    job_name: str,
    dataset: str,
    upstream: list[str],
    row_count: int,
    duration_ms: int,
    recorded_at: datetime,
) -> DataFrame:
    """One lineage row, to be appended to the lineage table (GOV4)."""
    row = (run_id, job_name, dataset, upstream, row_count, duration_ms, recorded_at)
    return spark.createDataFrame([row], LINEAGE_SCHEMA)


def latest_runs(lineage: DataFrame) -> DataFrame:
    """Latest lineage row per dataset (GOV4)."""
    order = [F.col("recorded_at").desc_nulls_last(), F.col("run_id").desc_nulls_last()]
    return latest_row(lineage, [F.col("dataset")], order)
