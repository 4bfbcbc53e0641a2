"""Build datasets from Bronze tables: spark-submit or ``python -m tidemark``.

    python -m tidemark --bronze 'lake.bronze.{table}' --root s3a://bucket/lake --datasets gold.mart_customer_conversion
    python -m tidemark --bronze '/data/bronze/{table}' --root /data/lake --layer silver --start 2024-01-01 --end 2024-01-31
    python -m tidemark --bronze '/data/bronze/{table}' --root /data/lake --backfill silver.customer_daily_metrics \\
        --start 2024-01-05 --end 2024-01-07
"""

from __future__ import annotations

import argparse

from tidemark.plans.lakehouse import DATASETS, Lakehouse
from tidemark.session import build_session
from tidemark.sources.tables import BronzeTables


def main(argv: list[str] | None = None) -> dict[str, int]:
    parser = argparse.ArgumentParser(prog="tidemark", description="Build Silver, Gold and feature tables from Bronze.")
    parser.add_argument("--bronze", required=True, help="table name or path with {table}")
    parser.add_argument("--root", required=True, help="folder for the written tables")
    parser.add_argument("--datasets", nargs="*", choices=sorted(DATASETS), help="datasets to build with their inputs")
    parser.add_argument("--layer", choices=["silver", "gold", "bi"], help="build every dataset of a layer")
    parser.add_argument("--backfill", choices=sorted(DATASETS), help="replace only the days from start to end")
    parser.add_argument("--start")
    parser.add_argument("--end")
    options = parser.parse_args(argv)

    spark = build_session("tidemark")
    bronze = BronzeTables(spark, options.bronze)
    if options.backfill:
        # Windows look back and snapshots look at everything, so inputs are not cut to the range.
        Lakehouse(spark, bronze).backfill(options.root, options.backfill, options.start, options.end)
        return {}
    house = Lakehouse(spark, bronze, options.start, options.end)
    names = options.datasets or [name for name, about in DATASETS.items() if options.layer in (None, about.layer)]
    return house.build(options.root, names)


if __name__ == "__main__":
    for name, rows in main().items():
        print(f"{name}\t{rows}")
