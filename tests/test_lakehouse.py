from datetime import date, datetime

import duckdb
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

import __spark_entry__ as registry
from tidemark.plans.lakehouse import DATASETS, Lakehouse
from tidemark.sources import tables
from tidemark.sources.sample import SampleBronze
from tools.check_queries import TABLES, rows

AT = datetime(2024, 2, 1)


def test_build_backfill_and_lineage(spark, tmp_path, sample_folder):
    house = Lakehouse(spark, SampleBronze(spark, sample_folder), at=AT)
    lazy = house.table("gold.mart_customer_conversion")
    expected = lazy.count()
    written = house.build(f"{tmp_path}/lake", ["gold.mart_customer_conversion"])
    assert list(written)[-1] == "gold.mart_customer_conversion" and written["gold.mart_customer_conversion"] == expected
    path = f"{tmp_path}/lake/gold/mart_customer_conversion"
    stored = spark.read.parquet(path)
    assert stored.select(*lazy.columns).exceptAll(lazy).count() == 0
    lineage = spark.read.parquet(f"{tmp_path}/lake/metadata/lineage")
    assert lineage.count() == len(written)
    assert lineage.filter(F.col("dataset") == path).first().row_count == expected

    daily = f"{tmp_path}/lake/silver/customer_daily_metrics"
    before = spark.read.parquet(daily).groupBy("metric_date").count().orderBy("metric_date").collect()
    house.backfill(f"{tmp_path}/lake", "silver.customer_daily_metrics", "2024-01-05", "2024-01-07")
    after = spark.read.parquet(daily).groupBy("metric_date").count().orderBy("metric_date").collect()
    assert before == after

    pruned = spark.read.parquet(daily).filter(F.col("metric_date") == date(2024, 1, 5))
    assert "PartitionFilters: [isnotnull(metric_date" in pruned._jdf.queryExecution().toString()


def test_backfill_empties_days_without_rows(spark, tmp_path):
    days = [date(2024, 1, n) for n in (1, 2, 3)]
    frame = spark.createDataFrame([(n, day) for n, day in enumerate(days, 1)], "id int, day date")
    path = f"{tmp_path}/t"
    tables.write_table(frame, path, partition_by=["day"])
    tables.backfill(frame.filter("id <> 2"), path, "day", "2024-01-02", "2024-01-03")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 3]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_partitioned_writes_keep_files_open(spark, tmp_path):
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting)
    seen = F.udf(lambda _: TaskContext.get().getLocalProperty(setting), "string")
    days = tables.OPEN_FILES + 8
    frame = spark.range(0, 3 * days + 1, 1, 1).select("id", F.when(F.col("id") > 0, F.col("id") % days).alias("day"))
    marked = frame.withColumn("seen", seen("id"))
    tables.write_table(marked, f"{tmp_path}/t", partition_by=["day"])
    verdict = F.when(F.col("id") % 5 == 0, "bad").otherwise("clean")
    tables.write_split(marked.coalesce(1), verdict, f"{tmp_path}/clean", f"{tmp_path}/bad", ["day"])
    tables.write_split(marked, verdict, f"{tmp_path}/whole", f"{tmp_path}/broken")
    expected = sorted((r.id, -1 if r.day is None else r.day) for r in frame.collect())
    for paths in (["t"], ["clean", "bad"], ["whole", "broken"]):
        got = [r for path in paths for r in spark.read.parquet(f"{tmp_path}/{path}").collect()]
        assert sorted((r.id, -1 if r.day is None else r.day) for r in got) == expected
        assert {r.seen for r in got} == {str(tables.OPEN_FILES)}
    assert spark.conf.get(setting) == before


def test_catalog_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE shop LOCATION '{tmp_path}/shop'")
    try:
        frame = spark.createDataFrame([(1, date(2024, 1, 1)), (2, date(2024, 1, 2))], "id int, day date")
        tables.write_table(frame, "shop.t", partition_by=["day"])
        tables.write_table(frame, "shop.t", mode="append", partition_by=["day"])
        assert tables.maybe_table(spark, "shop.t").count() == 4 and tables.maybe_table(spark, "shop.u") is None
        tables.backfill(frame.withColumn("id", F.lit(9)), "shop.t", "day", "2024-01-02", "2024-01-02")
        assert sorted(r.id for r in tables.read_table(spark, "shop.t").collect()) == [1, 1, 9]
        tables.backfill(frame.limit(0), "shop.t", "day", "2024-01-02", "2024-01-02")
        assert sorted(r.id for r in tables.read_table(spark, "shop.t").collect()) == [1, 1]
        assert tables.write_with_lineage(frame, "shop.v", "job", ["a"], "r1", "shop.lineage") == 2
        assert tables.read_table(spark, "shop.lineage").first().row_count == 2
    finally:
        spark.sql("DROP DATABASE shop CASCADE")


def test_command_line_over_bronze_tables(spark, tmp_path, sample_folder):
    from tidemark.__main__ import main

    sample = SampleBronze(spark, sample_folder)
    for name, table in (("session_event", "bronze_session_event_raw"), ("order_header", "bronze_order_header_cdc")):
        tables.write_table(sample.table(name), f"{tmp_path}/bronze/{table}")
    common = ["--bronze", f"{tmp_path}/bronze/{{table}}", "--root", f"{tmp_path}/lake"]
    written = main([*common, "--datasets", "silver.customer_daily_metrics"])
    assert set(written) == {"silver.session_event_clean", "silver.order_header", "silver.customer_daily_metrics"}
    expected = Lakehouse(spark, sample, at=AT).table("silver.customer_daily_metrics")
    stored = spark.read.parquet(f"{tmp_path}/lake/silver/customer_daily_metrics")
    columns = [name for name in expected.columns if name != "processed_ts"]
    assert stored.select(columns).exceptAll(expected.select(columns)).count() == 0
    main([*common, "--backfill", "silver.customer_daily_metrics", "--start", "2024-01-02", "--end", "2024-01-03"])
    assert spark.read.parquet(f"{tmp_path}/lake/silver/customer_daily_metrics").count() == expected.count()


def test_definition_files(tmp_path):
    import json

    from tidemark import policies

    entry = {
        "name": "f1",
        "entity_key": "customer_id",
        "store_key_pattern": "f:{customer_id}",
        "ttl_seconds": "60",
        "sources": [{"filters": {"event_type": ["ad_click"]}}],
        "aggregations": [
            {"field": "event_uuid", "function": "count_distinct", "as": "n", "window_seconds": 5, "when": {"event_type": "ad_click"}}
        ],
    }
    (tmp_path / "d.json").write_text(json.dumps({"features": [entry]}))
    (loaded,) = policies.load_definitions(f"{tmp_path}/d.json")
    got = policies.online_definition(loaded)
    assert got["ttl_seconds"] == 60 and got["key_pattern"] == "f:{customer_id}" and got["event_types"] == ("ad_click",)
    assert got["aggregations"][0]["event_type"] == "ad_click"


def test_ranged_lakehouse_limits_facts(spark, sample_folder):
    house = Lakehouse(spark, SampleBronze(spark, sample_folder), start="2024-01-03", end="2024-01-04", at=AT)
    days = {r[0] for r in house.table("silver.session_event_clean").select("event_date").distinct().collect()}
    assert days == {date(2024, 1, 3), date(2024, 1, 4)}


def test_every_dataset_resolves(spark, sample_folder):
    house = Lakehouse(spark, SampleBronze(spark, sample_folder), at=AT)
    for name in DATASETS:
        assert house.table(name).columns


def test_scans_read_only_what_is_used(spark, sample_folder):
    house = Lakehouse(spark, SampleBronze(spark, sample_folder), at=AT)
    # A filter on the key of a change log goes below its versions and reaches the scan.
    log = house.table("bronze.sales_activity").filter("sales_activity_id = 5")._jdf.queryExecution().toString()
    assert "EqualTo(o_orderkey,5)" in log[log.index("PushedFilters") :].split("ReadSchema")[0]
    plan = house.table("silver.sales_activity")._jdf.queryExecution().toString()
    schema = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "o_totalprice" not in schema and "o_orderstatus" not in schema
    daily = house.table("silver.customer_daily_metrics")._jdf.queryExecution().toString()
    assert "o_orderpriority" not in daily[daily.index("ReadSchema") :] and "CartesianProduct" not in daily


def test_tables_and_records(spark, tmp_path):
    frame = spark.createDataFrame([(1, date(2024, 1, 1)), (2, date(2024, 1, 2))], "id int, day date")
    path = f"{tmp_path}/t"
    assert tables.maybe_table(spark, path) is None and tables.maybe_table(spark, "no_such_table") is None
    tables.write_table(frame, path, partition_by=["day"])
    tables.write_table(frame, path, mode="append", partition_by=["day"])
    assert tables.maybe_table(spark, path).count() == 4
    tables.backfill(frame.withColumn("id", F.lit(9)), path, "day", "2024-01-02", "2024-01-02")
    assert sorted(r.id for r in tables.read_table(spark, path).collect()) == [1, 1, 9]
    (tmp_path / "r.json").write_text('[{"a": 1},\n {"a": 2}]')
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    (tmp_path / "r.csv").write_text("a,b\n1,x\n")
    assert tables.read_records(spark, f"{tmp_path}/r.json").count() == 2
    assert tables.read_records(spark, f"{tmp_path}/r.jsonl", "a bigint").count() == 3
    assert tables.read_records(spark, f"{tmp_path}/r.csv").first().b == "x"


QUICK = [
    "silver_customer",
    "customer_daily",
    "campaign_daily",
    "advertiser_daily",
    "bi_funnel_long",
    "bi_channel_contribution",
    "feat_customer_pit",
    "feat_campaign",
    "parity_mismatch",
    "dq_quarantine_orders",
    "ml_auc",
    "split_chronological",
]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sample_folder, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sample_folder}/{table}.parquet'")
    got = registry.queries()[name](spark, sample_folder).toPandas()
    want = db.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_twins_belong_to_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    assert registry.entry(spark).columns == ["metric_date", "stage_name", "stage_total"]
