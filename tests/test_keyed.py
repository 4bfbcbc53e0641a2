"""Keyed tables of a stream: levels, manifests, attempts that end half way."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators.cdc import latest_row
from tidemark.streaming import keyed, tables

COLUMNS = "id long, v long, at long"


def key():
    return [F.col("id")]


def order():
    return [F.col("at").desc_nulls_last()]


def put(spark, path, batch_id, rows, columns=COLUMNS, **options):
    keyed.upsert(spark.createDataFrame(rows, columns).coalesce(1), batch_id, path, key(), order(), **options)


def current(spark, path):
    newest = latest_row(keyed.live_rows(spark, path), key(), [*order(), F.col("batch_id").desc()])
    return {row.id: row.v for row in newest.collect()}


def on_disk(path):
    return sorted(str(folder.relative_to(path)) for folder in Path(path).glob("level=*/*"))


def test_many_batches_leave_few_folders(spark, tmp_path):
    path, expected, seen = f"{tmp_path}/table", {}, 0
    for batch_id in range(28):
        # Every third batch brings a change that is older than what the table holds.
        at = 1000 - batch_id if batch_id % 3 == 2 and batch_id > 2 else 1000 + batch_id
        rows = [(name, 100 * batch_id + name, at) for name in (batch_id % 5, 5 + batch_id)]
        put(spark, path, batch_id, rows, width=3, keep=2)
        for name, value, at in rows:
            if name not in expected or at >= expected[name][1]:
                expected[name] = (value, at)
        seen = max(seen, len(keyed.live_folders(spark, path)))
    folders = keyed.live_folders(spark, path)
    assert seen <= 6 and [folder.level for folder in folders] == [3, 0]
    assert [(folder.first, folder.last) for folder in folders] == [(0, 26), (27, 27)]
    assert current(spark, path) == {name: value for name, (value, _) in expected.items()}
    assert len(on_disk(path)) <= 8 and len(list(Path(f"{path}-live").glob("*.json"))) == 2
    assert keyed.live_rows(spark, path).filter("batch_id < 27").groupBy("id").count().filter("count > 1").count() == 0


@pytest.mark.parametrize("step", ["_write", "_commit"])
def test_an_attempt_that_ends_while_folding(spark, tmp_path, monkeypatch, step):
    path = f"{tmp_path}/table"
    put(spark, path, 0, [(1, 10, 1), (2, 20, 1)], width=2)
    before = current(spark, path)
    whole = getattr(keyed, step)

    def broken(*arguments):
        if step == "_commit" or arguments[2] == 1:
            raise OSError("lost")
        return whole(*arguments)

    monkeypatch.setattr(keyed, step, broken)
    with pytest.raises(OSError):
        put(spark, path, 1, [(1, 11, 2), (3, 30, 2)], width=2)
    assert current(spark, path) == before and len(on_disk(path)) > 1
    monkeypatch.setattr(keyed, step, whole)
    put(spark, path, 1, [(1, 11, 2), (3, 30, 2)], width=2)
    assert current(spark, path) == {1: 11, 2: 20, 3: 30}
    assert [folder.level for folder in keyed.live_folders(spark, path)] == [1]
    assert len(on_disk(path)) == 2  # batch 0 for readers of its manifest, the folded one


def test_repeated_and_older_batches(spark, tmp_path):
    path = f"{tmp_path}/table"
    put(spark, path, 0, [(1, 10, 1)])
    put(spark, path, 4, [(1, 11, 1), (1, 9, 0)])
    put(spark, path, 4, [(1, 12, 1)])
    assert current(spark, path) == {1: 11}
    with pytest.raises(ValueError, match="new checkpoint"):
        put(spark, path, 3, [(1, 13, 9)])
    with pytest.raises(ValueError, match="batch_id"):
        put(spark, path, 5, [(1, 1, 1, 1)], COLUMNS + ", batch_id long")


def test_a_reader_keeps_its_folders(spark, tmp_path):
    path = f"{tmp_path}/table"
    put(spark, path, 0, [(1, 10, 1)], width=2)
    reader = keyed.live_rows(spark, path)
    for batch_id in (1, 2, 3):
        put(spark, path, batch_id, [(1, 10 + batch_id, 1 + batch_id)], width=2)
    assert [row.v for row in reader.collect()] == [10] and current(spark, path) == {1: 13}


def test_empty_batches_nulls_and_new_columns(spark, tmp_path):
    path = f"{tmp_path}/table"
    assert keyed.live_rows(spark, path) is None and keyed.live_folders(spark, path) is None
    put(spark, path, 0, [])
    assert current(spark, path) == {}
    put(spark, path, 1, [(None, 1, None), (None, 2, 5), (7, None, None)])
    put(spark, path, 2, [(8, 3, 1, "new")], COLUMNS + ", note string", width=3)
    assert current(spark, path) == {None: 2, 7: None, 8: 3}
    assert {row.id: row.note for row in keyed.live_rows(spark, path).collect()} == {None: None, 7: None, 8: "new"}
    with pytest.raises(ValueError, match="column v"):
        put(spark, path, 3, [(8, "x", 1)], "id long, v string, at long")


def test_deletes_outlive_folding(spark, tmp_path):
    columns = "record_key string, payload_id long, op string, is_tombstone boolean, source_ts_ms long, ingest_ts timestamp, source_offset long, source_partition int"
    path = f"{tmp_path}/table"
    for batch_id, (op, ms) in enumerate([("c", 1), ("d", 30), ("u", 20)]):
        row = spark.createDataFrame([("k", 1, op, False, ms, None, ms, 0)], columns)
        keyed.upsert(row, batch_id, path, [F.col("record_key")], tables._change_order(), width=2)
    assert tables.current_state(spark, path, "id").count() == 0
