"""Keyed tables of a stream, folded in levels, with a manifest that names the live folders (STR9, SNK6).

    <path>/level=<l>/<first>-<last>-<attempt>   newest row per key of the batches first to last
    <path>-live/<batch>.json                    the folders that are the table after that batch

A batch adds a folder of level 0.  ``width`` folders of one level at the end of the list are folded
into one of the next level by the batch that fills them.  After n batches a reader therefore merges
at most (width - 1) * log_width(n) + width folders, and a row is rewritten log_width(n) times at most.

The manifest is written aside and renamed once all folders of its batch are complete: readers
see the table before a batch or after it.  What an ended attempt left behind is named by no manifest
and goes with the next commit.  Deletes stay as rows, so that an older change that comes later loses.
One stream writes a table; a new checkpoint counts its batches from 0 again and needs a new table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import NamedTuple
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.cdc import latest_row
from tidemark.sources.tables import delete_path, move_path

WIDTH = 4
KEEP = 10
BATCH = T.StructField("batch_id", T.LongType())


class Folder(NamedTuple):
    """Where the newest rows of the batches ``first`` to ``last`` are, below the table's path."""

    name: str
    level: int
    first: int
    last: int


class Manifest(NamedTuple):
    """The table after a batch."""

    folders: list[Folder]
    schema: T.StructType | None


def _place(spark: SparkSession, path: str):
    """Path as an object of the file system, and that file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    place, files = _place(spark, path)
    return [entry.getPath().getName() for entry in files.listStatus(place)] if files.exists(place) else []


def _versions(spark: SparkSession, path: str) -> list[int]:
    stems = [name.removesuffix(".json") for name in _names(spark, f"{path}-live") if name.endswith(".json")]
    return sorted(int(stem) for stem in stems if stem.isdecimal())


def _version_path(path: str, version: int) -> str:
    return f"{path}-live/{version:012d}.json"


def _load(spark: SparkSession, path: str, versions: Sequence[int]) -> list[Manifest]:
    texts = spark.read.text([_version_path(path, version) for version in versions], wholetext=True).collect()
    entries = [json.loads(row[0]) for row in texts]
    return [Manifest([Folder(*folder) for folder in entry["folders"]], T.StructType.fromJson(entry["schema"])) for entry in entries]


def _current(spark: SparkSession, path: str) -> Manifest | None:
    versions = _versions(spark, path)
    return _load(spark, path, versions[-1:])[0] if versions else None


def _commit(spark: SparkSession, path: str, version: int, manifest: Manifest) -> None:
    """Publish the manifest of a batch by one rename."""
    text = json.dumps({"folders": manifest.folders, "schema": manifest.schema.jsonValue()})
    aside = f"{path}-live/.{uuid4().hex}"
    place, files = _place(spark, aside)
    stream = files.create(place)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    move_path(spark, aside, _version_path(path, version))


def _widened(known: T.StructType | None, new: T.StructType) -> T.StructType:
    """Columns of the table and of a batch; a column that changes its type is refused."""
    fields = {field.name: field for field in known.fields} if known else {}
    for field in new.fields:
        if field.name in fields and fields[field.name].dataType != field.dataType:
            raise ValueError(f"column {field.name} was {fields[field.name].dataType}, now {field.dataType}")
        fields.setdefault(field.name, field)
    return T.StructType([T.StructField(field.name, field.dataType) for field in fields.values()])


def _read(spark: SparkSession, path: str, manifest: Manifest) -> DataFrame:
    return spark.read.schema(manifest.schema).parquet(*[f"{path}/{folder.name}" for folder in manifest.folders])


def _write(rows: DataFrame, path: str, level: int, first: int, last: int) -> Folder:
    folder = Folder(f"level={level}/{first}-{last}-{uuid4().hex}", level, first, last)
    rows.write.parquet(f"{path}/{folder.name}")
    return folder


def _is_full(folders: Sequence[Folder], width: int) -> bool:
    return len(folders) >= width and len({folder.level for folder in folders[-width:]}) == 1


def _clean(spark: SparkSession, path: str, keep: int) -> None:
    """Drop manifests beyond the last ``keep`` and the folders that no kept one names."""
    versions = _versions(spark, path)
    for version in versions[:-keep]:
        delete_path(spark, _version_path(path, version))
    named = {folder.name for kept in _load(spark, path, versions[-keep:]) for folder in kept.folders}
    for level in _names(spark, path):
        for name in _names(spark, f"{path}/{level}"):
            if f"{level}/{name}" not in named:
                delete_path(spark, f"{path}/{level}/{name}")


def upsert(
    batch: DataFrame,
    batch_id: int,
    path: str,
    keys: Sequence[Column],
    order: Sequence[Column] = (),
    width: int = WIDTH,
    keep: int = KEEP,
    narrow: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Add a micro-batch to the table at ``path`` and fold what it fills.

    ``order`` says which row of a key is the newest; the later batch decides between equals.  A batch
    that is already there is left as it is.  Readers that started within the last ``keep`` batches keep
    their folders.  ``narrow`` drops rows of folded folders that no reader needs any more.
    """
    if width < 2 or keep < 1:
        raise ValueError("width must be 2 or more, keep 1 or more")
    if BATCH.name in batch.columns:
        raise ValueError("the table keeps a column named batch_id of its own")
    spark, path = batch.sparkSession, path.rstrip("/")
    versions = _versions(spark, path)
    if versions and batch_id < versions[-1]:
        raise ValueError(f"batch {batch_id} comes after batch {versions[-1]}: a new checkpoint needs a new table")
    if batch_id in versions:
        return
    before = _current(spark, path) or Manifest([], None)
    schema = _widened(before.schema, T.StructType([*batch.schema.fields, BATCH]))
    newest = [*order, F.col(BATCH.name).desc()]
    rows = latest_row(batch.withColumn(BATCH.name, F.lit(batch_id).cast("bigint")), list(keys), newest)
    folders = [*before.folders, _write(rows, path, 0, batch_id, batch_id)]
    while _is_full(folders, width):
        part = folders[-width:]
        folded = _read(spark, path, Manifest(part, schema))
        rows = latest_row(narrow(folded) if narrow else folded, list(keys), newest)
        folders[-width:] = [_write(rows, path, part[0].level + 1, part[0].first, part[-1].last)]
    _commit(spark, path, batch_id, Manifest(folders, schema))
    _clean(spark, path, keep)


def live_folders(spark: SparkSession, path: str) -> list[Folder] | None:
    """Folders that make up the table now; None where no table of this kind is."""
    manifest = _current(spark, path.rstrip("/"))
    return manifest.folders if manifest else None


def live_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of the live folders with their ``batch_id``, one or more a key; None where no table of this kind is."""
    manifest = _current(spark, path.rstrip("/"))
    return _read(spark, path.rstrip("/"), manifest) if manifest else None
