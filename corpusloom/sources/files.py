"""Names and sizes of files, empty ones included (Spark's file sources leave those out)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import settle


def plain(path: Column) -> Column:
    """A local path without its scheme; other paths as they are."""
    return F.regexp_replace(path, "^file:/+", "/")


def store_of(path: str):
    """(Arrow file system, path in it) of an address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else fs.FileSystem.from_uri(f"/{path.removeprefix('file:').lstrip('/')}")


def write_bytes(path: str, data: bytes) -> None:
    """A file of these bytes in any store that Arrow knows by its address; folders are made."""
    store, at = store_of(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(at) as out:
        out.write(data)


def read_bytes(path: str) -> bytes:
    store, at = store_of(path)
    with store.open_input_file(at) as held:
        return held.read()


def write_files(rows: DataFrame, folder: str) -> int:
    """Files of (name, content BINARY) below a folder, written by the executors, each whole or not at all; gives their number.

    A name may hold folders. A task that is run again writes its files again; equal names overwrite each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                write_bytes(f"{folder}/{name}", content)
                n += 1
        yield pa.record_batch({"n": pa.array([n], pa.int64())})

    return rows.select("name", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def list_files(spark: SparkSession, folders: list[str], suffix: str, recursive: bool = False) -> DataFrame:
    """(path, name, size) of the files with this suffix; a folder that doesn't exist raises.

    Any store that Arrow reads by its address can be listed, one task a folder; with ``recursive`` the folders below are
    tasks of their own, level by level, so a large tree isn't walked by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                store, at = store_of(folder)
                scheme = "" if store.type_name == "local" else f"{folder.split('://')[0]}://"
                held = [i for i in store.get_file_info(fs.FileSelector(at)) if not i.is_file or i.base_name.endswith(suffix)]
                yield pa.record_batch({"path": pa.array([scheme + i.path for i in held], pa.string()), "name": pa.array([i.base_name for i in held], pa.string()), "size": pa.array([i.size if i.is_file else None for i in held], pa.int64())})

    def level(names: DataFrame, tasks: int) -> DataFrame:
        return names.repartition(tasks).mapInArrow(run, "path string, name string, size long")

    todo = spark.createDataFrame([(f.replace("file:", "", 1) if f.startswith("file:/") else f,) for f in folders], "folder string")
    if not recursive:
        return level(todo, len(folders)).where("size is not null")
    out, many = None, len(folders)
    while many:
        found = settle(level(todo, min(many, 1000)), "listing")
        mine, todo = found.where("size is not null"), found.where("size is null").select(F.col("path").alias("folder"))
        out, many = mine if out is None else out.unionByName(mine), todo.count()
    return out


#: Kinds of recordings in the order in which one is looked for (fixed values).
RECORDINGS = (".wav", ".mp3", ".flac", ".m4a", ".ogg")


def first_recording(spark: SparkSession, folder: str) -> str | None:
    """The first recording that isn't empty, by kind, then name; None if there is none."""
    kind = F.array_position(F.array(*map(F.lit, RECORDINGS)), F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)))
    held = list_files(spark, [folder], "").withColumn("kind", kind).where("kind > 0 and size > 0")
    row = held.orderBy("kind", "path").first()
    return row["path"] if row else None
