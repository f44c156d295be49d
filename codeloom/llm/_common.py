"""Shared folder, table cutting and Arrow helpers used by the operators of this package."""

from __future__ import annotations

import gc
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codeloom.sources import tables
from codeloom.sources.tables import drop as drop_table
from codeloom.sources.tables import table

__all__ = ["batches", "cut", "delete_folders", "drop_table", "flat", "folders", "open_shared", "read_shared", "release", "shared_folder", "small_batches", "table", "write_shared"]

#: Rows in an Arrow batch handed to a Python worker: a few MB of ordinary documents.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


_made = threading.local()


def folders() -> list[str]:
    """The shared folders that this thread has made, oldest first."""
    if not hasattr(_made, "folders"):
        _made.folders = []
    return _made.folders


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which the driver and all executors reach; it goes at the session's end."""
    folders().append(tables.shared_folder(spark, name))
    return folders()[-1]


def delete_folders(spark: SparkSession, named: list[str]) -> None:
    """Delete shared folders that nothing reads any more."""
    for folder in named:
        tables.delete_folder(spark, folder)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more; else they stay on the
    executors' disks until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and a lost executor costs only
    the stage that reads it."""
    path = f"{shared_folder(df.sparkSession, name)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_shared(folder: str):
    """(file system, path) of a shared folder, through Arrow: local, HDFS and object stores alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")


def write_shared(folder: str, prefix: str):
    """(path, output stream) of a new file. The name is new for each task attempt, so a retried task never
    meets the leftovers of the first; readers follow the manifest, which lists only attempts that ended."""
    filesystem, at = open_shared(folder)
    filesystem.create_dir(at, recursive=True)
    name = f"{prefix}-{uuid.uuid4().hex}"
    return f"{folder}/{name}", filesystem.open_output_stream(f"{at}/{name}", compression=None)


def read_shared(path: str) -> pa.NativeFile:
    filesystem, at = open_shared(path)
    return filesystem.open_input_file(at)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(column) else data[:0], offsets - offsets[0]


def batches(rows: Iterator[pa.RecordBatch], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most `most` bytes of data or a single row."""
    for batch in rows:
        todo = [batch]
        while todo:
            part = todo.pop()
            if part.num_rows < 2 or part.nbytes <= most:
                if part.num_rows or not batch.num_rows:
                    yield part
                continue
            step = min(-(-part.num_rows // 2), max(1, int(part.num_rows * most / part.nbytes)))
            todo += [part.slice(start, step) for start in range(0, part.num_rows, step)][::-1]
