"""Files that tasks write to the shared folder, and manifests of those that count.

A file is named after the task attempt that writes it. The manifest is an ordinary table that Spark commits with the
attempts that succeed, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from basecov.session import scratch_path, stored

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MANIFEST = "part int, number int, path string, n_rows bigint, n_bytes bigint"
_KINDS = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]


def locate(path: str):
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path)


def new_folder(df: DataFrame, name: str, folder: str | None = None) -> str:
    folder = folder or scratch_path(df.sparkSession, name)
    system, inner = locate(folder)
    system.create_dir(inner, recursive=True)
    return folder


class Parts:
    """Numbers the files of one task attempt and makes their manifest rows."""

    def __init__(self, folder: str, ending: str):
        task = TaskContext.get()
        self.part, self.attempt = task.partitionId(), task.taskAttemptId()
        self.folder, self.ending, self.number = folder, ending, 0

    def write(self, chunks: list[bytes], n_rows: int) -> pa.RecordBatch:
        path = f"{self.folder}/{self.part:06d}-{self.number:06d}-{self.attempt}{self.ending}"
        system, inner = locate(path)
        with system.open_output_stream(inner, compression=None) as out:
            for chunk in chunks:
                out.write(chunk)
        row = (self.part, self.number, path, n_rows, sum(map(len, chunks)))
        self.number += 1
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS)], names=["part", "number", "path", "n_rows", "n_bytes"])


def written(df: DataFrame, name: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Runs the writing tasks now and returns the manifest of their files."""
    return stored(df.mapInArrow(run, MANIFEST), f"{name}-manifest")


def spread(manifest: DataFrame, *columns: str) -> DataFrame:
    """The files dealt out to tasks, about one each."""
    return manifest.select("path", *columns).repartition(max(1, min(manifest.count(), 100_000)))


def forget(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def is_there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


@contextmanager
def without_old_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes the shuffle files of a query when the query ends; for queries that write a table."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
