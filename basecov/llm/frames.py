"""Arrow-batch helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Fields = list[tuple[str, str]]


_KEPT: dict[object, object] = {}
_STAGE: list[int] = []


def new_task() -> None:
    """Drops what tasks of other stages have kept in this Python worker."""
    task = TaskContext.get()
    if _STAGE != [task.stageId()]:
        _KEPT.clear()
        _STAGE[:] = [task.stageId()]
        give_back()


def give_back() -> None:
    """Returns free memory to the system: workers stay alive between stages, beside those of the next one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def kept(key: object, make: Callable):
    """An object that all tasks of a stage in one Python worker share, such as an encoder with what it remembers."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def schema_of(fields: Fields) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])


def with_batch_columns(df: DataFrame, column: str, fields: Fields, compute: Callable[[pa.Array], Iterable[list[pa.Array]]], kind: str = "string") -> DataFrame:
    """``df`` with new columns computed from one column of text (or of another ``kind``), batch by batch and without a shuffle.

    ``compute`` gets the column of a batch and yields lists of arrays, one per field, that together cover its rows in
    order. A column of ``df`` with the name of a new one is replaced.
    """
    new = {n for n, _ in fields}
    kept = [f for f in df.schema.fields if f.name not in new]
    names = [f.name for f in kept]
    columns = [F.col(f"`{n}`") for n in names]
    place = names.index(column) if column in names else len(names)
    if place == len(names) or kept[place].dataType.simpleString() != kind:  # else the column goes to the task once
        place = len(names)
        columns.append(F.col(f"`{column}`").cast(kind).alias("__text"))
    source = df.select(*columns)
    out = T.StructType(kept + schema_of(fields).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new_task()
        for batch in batches:
            at = 0
            for arrays in compute(batch.column(place)):
                n = len(arrays[0])
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(at, n) for i in range(len(names))] + arrays, names=[*names, *[n for n, _ in fields]])
                at += n
        give_back()

    return source.mapInArrow(run, out)


def mapped(df: DataFrame, columns: Fields, out: Fields, compute: Callable[[pa.RecordBatch], Iterable[list]]) -> DataFrame:
    """Rows made from batches of the named columns, cast to the given types; ``compute`` yields lists of arrays, one per field of ``out``."""
    source = df.select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t in columns])
    names = [n for n, _ in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new_task()
        for batch in batches:
            for arrays in compute(batch):
                yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=names)
        give_back()

    return source.mapInArrow(run, schema_of(out))
