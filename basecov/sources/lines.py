"""Lines of many text files as one scan whose partitions carry the id of the sample a file belongs to."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from basecov.sources.bam import ByteRange, _open_fs, list_files

CHUNK = 4 * 1024 * 1024
_SCHEMA = pa.schema([("sample_id", pa.int32()), ("value", pa.string())])


class LineDataSource(DataSource):
    """``spark.read.format('basecov-lines')``: ``samples`` is a JSON list of sample id and path, ``split_bytes`` the size of a range."""

    @classmethod
    def name(cls) -> str:
        return "basecov-lines"

    def schema(self) -> str:
        return "sample_id INT, value STRING"

    def reader(self, schema) -> DataSourceReader:
        return LineReader(self.options)


class LineReader(DataSourceReader):
    def __init__(self, options):
        self.samples = json.loads(options["samples"])
        self.split_bytes = max(int(options.get("split_bytes", 64 * 1024 * 1024)), 1)

    def partitions(self) -> list[InputPartition]:
        parts = []
        for sample_id, pattern in self.samples:
            files = list_files(pattern)
            if not files:
                raise FileNotFoundError(pattern)
            for path, size in files:
                parts += [ByteRange(path, at, min(at + self.split_bytes, size), sample_id) for at in range(0, size, self.split_bytes)]
        return parts

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        """The lines that start in the range: the first one may start before it, the last one may end behind it."""
        system, path = _open_fs(partition.path)
        with system.open_input_file(path) as handle:
            at = partition.start
            if at:
                handle.seek(at - 1)
                at -= 1
            else:
                handle.seek(0)
            held, skipping = b"", at != partition.start
            while True:
                data = handle.read(CHUNK)
                if skipping and data:
                    cut = data.find(b"\n")
                    at += len(data) if cut < 0 else cut + 1
                    if cut < 0:
                        continue
                    data, skipping = data[cut + 1 :], False
                    if at >= partition.end:
                        return
                held += data
                lines = held.split(b"\n")
                held = lines.pop() if data else b""
                own = []
                for line in lines:
                    if at >= partition.end or not (data or line):
                        break
                    own.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    at += len(line) + 1
                if own:
                    values = pa.array(own, pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([partition.sample_id] * len(own), pa.int32()), values], schema=_SCHEMA)
                if not data or at >= partition.end:
                    return
