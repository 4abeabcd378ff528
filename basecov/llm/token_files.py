"""Token ids of documents in Simple-8b files, in ascending order of the document id.

Documents are dealt out by ranges of their id and sorted inside a range, so the files, by range and then by number, hold
all ids in order. Each task encodes its texts and closes a file whenever ``FILE_IDS`` ids are reached, so its memory does
not grow with the range. A file is named after the attempt that writes it, and only files in the manifest, which Spark
commits with the successful attempts, count: lost or repeated attempts leave no trace in the result.

A file, all numbers little-endian: 8 bytes magic; block size and number of documents (u32 each); numbers of ids, words
and exceptions (u64 each); per document id (i64) and number of ids (u64); the first word of each block and the number
of words (u32 each); the words (u64 each); the exceptions (u8 each); crc32 of all before (u32).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basecov.llm import simple8b
from basecov.llm.files import Parts, locate, new_folder, spread, written
from basecov.llm.frames import mapped, new_task
from basecov.llm.remembered import library_encoder, text_pieces, with_end, words_between_white

MAGIC = b"TOKS8B01"
HEAD = struct.Struct("<8sIIQQQ")
FILE_IDS = 4 << 20


def to_file(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets, exceptions = simple8b.pack(ids)
    table = np.stack([doc_ids.astype("<i8").view("<u8"), counts.astype("<u8")], axis=1)
    head = HEAD.pack(MAGIC, simple8b.BLOCK, len(doc_ids), len(ids), len(words), len(exceptions))
    body = b"".join([head, table.tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes(), exceptions.tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


def from_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, numbers of ids, ids. A damaged file raises."""
    magic, block, n_docs, n_ids, n_words, n_exceptions = HEAD.unpack_from(data)
    if magic != MAGIC or block != simple8b.BLOCK or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a token file, or a damaged one")
    at = HEAD.size

    def read(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    table = read("<u8", 2 * n_docs).reshape(n_docs, 2)
    offsets = read("<u4", -(-n_ids // block) + 1)
    words, exceptions = read("<u8", n_words), read("u1", n_exceptions)
    return table[:, 0].astype("<u8").view("<i8"), table[:, 1].astype(np.int64), simple8b.unpack(words, offsets, exceptions, n_ids)


class _Writer:
    """Collects documents and writes a file whenever enough ids are there."""

    def __init__(self, folder: str, file_ids: int):
        self.parts, self.file_ids = Parts(folder, ".toks"), file_ids
        self._clear()

    def _clear(self) -> None:
        self.docs, self.counts, self.ids, self.held = [], [], [], 0

    def add(self, docs: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.docs.append(docs)
        self.counts.append(counts)
        self.ids.append(ids)
        self.held += len(ids)
        if self.held >= self.file_ids:
            yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        """The manifest row of the file, which counts ids."""
        if self.docs:
            data = to_file(*map(np.concatenate, (self.docs, self.counts, self.ids)))
            yield self.parts.write([data], self.held)
        self._clear()


def write_tokens(docs: DataFrame, tokenizer_path: str, *, end_id: int, text: str = "text", doc_id: str = "doc_id", added_tokens: bool = False, folder: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of every whole text, each followed by ``end_id``; returns the manifest of the files.

    A missing or empty text has the end id alone. A missing doc_id counts as the lowest 64-bit integer. Rows with equal
    ids are all written, in the order of a hash of their texts, and may lie in several ranges, so that no id has to fit
    a task. An empty table has no files. Other columns play no part. The tokenizer drops white space and keeps letters
    and digits apart from other signs. ``added_tokens``: strings of added tokens are read as those tokens, else as text.
    One shuffle, of the texts, by ranges of the id.
    """
    spark = docs.sparkSession
    folder = new_folder(docs, "tokens", folder)
    with open(tokenizer_path, encoding="utf-8") as f:  # a vocabulary on the driver, beside the program
        content = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.withColumn("place", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new_task()
        encoder, writer = library_encoder(content.value, words_between_white, added_tokens), _Writer(folder, file_ids)
        for batch in batches:
            doc_ids = batch.column(0).to_numpy()
            for low, high, data, offsets in text_pieces(batch.column(1)):
                ids, bounds = with_end(*encoder.encode(data, offsets), end_id)
                yield from writer.add(doc_ids[low:high], np.diff(bounds), ids)
        yield from writer.close()

    return written(rows, "tokens", run)


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``: ids in all files before. Sums of parts first, so that no window holds all files."""
    parts = manifest.groupBy("part").agg(F.sum("n_rows").alias("ids"))
    parts = parts.select("part", (F.sum("ids").over(W.orderBy("part")) - F.col("ids")).alias("before"))
    inner = F.sum("n_rows").over(W.partitionBy("part").orderBy("number")) - F.col("n_rows")
    return manifest.join(parts, "part").withColumn("base", F.col("before") + inner).drop("before")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Documents of the files: ``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids`` (u32)."""
    files = spread(with_bases(manifest), "base")

    def compute(batch):
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            system, inner = locate(path)
            with system.open_input_stream(inner) as f:
                docs, counts, ids = from_file(f.read())
            raw = ids.astype("<u4")
            bounds = np.concatenate([[0], np.cumsum(counts)])
            for low in range(0, len(docs), 500):
                high = min(low + 500, len(docs))
                data = pa.py_buffer(raw[bounds[low] : bounds[high]].tobytes())
                places = pa.py_buffer((4 * (bounds[low : high + 1] - bounds[low])).astype(np.int32).tobytes())
                packed = pa.Array.from_buffers(pa.binary(), high - low, [None, places, data])
                yield [pa.array(docs[low:high]), pa.array(bounds[low:high] + base), pa.array(counts[low:high]), packed]

    return mapped(files, [("path", "string"), ("base", "bigint")], [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids", "binary")], compute)
