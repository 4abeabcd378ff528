"""WARC archives: writing, reading, and resolving revisits.

``write_archives`` writes a response record per row. ``resolve_revisits`` reads the headers of any such archives, shuffles
them by payload digest, picks the original of each payload (the largest id), joins the others to it, and copies every record
under a fresh header into new archives: originals as responses with their payload, the others as revisits without one.
Payloads never enter a shuffle; a record is fetched from its archive by offset.

The digests of popular payloads are salted: originals that others share are repeated for each of ``SALTS`` values, and
headers carry one of them, so the copies of one payload are dealt out over that many keys.

Records are gzip members of their own, as is usual. A record id is ``<urn:page:ID>``; the field ``Payload-Length`` holds
the length of the whole payload also where the payload is left out.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basecov.llm.files import Parts, locate, new_folder, spread, written
from basecov.llm.frames import schema_of
from basecov.llm.words import text_buffers
from basecov.session import stored

ARCHIVE_BYTES = 64 << 20
SALTS = 16
LOWEST = -(1 << 63)
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GZIP = 31  # zlib's window bits for gzip members
RECORDS = [("page_id", "bigint"), ("url", "string"), ("record_type", "string"), ("refers_to", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("path", "string"), ("offset", "bigint"), ("length", "bigint")]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _member(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{n}: {v}" for n, v in fields if v is not None]
    head = "WARC/1.1\r\n" + "\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n"
    pack = zlib.compressobj(4, zlib.DEFLATED, _GZIP)
    return pack.compress(head.encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def _uri(url: str | None) -> str | None:
    """A URI without characters that would break the header."""
    return None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")


def response(page_id: int, url: str | None, payload: bytes, date: str = DATE) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Payload-Length", len(payload)), ("Content-Type", "application/http; msgtype=response")]
    return _member(fields, http + payload)


def revisit(page_id: int, uri: str | None, sha1: str, size: int, original: int, original_uri: str | None, date: str = DATE) -> bytes:
    fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{original}>"), ("WARC-Refers-To-Target-URI", original_uri), ("WARC-Refers-To-Date", date), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("Payload-Length", size)]
    return _member(fields, b"")


def _id(field: str) -> int:
    return int(field.removeprefix("<urn:page:").removesuffix(">"))


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record; a response's digest is checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Type"] != "response":
        return fields, b""
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Payload-Digest"] != f"sha1:{digest(payload)}":
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    return fields, payload


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member."""
    at = 0
    view = memoryview(data)
    while at < len(data):
        unpack = zlib.decompressobj(_GZIP)
        out, step, end = [], 1 << 16, at
        while not unpack.eof:
            if end >= len(data):
                raise ValueError("truncated archive")
            out.append(unpack.decompress(view[end : end + step]))
            end += step
        end = min(end, len(data)) - len(unpack.unused_data)
        yield at, end - at, b"".join(out)
        at = end


class _Archive:
    """Collects records and writes an archive whenever enough bytes are there."""

    def __init__(self, folder: str, limit: int):
        self.parts, self.limit = Parts(folder, ".warc.gz"), limit
        self.records, self.size = [], 0

    def add(self, record: bytes) -> Iterator[pa.RecordBatch]:
        self.records.append(record)
        self.size += len(record)
        if self.size >= self.limit:
            yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.records:
            yield self.parts.write(self.records, len(self.records))
        self.records, self.size = [], 0


def write_archives(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a response record per row, payload the text in UTF-8; returns the manifest of the archives.

    A missing or empty text is an empty payload, a missing URL leaves its field out, a missing id counts as the lowest
    64-bit integer, repeated rows give repeated records, an empty table gives no archives. Other columns play no part.
    """
    folder = new_folder(pages, "archives", folder)
    rows = pages.select(F.coalesce(F.col(f"`{page_id}`").cast("long"), F.lit(LOWEST)).alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))

    def run(batches):
        archive = _Archive(folder, limit)
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for i, (page, address) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                yield from archive.add(response(page, address, data[offsets[i] : offsets[i + 1]].tobytes()))
        yield from archive.close()

    return written(rows, "archives", run)


def read_headers(manifest: DataFrame) -> DataFrame:
    """A row per record: id, URI, type, id it refers to, length and digest of the whole payload, place in its archive."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def rows_of(path: str):
        system, inner = locate(path)
        with system.open_input_stream(inner, compression=None) as f:
            data = f.read()
        for offset, length, record in members(data):
            fields, _ = parse(record)
            refers = fields.get("WARC-Refers-To")
            yield (_id(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], None if refers is None else _id(refers), int(fields["Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), path, offset, length)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held = []
                for row in rows_of(path):
                    held.append(row)
                    if len(held) == 5000:
                        yield _batch(held, kinds)
                        held = []
                yield _batch(held, kinds)

    return spread(manifest).mapInArrow(run, schema_of(RECORDS))


def _batch(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[n for n, _ in RECORDS])


def decide(headers: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Every record with ``original`` and ``original_url``: those of the record it repeats, missing for responses.

    Of the records with equal payloads of at least ``least_bytes`` the one with the largest id is the original; between
    equal ids the later place in the later archive. Smaller payloads are all originals.
    """
    place = F.struct("page_id", "path", "offset", "url")
    large = headers.where(F.col("payload_bytes") >= least_bytes)
    originals = large.groupBy("payload_digest").agg(F.max(place).alias("o"), F.count("*").alias("n")).where("n > 1")
    salted = originals.select(F.col("payload_digest").alias("d"), "o", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    joined = headers.withColumn("salt", F.pmod(F.xxhash64("path", "offset"), F.lit(SALTS)).cast("int")).join(salted, (F.col("payload_digest") == F.col("d")) & (F.col("salt") == F.col("s")) & (F.col("payload_bytes") >= least_bytes), "left")
    repeats = (F.col("o.page_id") != F.col("page_id")) | (F.col("o.path") != F.col("path")) | (F.col("o.offset") != F.col("offset"))
    return joined.select(*headers.columns, F.when(repeats, F.col("o.page_id")).alias("original"), F.when(repeats, F.col("o.url")).alias("original_url"))


def resolve_revisits(manifest: DataFrame, *, least_bytes: int = 0, folder: str | None = None, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Deduplicated archives with fresh headers from those of ``manifest``; returns the manifest of the new ones."""
    folder = new_folder(manifest, "deduplicated", folder)
    files = max(1, min(manifest.count(), 100_000))
    # stored, because digests and joins both need them: otherwise every archive is read twice
    headers = stored(read_headers(manifest), "headers")
    decided = decide(headers, least_bytes=least_bytes)
    rows = decided.select("path", "offset", "length", "page_id", "url", "payload_digest", "payload_bytes", "original", "original_url")
    rows = rows.repartition(files, "path").sortWithinPartitions("path", "offset")

    def run(batches):
        archive, source, opened = _Archive(folder, limit), None, None
        for batch in batches:
            for path, offset, length, page, uri, sha1, size, original, original_uri in zip(*[c.to_pylist() for c in batch.columns]):
                if original is not None:
                    yield from archive.add(revisit(page, uri, sha1, size, original, original_uri))
                    continue
                if path != opened:
                    if source is not None:
                        source.close()
                    system, inner = locate(path)
                    source, opened = system.open_input_file(inner), path
                _, payload = parse(zlib.decompress(source.read_at(length, offset), _GZIP))
                yield from archive.add(response(page, uri, payload))
        if source is not None:
            source.close()
        yield from archive.close()

    return written(rows, "deduplicated", run)
