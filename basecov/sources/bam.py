"""BAM scan as a Spark data source: files are cut into byte ranges and each range is decoded by its own task.

The driver only lists file names and sizes. A task looks for the first compressed block at or after the start of
its range, finds the first record boundary by checking a chain of plausible records, and emits every record that
starts in a block of its range as Arrow batches.

Filters on chromosome, positions, flag and mapping quality are applied to the fixed fields of the records, before any
text is made; a file with an index beside it (``.bai``) is only read where it can hold reads of the region they name.
Only the columns that the caller names are built. A partition carries the id of its sample, so a sheet of any number of
samples is one scan.
"""

from __future__ import annotations

import fnmatch
import json
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)

from basecov.sources.bam_index import BamIndex

_ARROW_SCHEMA = pa.schema(
    [
        ("sample_id", pa.int32()),
        ("file_path", pa.string()),
        ("read_name", pa.string()),
        ("flag", pa.int32()),
        ("chrom", pa.string()),
        ("start_pos", pa.int32()),
        ("end_pos", pa.int32()),
        ("mapq", pa.int32()),
        ("cigar", pa.string()),
    ]
)

# Fixed values of the BAM and BGZF formats.
BLOCK_MAGIC = b"\x1f\x8b\x08\x04"
FILE_MAGIC = b"BAM\x01"
CIGAR_OPS = "MIDNSHP=X"
FIXED_FIELDS = np.dtype(
    [
        ("size", "<i4"),
        ("ref", "<i4"),
        ("pos", "<i4"),
        ("name_len", "u1"),
        ("mapq", "u1"),
        ("bin", "<u2"),
        ("n_cigar", "<u2"),
        ("flag", "<u2"),
        ("seq_len", "<i4"),
        ("next_ref", "<i4"),
        ("next_pos", "<i4"),
        ("insert", "<i4"),
    ]
)
HEAD = FIXED_FIELDS.itemsize
MAX_BLOCK = 65536
_ADVANCES = np.array([op in "MDN=X" for op in CIGAR_OPS])
_CLIP, _SKIP = CIGAR_OPS.index("S"), CIGAR_OPS.index("N")
_TAG_BYTES = {b"A": 1, b"c": 1, b"C": 1, b"s": 2, b"S": 2, b"i": 4, b"I": 4, b"f": 4}
_BATCH_BYTES = 4 * 1024 * 1024
_PROOF_RECORDS = 4


def _open_fs(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:"):
            return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return fs.LocalFileSystem(), path


def is_reachable(path: str) -> bool:
    """Whether tasks can open the path themselves; some stores are known to Spark alone."""
    try:
        _open_fs(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def list_files(pattern: str) -> list[tuple[str, int]]:
    """``(path, bytes)`` of the files that a path, a folder or a glob stands for; any element of the path may hold wildcards."""
    system, path = _open_fs(pattern)
    prefix = pattern[: len(pattern) - len(path)] if pattern.endswith(path) else ""
    elements = path.split("/")
    first = next((i for i, e in enumerate(elements) if any(ch in e for ch in "*?[")), len(elements))
    infos = [system.get_file_info("/".join(elements[:first]) or ("/" if path.startswith("/") else "."))]
    for element in elements[first:]:
        inside = [i for info in infos if info.type == fs.FileType.Directory for i in system.get_file_info(fs.FileSelector(info.path))]
        infos = [i for i in inside if fnmatch.fnmatchcase(i.base_name, element)]
    files: list[fs.FileInfo] = []
    for info in infos:
        if info.type == fs.FileType.Directory:
            inside = system.get_file_info(fs.FileSelector(info.path, recursive=True))
            files += [i for i in inside if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))]
        elif info.type == fs.FileType.File:
            files.append(info)
    return sorted((prefix + i.path, i.size) for i in files)


COLUMNS = tuple(_ARROW_SCHEMA.names)
_SQL_TYPES = {pa.int32(): "INT", pa.string(): "STRING"}
_COMPARISONS = {EqualTo: "==", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
_FILTERED = ("chrom", "start_pos", "end_pos", "flag", "mapq")


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int
    sample_id: int | None = None


@dataclass(frozen=True)
class Condition:
    """A comparison of one of the ``_FILTERED`` columns with a constant (``in``: a tuple)."""

    column: str
    how: str
    value: object

    def holds(self, values: np.ndarray) -> np.ndarray:
        if self.how == "in":
            return np.isin(values, list(self.value))
        return {"==": values == self.value, ">": values > self.value, ">=": values >= self.value, "<": values < self.value, "<=": values <= self.value}[self.how]


def condition_of(pushed: Filter) -> Condition | None:
    """The condition that a pushed filter stands for, None if Spark has to keep it."""
    how = _COMPARISONS.get(type(pushed))
    if how is None or len(pushed.attribute) != 1 or pushed.attribute[0] not in _FILTERED:
        return None
    value = tuple(pushed.value) if how == "in" else pushed.value
    kind = str if pushed.attribute[0] == "chrom" else int
    values = value if how == "in" else (value,)
    if kind is str and how not in ("==", "in") or not all(type(v) is kind for v in values):
        return None
    return Condition(pushed.attribute[0], how, value)


def region_of(conditions: Iterable[Condition]) -> tuple[set[str] | None, int, int | None]:
    """Chromosomes (None: all), first and last position that reads which meet the conditions can cover."""
    chroms, start, end = None, 1, None
    for c in conditions:
        if c.column == "chrom":
            named = set(c.value) if c.how == "in" else {c.value}
            chroms = named if chroms is None else chroms & named
        elif c.column in ("start_pos", "end_pos") and c.how != "in":
            if c.how in ("==", ">", ">="):  # whoever starts or ends there or later covers no place before
                start = max(start, c.value if c.column == "end_pos" or c.how != ">" else c.value + 1)
            if c.column == "start_pos" and c.how in ("==", "<", "<="):
                end = c.value if end is None else min(end, c.value)
    return chroms, start, end


class BamDataSource(DataSource):
    """``spark.read.format('basecov-bam')``.

    Options: ``paths`` (one per line) or ``samples`` (JSON list of sample id and path), ``columns`` (comma-separated,
    default all but ``sample_id`` for ``paths``) and ``split_bytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "basecov-bam"

    def schema(self) -> str:
        return ", ".join(f"{c} {_SQL_TYPES[_ARROW_SCHEMA.field(c).type]}" for c in _columns(self.options))

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options)


def _columns(options) -> list[str]:
    """Names of the columns to build, in the order of ``COLUMNS``."""
    default = ",".join(COLUMNS[0 if "samples" in options else 1 :])
    named = [c.strip() for c in options.get("columns", default).split(",")]
    if unknown := set(named) - set(COLUMNS):
        raise ValueError(f"unknown columns {sorted(unknown)}")
    return [c for c in COLUMNS if c in named]


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.sources = [(i, p) for i, p in json.loads(options["samples"])] if "samples" in options else [(None, p) for p in options["paths"].split("\n")]
        self.split_bytes = max(int(options.get("split_bytes", 64 * 1024 * 1024)), MAX_BLOCK)
        self.columns = _columns(options)
        self.conditions: list[Condition] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for pushed in filters:
            if isinstance(pushed, IsNotNull) and len(pushed.attribute) == 1 and pushed.attribute[0] in _FILTERED:
                continue  # these columns are never missing
            condition = condition_of(pushed)
            if condition is None:
                yield pushed
            else:
                self.conditions.append(condition)

    def _ranges(self, path: str, size: int) -> list[tuple[int, int]]:
        """The byte ranges of a file that can hold the wanted reads."""
        chroms, start, end = region_of(self.conditions)
        if chroms is None:
            return [(0, size)]
        index = _index_of(path)
        if index is None:
            return [(0, size)]
        system, inner = _open_fs(path)
        with system.open_input_file(inner) as handle:
            names = [name for name, _ in _read_header(handle)[0]]
        found = sorted(r for c in chroms if c in names for r in index.ranges(names.index(c), start, end))
        apart: list[tuple[int, int]] = []
        for a, b in found:
            if apart and a <= apart[-1][1]:
                apart[-1] = (apart[-1][0], max(b, apart[-1][1]))
            else:
                apart.append((a, b))
        # without a chromosome's name, reads without a place are not to be had from an index
        return [(0, size)] if "*" in chroms else apart

    def partitions(self) -> list[InputPartition]:
        parts = []
        for sample_id, pattern in self.sources:
            files = [f for f in list_files(pattern) if not f[0].endswith(".bai")]
            if not files:
                raise FileNotFoundError(pattern)
            for path, size in files:
                for low, high in self._ranges(path, size):
                    parts += [ByteRange(path, at, min(at + self.split_bytes, high), sample_id) for at in range(low, high, self.split_bytes)]
        return parts

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        system, path = _open_fs(partition.path)
        with system.open_input_file(path) as handle:
            yield from _read_range(handle, partition, self.columns, self.conditions)


def _index_of(path: str) -> BamIndex | None:
    """The index beside a file, as ``x.bam.bai`` or ``x.bai``."""
    system, inner = _open_fs(path)
    for place in (f"{inner}.bai", f"{inner.removesuffix('.bam')}.bai"):
        if system.get_file_info(place).type == fs.FileType.File:
            with system.open_input_stream(place, compression=None) as stream:
                return BamIndex(stream.read())
    return None


def _block_length(head: bytes) -> int | None:
    """Length of the compressed block starting with ``head``, or None when it is no block header."""
    if len(head) < 18 or head[:4] != BLOCK_MAGIC:
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    at, stop = 12, min(12 + extra, len(head))
    while at + 4 <= stop:
        field, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if field == b"BC" and size == 2 and at + 6 <= stop:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


def _blocks(handle, at: int) -> Iterator[tuple[int, bytes]]:
    """``(file offset, plain bytes)`` of each block from the block boundary ``at`` on."""
    handle.seek(at)
    pending = b""
    while True:
        length = _block_length(pending)
        if length is None or len(pending) < length:
            more = handle.read(16 * MAX_BLOCK)
            if not more:
                if pending:
                    raise ValueError(f"truncated or damaged block at byte {at}")
                return
            pending += more
            if _block_length(pending) is None:
                raise ValueError(f"no block header at byte {at}")
            continue
        body = 12 + struct.unpack_from("<H", pending, 10)[0]
        yield at, zlib.decompress(pending[body : length - 8], wbits=-15)
        at += length
        pending = pending[length:]


def _first_block(handle, start: int, size: int) -> int | None:
    """Offset of the first block at or after ``start``: a header followed by another header or the end of file."""
    handle.seek(start)
    window = handle.read(3 * MAX_BLOCK)
    at = window.find(BLOCK_MAGIC)
    while at >= 0:
        length = _block_length(window[at : at + 256])
        if length is not None:
            following = at + length
            if start + following == size or _block_length(window[following : following + 256]) is not None:
                return start + at
        at = window.find(BLOCK_MAGIC, at + 1)
    return None


def _read_header(handle) -> tuple[list[tuple[str, int]], int, int]:
    """Reference names and lengths, and where records start: ``(block offset, offset inside the block)``."""
    plain, starts = bytearray(), []
    blocks = _blocks(handle, 0)

    def need(size: int) -> None:
        while len(plain) < size:
            offset, data = next(blocks)
            starts.append((len(plain), offset))
            plain.extend(data)

    need(12)
    if plain[:4] != FILE_MAGIC:
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", plain, 4)[0]
    need(at + 4)
    count = struct.unpack_from("<i", plain, at)[0]
    at += 4
    references = []
    for _ in range(count):
        need(at + 4)
        name_len = struct.unpack_from("<i", plain, at)[0]
        need(at + 8 + name_len)
        name = bytes(plain[at + 4 : at + 3 + name_len]).decode("ascii")
        references.append((name, struct.unpack_from("<i", plain, at + 4 + name_len)[0]))
        at += 8 + name_len
    try:
        need(at + 1)
    except StopIteration:
        return references, -1, 0
    begin, offset = [s for s in starts if s[0] <= at][-1]
    return references, offset, at - begin


def _plausible(plain: bytes, at: int, references: list[tuple[str, int]]) -> int | None:
    """Offset behind the record at ``at`` if its fixed fields make sense, else None."""
    if at + HEAD > len(plain):
        return None
    size, ref, pos, name_len, _, _, n_cigar, _, seq_len, next_ref, next_pos, _ = struct.unpack_from(
        "<iiiBBHHHiiii", plain, at
    )
    count = len(references)
    if not (-1 <= ref < count and -1 <= next_ref < count and name_len >= 1 and seq_len >= 0):
        return None
    if size < HEAD - 4 + name_len + 4 * n_cigar + (seq_len + 1) // 2 + seq_len:
        return None
    if pos < -1 or next_pos < -1 or (ref >= 0 and pos > references[ref][1]):
        return None
    name = plain[at + HEAD : at + HEAD + name_len]
    if len(name) == name_len and (name[-1] != 0 or any(not 33 <= ch <= 126 for ch in name[:-1])):
        return None
    return at + 4 + size


def _first_record(plain: bytes, references: list[tuple[str, int]], at_end: bool) -> int | None:
    """First offset that starts a chain of plausible records; None when more bytes are needed to decide."""
    for start in range(len(plain)):
        at, proof = start, 0
        while proof < _PROOF_RECORDS and at + HEAD <= len(plain):
            following = _plausible(plain, at, references)
            if following is None:
                break
            proof, at = proof + 1, following
        else:
            if proof == _PROOF_RECORDS or (at_end and proof and at == len(plain)):
                return start
            if proof and not at_end:
                return None
    return None


def _read_range(handle, part: ByteRange, columns: list[str], conditions: list[Condition]) -> Iterator[pa.RecordBatch]:
    size = handle.size()
    references, first_block, inside = _read_header(handle)
    if first_block < 0 or first_block >= part.end:
        return
    if part.start <= first_block:
        at = first_block
    else:
        at = _first_block(handle, part.start, size)
        inside = None
        if at is None or at >= part.end:
            return
    plain = bytearray()
    own = None  # plain bytes that lie in blocks of this range; records starting behind them belong to the next task
    blocks = _blocks(handle, at)
    exhausted = False
    while True:
        offset, data = next(blocks, (None, b""))
        exhausted = offset is None
        if own is None and (exhausted or offset >= part.end):
            own = len(plain)
        plain += data
        if inside is None:
            inside = _first_record(bytes(plain), references, exhausted)
            if inside is None:
                if exhausted:
                    return
                continue
        if inside:
            cut = min(inside, len(plain))
            del plain[:cut]
            own = None if own is None else own - cut
            inside -= cut
        if len(plain) < _BATCH_BYTES and own is None and not exhausted:
            continue
        starts, consumed = _record_starts(plain, own)
        if starts:
            batch = _to_batch(bytes(plain[:consumed]), starts, references, part, columns, conditions)
            if len(batch):
                yield batch
            del plain[:consumed]
            own = None if own is None else own - consumed
        if own is not None and own <= 0:
            return
        if exhausted:
            if plain:
                raise ValueError(f"truncated record at the end of {part.path}")
            return


def _record_starts(plain: bytearray, own: int | None) -> tuple[list[int], int]:
    """Offsets of the complete records that start before ``own``, and the bytes they take."""
    starts, at = [], 0
    stop = len(plain) if own is None else own
    while at < stop and at + 4 <= len(plain):
        following = at + 4 + struct.unpack_from("<i", plain, at)[0]
        if following > len(plain):
            break
        starts.append(at)
        at = following
    return starts, at


def _tagged_cigar(plain: bytes, start: int, fields: np.void, name: str, path: str) -> np.ndarray:
    """The operations in the CG tag of the record at ``start``, whose own ones are a placeholder."""
    seq_len = int(fields["seq_len"])
    at = start + HEAD + int(fields["name_len"]) + 4 * int(fields["n_cigar"]) + (seq_len + 1) // 2 + seq_len
    stop = start + 4 + int(fields["size"])
    while at + 3 <= stop:
        tag, kind = plain[at : at + 2], plain[at + 2 : at + 3]
        at += 3
        if kind in (b"Z", b"H"):
            end = plain.find(b"\0", at, stop)
            at = stop if end < 0 else end + 1
        elif kind == b"B" and at + 5 <= stop:
            inner, count = plain[at : at + 1], struct.unpack_from("<I", plain, at + 1)[0]
            at += 5
            if tag == b"CG" and inner == b"I" and at + 4 * count <= stop:
                return np.frombuffer(plain, "<u4", count, at)
            at += _TAG_BYTES.get(inner, stop) * count
        else:
            at += _TAG_BYTES.get(kind, stop)
    raise ValueError(f"read {name} of {path} has a placeholder for its CIGAR and no CG tag")


def _to_batch(plain: bytes, starts: list[int], references, part: ByteRange, columns: list[str], conditions: list[Condition]) -> pa.RecordBatch:
    """The wanted columns of the records that meet the conditions."""
    raw = np.frombuffer(plain, dtype=np.uint8)
    at = np.array(starts, dtype=np.int64)
    fields = np.ascontiguousarray(raw[at[:, None] + np.arange(HEAD)]).view(FIXED_FIELDS)[:, 0]
    known = np.array([name for name, _ in references] + ["*"], dtype=object)

    def kept(keep: np.ndarray) -> None:
        nonlocal at, fields
        if not keep.all():
            at, fields = at[keep], fields[keep]

    for c in conditions:
        if c.column == "chrom":
            kept(c.holds(known)[fields["ref"]])
        elif c.column != "end_pos":
            kept(c.holds(fields["pos"].astype(np.int64) + 1 if c.column == "start_pos" else fields[c.column].astype(np.int64)))
    built: dict[str, pa.Array] = {}
    of_ends = [c for c in conditions if c.column == "end_pos"]
    if of_ends or {"end_pos", "cigar"} & set(columns):
        n_cigar, ops = _operations(plain, raw, at, fields, part.path)
        owner = np.repeat(np.arange(len(at)), n_cigar)
        lengths, letters = (ops >> 4).astype(np.int64), ops & 15
        span = np.bincount(owner, weights=lengths * _ADVANCES[letters], minlength=len(at)).astype(np.int64)
        ends = fields["pos"].astype(np.int64) + span
        keep = np.ones(len(at), bool)
        for c in of_ends:
            keep &= c.holds(ends)
        kept(keep)
        built["end_pos"] = pa.array(ends[keep].astype(np.int32))
        if "cigar" in columns:
            stay = np.repeat(keep, n_cigar)
            texts = [f"{n}{CIGAR_OPS[k]}" for n, k in zip(lengths[stay].tolist(), letters[stay].tolist())]
            n_cigar = n_cigar[keep]
            stops = np.cumsum(n_cigar)
            built["cigar"] = pa.array(["".join(texts[stop - count : stop]) if count else "*" for stop, count in zip(stops.tolist(), n_cigar.tolist())], pa.string())
    makers = {
        "sample_id": lambda: pa.array(np.full(len(at), part.sample_id or 0, np.int32)) if part.sample_id is not None else pa.nulls(len(at), pa.int32()),
        "file_path": lambda: pa.array([part.path] * len(at), pa.string()),
        "read_name": lambda: pa.array([plain[s + HEAD : s + HEAD + n - 1].decode("ascii") for s, n in zip(at.tolist(), fields["name_len"].tolist())], pa.string()),
        "flag": lambda: pa.array(fields["flag"].astype(np.int32)),
        "chrom": lambda: pa.array(known[fields["ref"]], pa.string()),
        "start_pos": lambda: pa.array(fields["pos"].astype(np.int32) + np.int32(1)),
        "mapq": lambda: pa.array(fields["mapq"].astype(np.int32)),
    }
    return pa.RecordBatch.from_arrays([built[c] if c in built else makers[c]() for c in columns], schema=pa.schema([_ARROW_SCHEMA.field(c) for c in columns]))


def _operations(plain: bytes, raw: np.ndarray, at: np.ndarray, fields: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """CIGAR operations of all records as one array (lengths in the upper 28 bits, letter in the lower 4), and how many each has."""
    name_len = fields["name_len"].astype(np.int64)
    n_cigar = fields["n_cigar"].astype(np.int64)
    owner = np.repeat(np.arange(len(at)), n_cigar)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_cigar) - n_cigar, n_cigar)
    op_at = (at + HEAD + name_len)[owner] + 4 * nth
    ops = np.ascontiguousarray(raw[op_at[:, None] + np.arange(4)]).view("<u4")[:, 0]
    # a record with more operations than its field can count holds kSmN, and the real ones in a tag
    ends = np.cumsum(n_cigar)
    two = np.flatnonzero(n_cigar == 2)
    first, second = ops[ends[two] - 2], ops[ends[two] - 1]
    long = two[(first & 15 == _CLIP) & (first >> 4 == fields["seq_len"][two]) & (second & 15 == _SKIP)]
    if len(long):
        parts = np.split(ops, ends[:-1])
        for k in long.tolist():
            name = plain[at[k] + HEAD : at[k] + HEAD + int(name_len[k]) - 1].decode("ascii")
            parts[k] = _tagged_cigar(plain, int(at[k]), fields[k], name, path)
        n_cigar, ops = np.array([len(p) for p in parts], np.int64), np.concatenate(parts)
    return n_cigar, ops
