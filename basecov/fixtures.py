"""Reads and exons derived from the driver tables, and files in the formats the readers take."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basecov.operators.vectors import Groups
from basecov.plans.diffexpr import Settings
from basecov.sources.bam import CIGAR_OPS, FILE_MAGIC
from basecov.session import partitions_by_size
from basecov.sources.bam_index import LINEAR_SHIFT, write_index

GROUPS = Groups(case=(0, 1, 2, 3), control=(4, 5, 6, 7))
FILE_READS = 200_000
# Widths for coordinates that are far smaller than a genome's.
SETTINGS = Settings(min_region_len=10, tile=2048, bin_width=256)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select(
        (F.col("l_suppkey") % 8).cast("int").alias("sample_id"),
        F.concat(F.lit("chr"), (F.col("l_partkey") % 3 + 1).cast("string")).alias("chrom"),
        (F.col("l_orderkey") + 1).cast("int").alias("start_pos"),
        (F.col("l_orderkey") + F.col("l_quantity")).cast("int").alias("end_pos"),
    )


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    gene = F.floor(F.col("p_partkey") / 10).cast("int")
    start = gene * 75 + (F.col("p_partkey") % 10) * 20
    return parts.select(
        F.concat(F.lit("G"), F.lpad(gene.cast("string"), 6, "0")).alias("gene_id"),
        F.concat(F.lit("E"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("exon_id"),
        F.concat(F.lit("chr"), (gene % 3 + 1).cast("string")).alias("chrom"),
        (start + 1).cast("int").alias("start_pos"),
        (start + F.col("p_size") + 10).cast("int").alias("end_pos"),
        F.lit(".").alias("strand"),
    )


def write_sam(rows: DataFrame, path: str) -> None:
    """Write reads as SAM lines, one folder of text files."""
    length = F.col("end_pos") - F.col("start_pos") + 1
    line = F.concat_ws(
        "\t",
        F.lit("r"),
        F.lit("0"),
        F.col("chrom"),
        F.col("start_pos").cast("string"),
        F.lit("60"),
        F.concat(length.cast("string"), F.lit("M")),
        *[F.lit(v) for v in ("*", "0", "0", "*", "*")],
    )
    rows.select(line.alias("line")).write.text(path)


def write_bed(rows: DataFrame, path: str) -> None:
    columns = ["chrom", "start_pos", "end_pos", "strand", "gene_id", "exon_id"]
    rows.select(*columns).write.option("sep", "\t").csv(path)


def _bgzf(data: bytes) -> bytes:
    deflater = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflater.compress(data) + deflater.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def encode_bam(records, references: list[tuple[str, int]], block_bytes: int = 60_000) -> bytes:
    """BAM bytes of ``(name, flag, chrom, start, mapq, [(length, op)])`` records, without bases."""
    return encode_indexed_bam(records, references, block_bytes)[0]


def _header(references: list[tuple[str, int]]) -> bytes:
    plain = FILE_MAGIC + struct.pack("<ii", 0, len(references))
    for name, length in references:
        plain += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    return plain


def _blocks_and_index(plain: bytes, places, n_references: int, block_bytes: int) -> tuple[bytes, bytes]:
    blocks = [_bgzf(bytes(plain[at : at + block_bytes])) for at in range(0, len(plain), block_bytes)]
    begins = [0]
    for block in blocks:
        begins.append(begins[-1] + len(block))

    def virtual(at: int) -> int:
        return begins[at // block_bytes] << 16 | at % block_bytes

    spots = [(reference, begin, end, virtual(first), virtual(behind)) for reference, begin, end, first, behind in places]
    return b"".join(blocks) + _bgzf(b""), write_index(spots, n_references)


def encode_indexed_bam(records, references: list[tuple[str, int]], block_bytes: int = 60_000) -> tuple[bytes, bytes]:
    """BAM bytes, and the bytes of their index; the records should be sorted by chromosome and position."""
    index = {name: i for i, (name, _) in enumerate(references)}
    plain = bytearray(_header(references))
    places = []
    for name, flag, chrom, start, mapq, cigar in records:
        text = name.encode() + b"\0"
        ops = b"".join(struct.pack("<I", length << 4 | CIGAR_OPS.index(op)) for length, op in cigar)
        reference, end = index.get(chrom, -1), start - 1 + max(1, sum(n for n, op in cigar if op in "MDN=X"))
        core = struct.pack("<iiBBHHHiiii", reference, start - 1, len(text), mapq, 0, len(cigar), flag, 0, -1, -1, 0)
        first = len(plain)
        plain += struct.pack("<i", len(core) + len(text) + len(ops)) + core + text + ops
        places.append((reference, start - 1, end, first, len(plain)))
    return _blocks_and_index(plain, places, len(references), block_bytes)


def encode_indexed_reads(reference: np.ndarray, start: np.ndarray, end: np.ndarray, references: list[tuple[str, int]], block_bytes: int = 60_000) -> tuple[bytes, bytes]:
    """What :func:`encode_indexed_bam` makes of reads ``r0, r1, ...`` of one aligned block, from arrays; reference -1 is none."""
    length = end - start + 1
    if ((length < 0) | (length >= 1 << 28)).any():
        raise ValueError("a read ends before it starts, or is too long for a BAM file")
    parts, sizes, low = [_header(references)], [], 0
    while low < len(start):  # numbers with equally many digits make records of one size
        digits = len(str(low))
        high = min(10**digits, len(start))
        record = np.zeros(high - low, [("size", "<i4"), ("reference", "<i4"), ("at", "<i4"), ("name_size", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_ops", "<u2"), ("flag", "<u2"), ("n_bases", "<i4"), ("mate", "<i4", 2), ("template", "<i4"), ("name", "u1", digits + 2), ("op", "<u4")])
        record["size"], record["name_size"], record["mapq"], record["n_ops"], record["mate"] = record.itemsize - 4, digits + 2, 60, 1, -1
        record["reference"], record["at"], record["op"] = reference[low:high], start[low:high] - 1, length[low:high] << 4
        record["name"][:, 0] = ord("r")
        for k in range(digits):
            record["name"][:, digits - k] = ord("0") + np.arange(low, high) // 10**k % 10
        parts.append(record.tobytes())
        sizes.append(np.full(high - low, record.itemsize))
        low = high
    if not sizes:
        return _blocks_and_index(parts[0], [], len(references), block_bytes)
    # neighbours that begin and end in the same stretches of the index are one entry of it
    begin, behind = start - 1, len(parts[0]) + np.cumsum(np.concatenate(sizes))
    first, until = behind - np.concatenate(sizes), begin + np.maximum(1, length)
    same = [reference, begin >> LINEAR_SHIFT, (until - 1) >> LINEAR_SHIFT]
    heads = np.flatnonzero(np.append(True, np.any([v[1:] != v[:-1] for v in same], axis=0)))
    tails = np.append(heads[1:], len(start)) - 1
    places = zip(*[v.tolist() for v in (reference[heads], begin[heads], until[heads], first[heads], behind[tails])])
    return _blocks_and_index(b"".join(parts), places, len(references), block_bytes)


def write_bam(rows: DataFrame, path: str) -> DataFrame:
    """Write ``rows(sample_id, chrom, start_pos, end_pos)`` as a BAM file with index per sample and partition, in ``sample=<id>`` folders.

    Returns ``(file, n)`` lazily. A partition should be sorted by sample and position; a file is closed after
    ``FILE_READS`` reads, so a task holds no more than that.
    """
    references = [(f"chr{i}", 1 << 29) for i in (1, 2, 3)]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        from basecov.sources.bam import _open_fs

        system, folder = _open_fs(path)
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close(sample: int) -> pd.DataFrame:
            nonlocal number, size
            target = f"{folder}/sample={sample}/part-{part:05d}-{number:05d}.bam"
            system.create_dir(f"{folder}/sample={sample}", recursive=True)
            arrays = [np.concatenate(x) for x in zip(*held)]
            for name, data in zip((target, f"{target}.bai"), encode_indexed_reads(*arrays, references)):
                with system.open_output_stream(name) as out:
                    out.write(data)
            number += 1
            done = pd.DataFrame({"file": [target], "n": [size]})
            held.clear()
            size = 0
            return done

        last = None
        for batch in batches:
            if batch[["sample_id", "start_pos", "end_pos"]].isna().any(axis=None):
                raise ValueError("a read without sample, start or end")
            samples = batch.sample_id.to_numpy(np.int64)
            reference = batch.chrom.map({name: i for i, (name, _) in enumerate(references)}).fillna(-1).to_numpy(np.int64)
            columns = [reference, batch.start_pos.to_numpy(np.int64), batch.end_pos.to_numpy(np.int64)]
            low = 0
            while low < len(samples):
                sample = int(samples[low])
                if held and (sample != last or size >= FILE_READS):
                    yield close(last)
                others = np.flatnonzero(samples[low:] != sample)
                high = min(low + (int(others[0]) if len(others) else len(samples)), low + FILE_READS - size, len(samples))
                held.append([c[low:high] for c in columns])
                last, size, low = sample, size + high - low, high
        if held:
            yield close(last)

    return rows.select("sample_id", "chrom", "start_pos", "end_pos").mapInPandas(write, "file STRING, n BIGINT")


def bam_files(reads_: DataFrame, path: str) -> None:
    """The reads as indexed BAM files below ``sample=<id>`` folders; tasks get ranges of about equal size."""
    parts, by = partitions_by_size(reads_), ("sample_id", "chrom", "start_pos")
    sorted_ = reads_.repartitionByRange(*([parts] if parts else []), *by).sortWithinPartitions(*by)
    write_bam(sorted_, path).count()
