"""Alignments as DataFrames: SAM text, BAM and Parquet, and sample sheets over many files."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basecov.sources.bam import BamDataSource, is_reachable, list_files
from basecov.sources.lines import LineDataSource

READ_COLUMNS = ("read_name", "flag", "chrom", "start_pos", "end_pos", "mapq", "cigar")
# Fixed CIGAR letters that advance the position on the reference sequence.
REFERENCE_OPS = "MDN=X"


@dataclass(frozen=True)
class Sample:
    """One sample of a study: ``path`` may be a glob over the files of the sample."""

    sample_id: int
    group: str
    path: str
    norm_factor: float | None = None


def reference_length(cigar: str) -> str:
    """Reference bases spanned by a CIGAR text."""
    single = f"regexp_extract({cigar}, '^([0-9]+)M$', 1)"
    lengths = f"regexp_extract_all({cigar}, '([0-9]+)[{REFERENCE_OPS}]', 1)"
    return f"if({single} <> '', int({single}), aggregate({lengths}, 0, (acc, n) -> acc + int(n)))"


def read_sam(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """SAM text lines (header lines skipped) with the reference end derived from the CIGAR text.

    A filter on the result may be evaluated together with the one that skips header lines, so the fields are read
    in a way that also accepts those; an alignment line with too few fields is an error.
    """
    paths = [path] if isinstance(path, str) else list(path)
    return _sam_rows(spark.read.text(paths).selectExpr("value", "_metadata.file_path AS file_path"), "file_path")


def _sam_rows(lines: DataFrame, source: str) -> DataFrame:
    """The fields of alignment lines ``value``; the column ``source`` passes through."""
    lines = lines.selectExpr(source, "value", "split(value, '\t', 12) AS field")
    short = "if(value LIKE '@%', NULL, raise_error(concat('not an alignment line: ', value)))"
    rows = lines.where("NOT value LIKE '@%'").selectExpr(
        source,
        "get(field, 0) AS read_name",
        "try_cast(get(field, 1) AS INT) AS flag",
        f"if(size(field) >= 11, get(field, 2), {short}) AS chrom",
        "try_cast(get(field, 3) AS INT) AS start_pos",
        "try_cast(get(field, 4) AS INT) AS mapq",
        "get(field, 5) AS cigar",
    )
    end = f"start_pos + {reference_length('cigar')} - 1 AS end_pos"
    return rows.selectExpr(source, "read_name", "flag", "chrom", "start_pos", end, "mapq", "cigar")


def _absolute(path: str) -> str:
    """Tasks may have another working folder than the driver."""
    return path if ":" in path else os.path.abspath(path)


def read_bam(
    spark: SparkSession, path: str | Sequence[str] | Sequence[tuple[int, str]], split_bytes: int = 64 * 1024 * 1024, columns: Sequence[str] | None = None
) -> DataFrame:
    """BAM files as rows; large files are read in parallel by byte ranges of about ``split_bytes``.

    ``(sample id, path)`` pairs give one scan over all samples with the column ``sample_id``. ``columns`` names those to
    build. Spark hands filters on chromosome, positions, flag and quality down to the scan, which then reads only the
    parts of indexed files (``.bai``) that the region needs.
    """
    spark.dataSource.register(BamDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("basecov-bam").option("split_bytes", str(split_bytes))
    if columns is not None:
        reader = reader.option("columns", ",".join(columns))
    paths = [path] if isinstance(path, str) else list(path)
    if paths and not isinstance(paths[0], str):
        return reader.option("samples", json.dumps([(i, _absolute(p)) for i, p in paths])).load()
    return reader.option("paths", "\n".join(map(_absolute, paths))).load()


def read_alignments(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Choose the reader by file ending: ``.bam``, ``.sam``, otherwise Parquet with the read columns."""
    paths = [path] if isinstance(path, str) else list(path)
    endings = {p.rsplit(".", 1)[-1].lower() for p in paths}
    if endings == {"bam"}:
        return read_bam(spark, paths)
    if endings == {"sam"}:
        return read_sam(spark, paths)
    if endings & {"bam", "sam"}:
        raise ValueError("one call reads files of one format")
    rows = spark.read.parquet(*paths)
    return rows.select(F.col("_metadata.file_path").alias("file_path"), *[c for c in READ_COLUMNS if c in rows.columns])


def read_sample(spark: SparkSession, path: str, sample_id: int) -> DataFrame:
    """The reads of one file as one sample."""
    return read_alignments(spark, path).select(F.lit(sample_id).alias("sample_id"), "*").drop("file_path")


def sample_table(spark: SparkSession, sheet: Sequence[Sample]) -> DataFrame:
    """``samples(ord, sample_id, grp, path, norm_factor)`` in the order of the sheet."""
    rows = [(i, s.sample_id, s.group, s.path, s.norm_factor) for i, s in enumerate(sheet)]
    return spark.createDataFrame(rows, "ord INT, sample_id INT, grp STRING, path STRING, norm_factor DOUBLE")


def _by_format(path: str) -> dict[str, list[str]]:
    """The format of a path or glob by its ending; a path without a known ending is listed, else it is Parquet."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending in ("bam", "sam"):
        return {ending: [path]}
    found: dict[str, list[str]] = {}
    for name, _ in list_files(path):
        ending = name.rsplit(".", 1)[-1].lower()
        found.setdefault(ending if ending in ("bam", "sam") else "parquet", []).append(name)
    if not found:
        raise FileNotFoundError(path)
    return {"parquet": [path]} if set(found) == {"parquet"} else found


def read_samples(spark: SparkSession, sheet: Sequence[Sample]) -> DataFrame:
    """All reads of a sheet, tagged with their ``sample_id``.

    All BAM files of the sheet are one scan, and all SAM files another, whose partitions carry the id of their sample:
    the plan does not grow with the samples, no file has to be recognised by the spelling of its path, and a file that
    two samples name belongs to both. Parquet folders, and SAM files in a store that only Spark reads, are a scan each. A path without files is an error; a repeated
    line of the sheet counts once.
    """
    by_format: dict[str, list[tuple[int, str]]] = {}
    for sample_id, path in dict.fromkeys((s.sample_id, s.path) for s in sheet):
        for ending, paths in _by_format(path).items():
            if ending != "parquet" and not all(list_files(_absolute(p)) for p in paths if ending == "bam" or is_reachable(_absolute(p))):
                raise FileNotFoundError(path)
            by_format.setdefault(ending, []).extend((sample_id, p) for p in paths)
    parts = []
    if "bam" in by_format:
        parts.append(read_bam(spark, by_format["bam"], columns=["sample_id", *READ_COLUMNS]))
    spark_only = [(i, p) for i, p in by_format.get("sam", []) if not is_reachable(_absolute(p))]
    parts += [read_sam(spark, p).drop("file_path").select(F.lit(i).cast("int").alias("sample_id"), "*") for i, p in spark_only]
    if texts := [x for x in by_format.get("sam", []) if x not in spark_only]:
        spark.dataSource.register(LineDataSource)
        pairs = json.dumps([(i, _absolute(p)) for i, p in texts])
        parts.append(_sam_rows(spark.read.format(LineDataSource.name()).option("samples", pairs).load(), "sample_id"))
    for sample_id, path in by_format.get("parquet", []):
        try:
            rows = read_alignments(spark, path)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                raise FileNotFoundError(path) from e
            raise
        parts.append(rows.drop("file_path").select(F.lit(sample_id).cast("int").alias("sample_id"), "*"))
    reads = parts[0]
    for part in parts[1:]:
        reads = reads.unionByName(part)
    return reads
