"""BED-like exon annotations and null-distribution tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basecov.functions.stats import cvm_scale

EXON_COLUMNS = ("gene_id", "exon_id", "chrom", "start_pos", "end_pos", "strand")
_BED_SCHEMA = "chrom STRING, start_pos INT, end_pos INT, strand STRING, gene_id STRING, exon_id STRING"


def read_exons(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tab-separated ``chrom start end strand gene exon`` rows without a header; blanks around names are dropped."""
    rows = (
        spark.read.schema(_BED_SCHEMA)
        .option("sep", "\t")
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("comment", "#")
        .csv(path)
    )
    return rows.select(*EXON_COLUMNS)


def read_null_table(spark: SparkSession, path: str, n: int, m: int) -> DataFrame:
    """``statistic <tab> cumulative probability`` rows for group sizes ``n`` and ``m`` -> ``(score, t, cdf)``."""
    rows = (
        spark.read.schema("t DOUBLE, cdf DOUBLE")
        .option("sep", "\t")
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )
    return rows.select(F.round(F.col("t") * cvm_scale(n, m)).cast("bigint").alias("score"), "t", "cdf")
