"""Facade over one set of samples; every method returns a lazy DataFrame.

Base coverages start no job before an action; feature coverages count the bins of the annotation first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from basecov.operators.coverage import base_coverage, coverage_table, of_genes, region_coverage
from basecov.operators.intervals import BIN_WIDTH
from basecov.sources.alignments import Sample, read_samples, sample_table


class CoverageStudy:
    def __init__(
        self,
        reads: DataFrame,
        samples: DataFrame,
        sample_ids: Sequence[int],
        exons: DataFrame | None = None,
        bin_width: int = BIN_WIDTH,
    ):
        self.reads, self.sample_rows, self.sample_ids = reads, samples, tuple(sample_ids)
        self.exons, self.bin_width = exons, bin_width

    @classmethod
    def open(cls, spark: SparkSession, sheet: Sequence[Sample], exons: DataFrame | None = None) -> CoverageStudy:
        samples = sample_table(spark, sheet).fillna(1.0, ["norm_factor"])
        return cls(read_samples(spark, sheet), samples, [s.sample_id for s in sheet], exons)

    @property
    def sample_num(self) -> int:
        return len(self.sample_ids)

    def samples(self) -> DataFrame:
        return self.sample_rows.select("path")

    def base_coverage(self) -> DataFrame:
        return base_coverage(self.reads, factors=self.sample_rows)

    def base_coverage_region(self, chrom: str, start: int, end: int) -> DataFrame:
        return base_coverage(self.reads, chrom=chrom, start=start, end=end, factors=self.sample_rows)

    def region_coverage(self, exons: DataFrame | None = None, union_mode: bool = False) -> DataFrame:
        chosen = self.exons if exons is None else exons
        return region_coverage(self.reads, chosen, union_mode, self.sample_rows, self.bin_width)

    def exon_coverage(self) -> DataFrame:
        return coverage_table(self.region_coverage(), self.sample_ids, "exon")

    def gene_coverage(self, genes: Sequence[str] | DataFrame | None = None) -> DataFrame:
        counts = self.region_coverage()
        return coverage_table(counts if genes is None else of_genes(counts, genes), self.sample_ids, "gene")
