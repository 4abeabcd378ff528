"""Complete jobs from sample sheets and annotation files to written results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from basecov.functions.scalars import chrom_label
from basecov.operators.coverage import ALL_CHROMOSOMES, bases_at_depth, library_factors
from basecov.operators.vectors import Groups, exon_count_join
from basecov.plans.diffexpr import DifferentialExpression, Settings
from basecov.plans.report import write_candidates, write_exon_report, write_region_report, write_regions
from basecov.sources.alignments import Sample, read_sample, read_samples, sample_table
from basecov.sources.annotation import read_exons

CASE, CONTROL = "case", "control"


@dataclass(frozen=True)
class StudyFiles:
    """Inputs of a study: the sample sheet (groups ``case`` and ``control``) and the exon annotation."""

    samples: Sequence[Sample]
    exons: str


def study_groups(spark: SparkSession, reads: DataFrame, sheet: Sequence[Sample]) -> Groups:
    """Groups of a sheet; factors that the sheet leaves open come from the library sizes (one count job for all)."""
    factors = {s.sample_id: s.norm_factor for s in sheet if s.norm_factor is not None}
    if len(factors) < len(sheet):
        counted = library_factors(reads, sample_table(spark, sheet)).select("sample_id", "norm_factor").collect()
        factors = {row.sample_id: row.norm_factor for row in counted} | factors
    return Groups(
        tuple(s.sample_id for s in sheet if s.group == CASE),
        tuple(s.sample_id for s in sheet if s.group == CONTROL),
        factors,
    )


def find_de_regions(
    spark: SparkSession,
    files: StudyFiles,
    out_dir: str,
    chrom: str = ALL_CHROMOSOMES,
    min_region_len: int = 10,
    max_p: float = 0.05,
    settings: Settings = Settings(),
) -> DifferentialExpression:
    """Differentially expressed regions of a study; writes regions, candidates and both reports below ``out_dir``."""
    reads = read_samples(spark, files.samples)
    groups = study_groups(spark, reads, files.samples)
    study = DifferentialExpression(
        reads,
        read_exons(spark, files.exons),
        groups,
        settings,
        chrom=chrom,
        min_region_len=min_region_len,
        max_p=max_p,
    )
    tag = f"{min_region_len}_{chrom_label(chrom)}_{max_p}"
    exons, novel = study.find_candidate_regions()
    write_regions(study.regions, f"{out_dir}/phase1_{tag}")
    write_candidates(exons, f"{out_dir}/exons_candidates_{tag}")
    write_candidates(novel, f"{out_dir}/regions_candidates_{tag}")
    write_regions(study.results, f"{out_dir}/results_{tag}")
    write_region_report(study.results, f"{out_dir}/report_{tag}")
    write_exon_report(study.summary(), f"{out_dir}/exon_report_{tag}")
    return study


def compare_exon_counts(spark: SparkSession, files: StudyFiles) -> DataFrame:
    """Exon counts of both groups for the exons seen in both."""
    reads = read_samples(spark, files.samples)
    groups = Groups(
        tuple(s.sample_id for s in files.samples if s.group == CASE),
        tuple(s.sample_id for s in files.samples if s.group == CONTROL),
        {s.sample_id: s.norm_factor for s in files.samples if s.norm_factor is not None},
    )
    return exon_count_join(reads, read_exons(spark, files.exons), groups)


def count_deep_bases(spark: SparkSession, path: str, sample_id: int = 1, min_depth: int = 10) -> DataFrame:
    """Number of bases of one file covered by at least ``min_depth`` reads."""
    return bases_at_depth(read_sample(spark, path, sample_id), min_depth)
