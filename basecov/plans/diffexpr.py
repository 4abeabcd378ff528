"""Two-phase differential expression: candidate regions from base-level tests, then permutation tests of their exons."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basecov.functions.ids import new_region_id
from basecov.functions.scalars import signed_fold_change
from basecov.functions.stats import Statistic, cvm_statistic, ks_statistic
from basecov.operators.coverage import ALL_CHROMOSOMES, TILE
from basecov.operators.intervals import BIN_WIDTH, UNKNOWN_EXON, map_regions_to_exons
from basecov.operators.nulldist import with_cvm_p_value
from basecov.operators.permutation import permutation_test
from basecov.operators.runs import contiguous_runs, merge_regions, running_number
from basecov.operators.vectors import Groups, group_segments, region_vectors
from basecov.session import broadcast_if_small, stored

REGION_COLUMNS = (
    "chrom",
    "start_pos",
    "length",
    "p",
    "fc",
    "gene_id",
    "exon_id",
    "overlap_pct",
    "avg_a",
    "avg_b",
)
MAX_BOUNDS = 200
CANDIDATE_COLUMNS = ("gene_id", "exon_id", "chrom", "start_pos", "end_pos", "strand")


@dataclass(frozen=True)
class Settings:
    """Parameters of the pipeline; ``tile`` and ``bin_width`` only affect how the work is cut."""

    chrom: str = ALL_CHROMOSOMES
    start: int = 1
    end: int | None = None
    min_coverage: float = 1.0
    min_region_len: int = 1
    max_p: float = 0.1
    coalesce_p: bool = True
    merge_adjacent: bool = False
    max_splits: int | None = None
    seed: int = 0
    statistics: Sequence[Statistic] = field(default=(cvm_statistic, ks_statistic))
    tile: int = TILE
    bin_width: int = BIN_WIDTH


def tested_bases(
    reads: DataFrame, groups: Groups, settings: Settings = Settings(), null: DataFrame | None = None
) -> DataFrame:
    """Stretches of bases with ``p <= max_p``: ``(chrom, tile, start_pos, end_pos, ..., p, fc, avg_a, avg_b)``."""
    segments = group_segments(
        reads, groups, settings.chrom, settings.start, settings.end, settings.min_coverage, settings.tile
    )
    return with_cvm_p_value(segments, groups, null, settings.max_p)


def annotated_runs(tested: DataFrame, exons: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Runs of tested bases with their exons and signed fold changes."""
    runs = contiguous_runs(tested, not settings.coalesce_p, settings.tile)
    mapped = map_regions_to_exons(runs, exons, settings.bin_width, settings.tile)
    others = [c for c in mapped.columns if c != "fc"]
    return mapped.selectExpr(*others, f"{signed_fold_change('fc')} AS fc")


def candidate_regions(
    reads: DataFrame,
    exons: DataFrame,
    groups: Groups,
    settings: Settings = Settings(),
    null: DataFrame | None = None,
) -> DataFrame:
    """Phase 1: regions with the columns :data:`REGION_COLUMNS`."""
    annotated = annotated_runs(tested_bases(reads, groups, settings, null), exons, settings)
    return merge_regions(
        annotated, settings.min_region_len, settings.coalesce_p, settings.merge_adjacent, settings.tile
    )


def exon_candidates(regions: DataFrame, exons: DataFrame) -> DataFrame:
    """Annotated exons that a region was mapped to, with the annotation's coordinates."""
    named = regions.where(f"exon_id <> '{UNKNOWN_EXON}'").select("gene_id", "exon_id")
    found = exons.join(named, ["gene_id", "exon_id"], "left_semi")
    single = found.groupBy("gene_id", "exon_id").agg(F.expr("max(struct(chrom, start_pos, end_pos)) AS at"))
    return single.selectExpr("gene_id", "exon_id", "at.chrom", "at.start_pos", "at.end_pos", "'.' AS strand")


def new_region_candidates(regions: DataFrame, tile: int = TILE) -> DataFrame:
    """Regions outside the annotation, numbered ``NEWREG...`` by chromosome and start."""
    novel = (
        regions.where(f"exon_id = '{UNKNOWN_EXON}'")
        .selectExpr("chrom", "start_pos", "start_pos + length AS end_pos")
        .distinct()
    )
    return running_number(novel, ["end_pos"], tile).selectExpr(
        f"{new_region_id('number')} AS gene_id",
        f"'{UNKNOWN_EXON}' AS exon_id",
        "chrom",
        "start_pos",
        "end_pos",
        "'.' AS strand",
    )


def permutation_tests(
    reads: DataFrame, candidates: DataFrame, groups: Groups, settings: Settings = Settings()
) -> DataFrame:
    """Phase 2 per candidate: ``(gene_id, exon_id, fc, p2)`` from its reads in both groups."""
    vectors = region_vectors(reads, candidates, groups, width=settings.bin_width)
    return permutation_test(
        vectors,
        ["gene_id", "exon_id"],
        groups,
        settings.statistics,
        settings.max_splits,
        settings.seed,
        carry=["fc"],
    )


def reads_near(reads: DataFrame, candidates: DataFrame) -> DataFrame:
    """Reads between the first and the last base of the candidates of their chromosome; none of a candidate is lost.

    The bounds are fetched (one row per chromosome; beyond ``MAX_BOUNDS`` chromosomes only the outermost ones are) and
    become plain comparisons, which a scan can use to skip files, row groups and byte ranges. ``candidates`` should be
    cheap to evaluate, such as stored ones.
    """
    per_chrom = candidates.where("chrom IS NOT NULL").groupBy("chrom").agg(
        F.expr("min(start_pos) AS first_pos"), F.expr("max(end_pos) AS last_pos")
    )
    found = [r for r in per_chrom.limit(MAX_BOUNDS + 1).collect() if r.first_pos is not None and r.last_pos is not None]
    if not found:
        return reads.where("false")
    if len(found) > MAX_BOUNDS:
        outer = per_chrom.agg(F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos")).first()
        return reads.where((F.col("end_pos") >= outer.first_pos) & (F.col("start_pos") <= outer.last_pos))
    outermost = (F.col("end_pos") >= min(r.first_pos for r in found)) & (F.col("start_pos") <= max(r.last_pos for r in found))
    if len(found) == 1:
        return reads.where((F.col("chrom") == found[0].chrom) & outermost)
    inside = [(F.col("chrom") == r.chrom) & (F.col("end_pos") >= r.first_pos) & (F.col("start_pos") <= r.last_pos) for r in found]
    return reads.where(F.col("chrom").isin([r.chrom for r in found]) & outermost & reduce(or_, inside))


def confirmed_regions(regions: DataFrame, tests: DataFrame) -> DataFrame:
    """Phase-1 regions with the phase-2 p-value of their exon; regions outside the annotation drop out."""
    p2 = tests.select("gene_id", "exon_id", "p2")
    return regions.join(broadcast_if_small(p2), ["gene_id", "exon_id"]).select(*REGION_COLUMNS, "p2")


def exon_summary(confirmed: DataFrame) -> DataFrame:
    """One row per exon: length-weighted means over its regions, summed overlap, and the phase-2 p-value."""

    def weighted(column: str, name: str):
        return F.expr(f"sum({column} * length) / sum(length) AS {name}")

    return confirmed.groupBy("gene_id", "exon_id").agg(
        F.expr("max(p2) AS p2"),
        weighted("p", "p1"),
        weighted("fc", "fc"),
        F.expr("sum(overlap_pct) AS overlap_pct"),
        weighted("avg_a", "avg_a"),
        weighted("avg_b", "avg_b"),
    )


class DifferentialExpression:
    """The pipeline over one study.

    The regions of phase 1 are needed by every later step; they are written to the shared checkpoint folder once, so
    later steps do not scan the reads for them again. The same goes for the results, which all reports start from.
    """

    def __init__(
        self,
        reads: DataFrame,
        exons: DataFrame,
        groups: Groups,
        settings: Settings = Settings(),
        null: DataFrame | None = None,
        **options,
    ):
        self.reads, self.exons, self.groups, self.null = reads, exons, groups, null
        self.settings = replace(settings, **options)

    @cached_property
    def regions(self) -> DataFrame:
        found = candidate_regions(self.reads, self.exons, self.groups, self.settings, self.null)
        return stored(found, "regions")

    @cached_property
    def exon_candidates(self) -> DataFrame:
        return exon_candidates(self.regions, self.exons)

    @cached_property
    def new_region_candidates(self) -> DataFrame:
        return new_region_candidates(self.regions, self.settings.tile)

    def find_candidate_regions(self) -> tuple[DataFrame, DataFrame]:
        """Phase 1: exon candidates and novel-region candidates."""
        return self.exon_candidates, self.new_region_candidates

    def test_regions(self, candidates: DataFrame | None = None) -> DataFrame:
        """Phase 2 over the exon candidates, or over another candidate frame."""
        chosen = self.exon_candidates if candidates is None else candidates
        return permutation_tests(reads_near(self.reads, chosen), chosen, self.groups, self.settings)

    def confirmed(self) -> DataFrame:
        """Regions with both p-values, for a single use."""
        return confirmed_regions(self.regions, self.test_regions())

    @cached_property
    def results(self) -> DataFrame:
        """The confirmed regions, stored for several uses."""
        return stored(self.confirmed(), "results")

    def summary(self) -> DataFrame:
        return exon_summary(self.results)
