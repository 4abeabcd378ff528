"""The registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basecov import fixtures
from basecov.fixtures import GROUPS, SETTINGS
from basecov.functions import ids, scalars, stats
from basecov.operators import batched_permutation, coverage, intervals, nulldist, permutation, runs, sparse_vectors, vectors
from basecov.plans import diffexpr, jobs, report
from basecov.plans.study import CoverageStudy
from basecov.session import broadcast_if_small, scratch_path
from basecov.sources.alignments import Sample, read_bam, read_sam, read_samples, sample_table
from basecov.sources.annotation import read_exons, read_null_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SHEET = [Sample(i, "case" if i < 4 else "control", f"sample_{i}.bam") for i in range(8)]
TILE, WIDTH = SETTINGS.tile, SETTINGS.bin_width


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])


def joined(vector: str, name: str) -> str:
    return f"array_join(transform({vector}, v -> string(v)), ',') AS {name}"


def _reads(spark, sf_dir):
    return fixtures.reads(spark, sf_dir)


def _exons(spark, sf_dir):
    return fixtures.exons(spark, sf_dir)


def _segments(spark, sf_dir):
    return vectors.group_segments(_reads(spark, sf_dir), GROUPS, tile=TILE)


def _vectors(spark, sf_dir):
    return vectors.with_vectors(_segments(spark, sf_dir), GROUPS)


def _tested(spark, sf_dir):
    return diffexpr.tested_bases(_reads(spark, sf_dir), GROUPS, SETTINGS)


def _regions(spark, sf_dir, **options):
    study = diffexpr.DifferentialExpression(
        _reads(spark, sf_dir), _exons(spark, sf_dir), GROUPS, SETTINGS, **options
    )
    return diffexpr.candidate_regions(study.reads, study.exons, GROUPS, study.settings)


def _study(spark, sf_dir):
    return diffexpr.DifferentialExpression(_reads(spark, sf_dir), _exons(spark, sf_dir), GROUPS, SETTINGS)


def _facade(spark, sf_dir):
    samples = sample_table(spark, SHEET).fillna(1.0, ["norm_factor"])
    return CoverageStudy(_reads(spark, sf_dir), samples, GROUPS.ids, _exons(spark, sf_dir), WIDTH)


# --- coverage ------------------------------------------------------------------------------------------------


@query
def base_coverage(spark, sf_dir):
    return coverage.base_coverage(_reads(spark, sf_dir), tile=TILE)


@query
def base_depth_filter(spark, sf_dir):
    return coverage.bases_at_depth(_reads(spark, sf_dir), 10, tile=TILE)


@query
def base_coverage_region(spark, sf_dir):
    return coverage.base_coverage(_reads(spark, sf_dir), chrom="chr1", start=101, end=40_000, tile=TILE)


@query
def base_coverage_point(spark, sf_dir):
    """Coverage at one packed id, as a range of one base."""
    at = coverage.base_coverage(_reads(spark, sf_dir), chrom="chr1", start=240, end=240, tile=TILE)
    packed = ids.pack_position("sample_id", ids.chrom_number("chrom"), "pos")
    return at.selectExpr(f"{packed} AS packed_id", "cov")


@query
def packed_ids(spark, sf_dir):
    packed = ids.pack_position("sample_id", ids.chrom_number("chrom"), "start_pos")
    position = (
        _reads(spark, sf_dir)
        .selectExpr(f"{packed} AS packed_id")
        .selectExpr(
            "packed_id",
            f"{ids.sample_of('packed_id')} AS sample_id",
            f"{ids.strip_sample('packed_id')} AS position_id",
            f"{ids.strip_region_sample('packed_id')} AS region_id",
        )
    )
    return position.selectExpr(
        "*",
        f"{ids.chrom_number_of('position_id')} AS chrom_num",
        f"{ids.to_coordinates('position_id')} AS at",
        f"{ids.stable_id('ENSE', 'position_id')} AS stable_id",
    ).select("packed_id", "sample_id", "position_id", "region_id", "chrom_num", "at.chrom", "at.pos", "stable_id")


@query
def library_norm(spark, sf_dir):
    reads = _reads(spark, sf_dir)
    factors = coverage.library_factors(reads, sample_table(spark, SHEET))
    depth = coverage.base_segments(reads, factors=factors, tile=TILE)
    totals = depth.groupBy("sample_id").agg(
        F.expr("sum(end_pos - start_pos + 1) AS n_bases"),
        F.expr("sum(bigint(end_pos - start_pos + 1) * cov) AS scaled_cov"),
    )
    return rounded(factors.join(totals, "sample_id"))


@query
def sample_counts(spark, sf_dir):
    return coverage.read_counts(_reads(spark, sf_dir))


@query
def sample_list(spark, sf_dir):
    """The files of the study with the reads that came from each."""
    facade = _facade(spark, sf_dir)
    counts = coverage.read_counts(facade.reads)
    return facade.sample_rows.join(counts, "sample_id", "left").join(facade.samples(), "path").select("path", "n_reads")


@query
def region_coverage(spark, sf_dir):
    return coverage.region_coverage(_reads(spark, sf_dir), _exons(spark, sf_dir), width=WIDTH)


@query
def region_coverage_union(spark, sf_dir):
    return coverage.region_coverage(_reads(spark, sf_dir), _exons(spark, sf_dir), union_mode=True, width=WIDTH)


@query
def gene_coverage_table(spark, sf_dir):
    return _facade(spark, sf_dir).gene_coverage()


@query
def exon_coverage_table(spark, sf_dir):
    return _facade(spark, sf_dir).exon_coverage()


@query
def gene_coverage_list(spark, sf_dir):
    """Gene counts for the genes that have an exon of 59 bases or more."""
    long_exons = _exons(spark, sf_dir).where(F.col("end_pos") - F.col("start_pos") >= 58)
    return _facade(spark, sf_dir).gene_coverage(long_exons.select("gene_id").distinct())


@query
def exon_count_join(spark, sf_dir):
    pairs = vectors.exon_count_join(_reads(spark, sf_dir), _exons(spark, sf_dir), GROUPS, width=WIDTH)
    return pairs.selectExpr("gene_id", "exon_id", joined("x", "x"), joined("y", "y"))


# --- vectors and statistics ----------------------------------------------------------------------------------


@query
def position_vectors(spark, sf_dir):
    rows = _vectors(spark, sf_dir).selectExpr("chrom", "start_pos", "end_pos", joined("x", "x"), joined("y", "y"))
    return coverage.expand_positions(rows)


@query
def position_vectors_sparse(spark, sf_dir):
    """The same vectors in the form for many samples, from sparse lists of changes."""
    found = sparse_vectors.sparse_segments(_reads(spark, sf_dir), GROUPS, tile=TILE)
    rows = found.selectExpr("chrom", "start_pos", "end_pos", joined("x", "x"), joined("y", "y"))
    return coverage.expand_positions(rows)


def _per_base(spark, sf_dir, **columns):
    computed = _vectors(spark, sf_dir).selectExpr(
        "chrom", "start_pos", "end_pos", *[f"{text} AS {name}" for name, text in columns.items()]
    )
    return rounded(coverage.expand_positions(computed))


@query
def vector_stats(spark, sf_dir):
    mean_a, mean_b = stats.vector_mean("x"), stats.vector_mean("y")
    return _per_base(
        spark,
        sf_dir,
        mean_a=mean_a,
        mean_b=mean_b,
        sd_a=stats.vector_stddev("x", mean_a),
        sd_b=stats.vector_stddev("y", mean_b),
        fc=scalars.ratio(mean_a, mean_b),
    )


@query
def cvm_stat(spark, sf_dir):
    return _per_base(spark, sf_dir, t=stats.cvm_statistic("x", "y"))


@query
def ks_stat(spark, sf_dir):
    return _per_base(spark, sf_dir, d=stats.ks_statistic("x", "y"))


@query
def mw_stat(spark, sf_dir):
    return _per_base(spark, sf_dir, u=stats.mann_whitney_statistic("x", "y"))


@query
def cvm_null(spark, sf_dir):
    """The exact null distribution for the study's group sizes, beside the number of bases seen at each step."""
    null = nulldist.cvm_null(spark, 4, 4)
    tested = nulldist.with_cvm_p_value(_segments(spark, sf_dir), GROUPS, null)
    observed = tested.groupBy("p").agg(F.expr("sum(end_pos - start_pos + 1) AS n_bases"))
    beside = null.join(broadcast_if_small(observed), F.expr("tail = p"), "left")
    return rounded(beside.selectExpr("t", "ways", "cdf", "tail", "coalesce(n_bases, 0L) AS n_bases"))


@query
def cvm_base_test(spark, sf_dir):
    rows = _tested(spark, sf_dir).select("chrom", "start_pos", "end_pos", "t", "p", "fc", "avg_a", "avg_b")
    return rounded(coverage.expand_positions(rows))


@query
def cvm_base_test_table(spark, sf_dir):
    """The base test with its null distribution read from a file of statistics and cumulative chances."""
    path = scratch_path(spark, "null")
    nulldist.cvm_null(spark, 4, 4).select("t", "cdf").write.option("sep", "\t").csv(path)
    null = nulldist.tails_of_table(read_null_table(spark, path, 4, 4))
    tested = diffexpr.tested_bases(_reads(spark, sf_dir), GROUPS, SETTINGS, null)
    rows = tested.select("chrom", "start_pos", "end_pos", "t", "p", "fc", "avg_a", "avg_b")
    return rounded(coverage.expand_positions(rows))


@query
def fisher_combined(spark, sf_dir):
    """Fisher's combination of the p-values of the bases in each window of 100 bases."""
    rows = coverage.expand_positions(_tested(spark, sf_dir).select("chrom", "start_pos", "end_pos", "p"))
    windows = rows.groupBy("chrom", F.expr(f"{intervals.bin_of('pos', 100)} AS win")).agg(
        F.expr("collect_list(p) AS ps")
    )
    combined = windows.selectExpr(
        "chrom", "win", f"{stats.fisher_statistic('ps')} AS stat", f"{stats.fisher_dof('ps')} AS dof"
    )
    tails = [f"{stats.fisher_p('stat', 'dof')} AS p", f"{stats.fisher_p('stat', 'dof', folded=True)} AS p_folded"]
    return rounded(combined.selectExpr("*", *tails))


@query
def vector_scalars(spark, sf_dir):
    """Pooling, splitting by mask, split counts and elementary functions on the count vectors."""
    chosen, rest = scalars.split_by_mask(scalars.pooled("x", "y"), f"{0b10010110}L")
    rows = _vectors(spark, sf_dir).selectExpr(
        "chrom",
        "start_pos",
        "end_pos",
        joined(chosen, "chosen"),
        joined(rest, "rest"),
        f"{scalars.split_count(8, 4, 1000)} AS ways",
        "signum(double(x[0] - y[0])) AS direction",
        "abs(x[0] - y[0]) AS size",
        "greatest(x[0], y[0]) AS larger",
        "least(x[0], y[0]) AS smaller",
        "sqrt(avg_a) AS root",
        "pow(avg_b, 2) AS square",
        "ln(avg_a + 1) AS log",
    )
    return rounded(coverage.expand_positions(rows))


# --- regions -------------------------------------------------------------------------------------------------


@query
def islands_le(spark, sf_dir):
    return rounded(runs.contiguous_runs(_tested(spark, sf_dir), tile=TILE))


@query
def islands_equal(spark, sf_dir):
    return rounded(runs.contiguous_runs(_tested(spark, sf_dir), equal_p=True, tile=TILE))


@query
def region_exon_map(spark, sf_dir):
    found = runs.contiguous_runs(_tested(spark, sf_dir), tile=TILE)
    return rounded(intervals.map_regions_to_exons(found, _exons(spark, sf_dir), WIDTH))


@query
def point_exon_lookup(spark, sf_dir):
    points = _reads(spark, sf_dir).select("sample_id", "chrom", F.col("start_pos").alias("pos"))
    return intervals.lookup_exon_at(points, _exons(spark, sf_dir), WIDTH)


@query
def exon_range_lookup(spark, sf_dir):
    counts = coverage.region_coverage(_reads(spark, sf_dir), _exons(spark, sf_dir), width=WIDTH)
    return intervals.lookup_exon_range(counts, _exons(spark, sf_dir))


@query
def signed_fold_change(spark, sf_dir):
    rows = _tested(spark, sf_dir).selectExpr(
        "chrom", "start_pos", "end_pos", f"{scalars.signed_fold_change('fc')} AS fc"
    )
    return rounded(coverage.expand_positions(rows))


@query
def coalesce_regions(spark, sf_dir):
    return rounded(_regions(spark, sf_dir, min_region_len=1))


@query
def coalesce_regions_equal_p(spark, sf_dir):
    return rounded(_regions(spark, sf_dir, min_region_len=1, coalesce_p=False, merge_adjacent=True))


@query
def phase1_regions(spark, sf_dir):
    return rounded(_regions(spark, sf_dir))


@query
def exon_candidates(spark, sf_dir):
    return diffexpr.exon_candidates(_regions(spark, sf_dir), _exons(spark, sf_dir))


@query
def new_region_candidates(spark, sf_dir):
    return diffexpr.new_region_candidates(_regions(spark, sf_dir, min_region_len=1), TILE)


# --- phase 2 and reports -------------------------------------------------------------------------------------


@query
def permutation_test(spark, sf_dir):
    return rounded(
        diffexpr.permutation_tests(_reads(spark, sf_dir), _exons(spark, sf_dir), GROUPS, SETTINGS)
    )


@query
def permutation_test_unequal(spark, sf_dir):
    """Five samples against three, counted along lattice paths."""
    groups = vectors.Groups(case=(0, 1, 2, 3, 4), control=(5, 6, 7))
    counts = vectors.region_vectors(_reads(spark, sf_dir), _exons(spark, sf_dir), groups, width=WIDTH)
    return rounded(permutation.permutation_test(counts, ["gene_id", "exon_id"], groups, listed_splits=0))


@query
def permutation_test_plugin(spark, sf_dir):
    """The same test with a user-chosen statistic, here Mann-Whitney's U."""
    counts = vectors.region_vectors(_reads(spark, sf_dir), _exons(spark, sf_dir), GROUPS, width=WIDTH)
    return rounded(
        permutation.permutation_test(
            counts, ["gene_id", "exon_id"], GROUPS, [stats.mann_whitney_statistic]
        )
    )


@query
def permutation_test_batched(spark, sf_dir):
    """The same test with the statistic as a function over arrays of regions and splits."""
    counts = vectors.region_vectors(_reads(spark, sf_dir), _exons(spark, sf_dir), GROUPS, width=WIDTH)
    keys = ["gene_id", "exon_id"]
    return rounded(batched_permutation.permutation_test_batched(counts, keys, GROUPS, batched_permutation.mann_whitney_u))


@query
def phase2_regions(spark, sf_dir):
    return rounded(_study(spark, sf_dir).confirmed())


@query
def exon_summary(spark, sf_dir):
    return rounded(diffexpr.exon_summary(_study(spark, sf_dir).confirmed()))


@query
def exon_summary_ranked(spark, sf_dir):
    """The summary in the order of its report. Rounded first, so that equal rows are told apart by their names."""
    return report.ordered_summary(exon_summary(spark, sf_dir))


@query
def top_regions(spark, sf_dir):
    return rounded(report.top_regions(_study(spark, sf_dir).confirmed(), 20))


@query
def region_report(spark, sf_dir):
    return report.region_lines(_study(spark, sf_dir).confirmed()).select("line")


@query
def exon_report(spark, sf_dir):
    return report.exon_lines(diffexpr.exon_summary(_study(spark, sf_dir).confirmed())).select("line")


@query
def report_sinks(spark, sf_dir):
    """Write every output of a study and count the lines read back."""
    study, base = _study(spark, sf_dir), scratch_path(spark, "sinks")
    exons, novel = study.find_candidate_regions()
    report.write_regions(study.regions, f"{base}/phase1")
    report.write_regions(study.results, f"{base}/results", "csv")
    report.write_candidates(exons, f"{base}/exons")
    report.write_candidates(novel, f"{base}/novel")
    report.write_region_report(study.results, f"{base}/report")
    report.write_exon_report(study.summary(), f"{base}/exon_report")
    back = {
        "phase1": spark.read.parquet(f"{base}/phase1"),
        "results": spark.read.option("sep", "\t").option("header", True).csv(f"{base}/results"),
    } | {name: spark.read.text(f"{base}/{name}") for name in ("exons", "novel", "report", "exon_report")}
    counts = [df.agg(F.lit(name).alias("sink"), F.count(F.lit(1)).alias("n")) for name, df in back.items()]
    result = counts[0]
    for more in counts[1:]:
        result = result.unionByName(more)
    return result


@query
def de_job(spark, sf_dir):
    """The whole job: BAM files of a sheet and an annotation file in, results read back from the folder it names."""
    base = scratch_path(spark, "job")
    fixtures.bam_files(_reads(spark, sf_dir), f"{base}/bam")
    fixtures.write_bed(_exons(spark, sf_dir), f"{base}/exons")
    sheet = [Sample(s.sample_id, s.group, f"{base}/bam/sample={s.sample_id}/*.bam", 1.0) for s in SHEET]
    jobs.find_de_regions(spark, jobs.StudyFiles(sheet, f"{base}/exons"), f"{base}/out", max_p=SETTINGS.max_p, settings=SETTINGS)
    name = f"results_10_{scalars.chrom_label('*')}_{SETTINGS.max_p}"
    return rounded(spark.read.parquet(f"{base}/out/{name}").withColumn("job", F.lit(name)))


# --- sources -------------------------------------------------------------------------------------------------


def _read_totals(reads: DataFrame, *keys: str) -> DataFrame:
    return reads.groupBy(*keys, "chrom").agg(
        F.count(F.lit(1)).alias("n_reads"),
        F.sum("start_pos").cast("bigint").alias("sum_start"),
        F.sum("end_pos").cast("bigint").alias("sum_end"),
    )


@query
def sam_source(spark, sf_dir):
    """The reads written as SAM text and read back."""
    path = scratch_path(spark, "sam")
    fixtures.write_sam(_reads(spark, sf_dir), path)
    return _read_totals(read_sam(spark, path))


@query
def bam_source(spark, sf_dir):
    """The reads of each sample written as BAM files and scanned by byte ranges."""
    path = scratch_path(spark, "bam")
    fixtures.bam_files(_reads(spark, sf_dir), path)
    return _read_totals(read_bam(spark, path, split_bytes=65_536, columns=["chrom", "start_pos", "end_pos"]))


@query
def bam_region_coverage(spark, sf_dir):
    """Depth of a region over all samples; only the indexed parts of the files that can hold its reads are decoded."""
    path = scratch_path(spark, "bam")
    fixtures.bam_files(_reads(spark, sf_dir), path)
    reads = read_bam(spark, path, columns=["chrom", "start_pos", "end_pos"]).withColumn("sample_id", F.lit(0))
    return coverage.base_coverage(reads, chrom="chr1", start=101, end=40_000, tile=TILE).select("chrom", "pos", "cov")


@query
def sample_sheet_source(spark, sf_dir):
    """A sheet of SAM and BAM files: samples 0-3 as text, 4-7 as BAM, each format one scan."""
    path = scratch_path(spark, "sheet")
    reads = _reads(spark, sf_dir)
    for sample in range(4):
        fixtures.write_sam(reads.where(F.col("sample_id") == sample), f"{path}/sam/{sample}.sam")
    fixtures.bam_files(reads.where("sample_id >= 4"), f"{path}/bam")
    sheet = [Sample(i, "case", f"{path}/sam/{i}.sam") for i in range(4)] + [Sample(i, "control", f"{path}/bam/sample={i}/*.bam") for i in range(4, 8)]
    return _read_totals(read_samples(spark, sheet), "sample_id")


@query
def bed_source(spark, sf_dir):
    """The annotation written as a BED-like file and read back."""
    path = scratch_path(spark, "bed")
    fixtures.write_bed(_exons(spark, sf_dir), path)
    return read_exons(spark, path)
