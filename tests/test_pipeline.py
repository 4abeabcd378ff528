import glob
import random

import pytest

from basecov.operators import coverage
from basecov.operators.vectors import Groups
from basecov.plans import diffexpr, report
from basecov.plans.diffexpr import DifferentialExpression, Settings, permutation_tests, reads_near
from basecov.plans.jobs import StudyFiles, compare_exon_counts, count_deep_bases, find_de_regions, study_groups
from basecov.plans.study import CoverageStudy
from basecov.sources.alignments import Sample, read_samples


def sam_line(start, length):
    return f"r\t0\tchr1\t{start}\t60\t{length}M\t*\t0\t0\t*\t*"


@pytest.fixture(scope="module")
def study_files(tmp_path_factory):
    """Three case and three control samples: more case reads at 1000-1060, and at 3000-3050 outside the annotation."""
    folder = tmp_path_factory.mktemp("study")
    draw = random.Random(12)
    sheet = []
    for i in range(6):
        case = i < 3
        lines = [sam_line(1000 + draw.randint(0, 3), 60) for _ in range(12 + i if case else 2 + i % 3)]
        lines += [sam_line(3000, 50) for _ in range(7 if case else 1 + i % 3)]
        lines += [sam_line(5000, 80)] * 4
        path = folder / f"sample_{i}.sam"
        path.write_text("\n".join(lines) + "\n")
        sheet.append(Sample(i + 1, "case" if case else "control", str(path), 1.0))
    bed = folder / "exons.bed"
    bed.write_text("chr1\t990\t1040\t.\tg1\te1\nchr1\t1030\t1100\t.\tg2\te2\nchr1\t5000\t5080\t.\tg3\te3\n")
    return StudyFiles(sheet, str(bed))


def text_of(path):
    return [line for part in sorted(glob.glob(f"{path}/part-*")) for line in open(part).read().splitlines()]


def test_de_job_from_files_to_reports(spark, study_files, tmp_path):
    study = find_de_regions(spark, study_files, str(tmp_path), min_region_len=10, max_p=0.1)
    regions = {(r.gene_id, r.exon_id) for r in study.regions.collect()}
    assert regions == {("g1", "e1"), ("g2", "e2"), ("NEWREGchr1", "0")}
    assert {r.gene_id for r in study.new_region_candidates.collect()} == {"NEWREG000000001"}
    results = study.results.collect()
    assert {r.exon_id for r in results} == {"e1", "e2"}
    assert all(r.p2 == pytest.approx(0.1) and r.fc > 1 for r in results)
    tag = "10_whole_0.1"
    lines = text_of(tmp_path / f"report_{tag}")
    assert lines[0] == report.header(report.REGION_LAYOUT) and len(lines) == 1 + len(results)
    assert lines[1].startswith("0.1".ljust(15) + "0.1".ljust(15)) and len(lines[1]) == sum(w for _, w in report.REGION_LAYOUT)
    exon_lines = text_of(tmp_path / f"exon_report_{tag}")
    assert exon_lines[0] == report.header(report.EXON_LAYOUT) and len(exon_lines) == 3
    assert sorted(text_of(tmp_path / f"exons_candidates_{tag}")) == ["chr1,(g1,e1,990,1040)", "chr1,(g2,e2,1030,1100)"]
    assert text_of(tmp_path / f"regions_candidates_{tag}") == ["chr1,(NEWREG000000001,0,3000,3050)"]
    assert spark.read.parquet(str(tmp_path / f"results_{tag}")).count() == len(results)


def test_chromosome_filter_and_novel_candidates_in_phase_two(spark, study_files):
    reads = read_samples(spark, study_files.samples)
    groups = study_groups(spark, reads, study_files.samples)
    exons = spark.createDataFrame(
        [("g1", "e1", "chr1", 990, 1040, ".")],
        "gene_id STRING, exon_id STRING, chrom STRING, start_pos INT, end_pos INT, strand STRING",
    )
    elsewhere = DifferentialExpression(reads, exons, groups, chrom="chr2")
    assert elsewhere.regions.count() == 0 and elsewhere.results.count() == 0
    study = DifferentialExpression(reads, exons, groups, Settings(tile=64), start=2000, end=4000)
    novel = study.new_region_candidates
    tested = study.test_regions(novel).collect()
    assert [(r.gene_id, r.exon_id) for r in tested] == [("NEWREG000000001", "0")]
    assert tested[0].p2 == pytest.approx(0.1)


def test_phase_two_reads_only_near_its_candidates(spark, tmp_path):
    """Comparisons reach the scan, other chromosomes are not read, and no read of a candidate is lost."""
    draw = random.Random(3)
    rows = [(draw.randint(1, 4), f"chr{draw.randint(1, 4)}", s, s + draw.randint(0, 90)) for s in draw.choices(range(1, 2000), k=3000)]
    spark.createDataFrame(rows, "sample_id INT, chrom STRING, start_pos INT, end_pos INT").write.parquet(str(tmp_path / "r"))
    reads, groups = spark.read.parquet(str(tmp_path / "r")), Groups((1, 2), (3, 4))
    candidate = "gene_id STRING, exon_id STRING, chrom STRING, start_pos INT, end_pos INT"
    one = spark.createDataFrame([("g", "e1", "chr2", 300, 350), ("g", "e2", "chr2", 700, 720)], candidate)
    two = one.union(spark.createDataFrame([("h", "e3", "chr4", 1500, 1501), (None, "x", None, 1, 2)], candidate))
    for candidates, names in ((one, {"chr2"}), (two, {"chr2", "chr4"}), (one.where("false"), set())):
        near = reads_near(reads, candidates)
        whole = permutation_tests(reads, candidates, groups).collect()
        assert sorted(permutation_tests(near, candidates, groups).collect()) == sorted(whole)
        assert {r.chrom for r in near.collect()} == names and near.count() < reads.count() / 3
    plan = reads_near(reads, one)._jdf.queryExecution().executedPlan().toString()
    for pushed in ("EqualTo(chrom,chr2)", "GreaterThanOrEqual(end_pos,300)", "LessThanOrEqual(start_pos,720)"):
        assert pushed in plan
    plan = reads_near(reads, two)._jdf.queryExecution().executedPlan().toString()
    assert "In(chrom, [chr2,chr4])" in plan.replace("[chr4,chr2]", "[chr2,chr4]") and "Or(" in plan


def test_bounds_of_very_many_chromosomes(spark, make_reads, monkeypatch):
    monkeypatch.setattr(diffexpr, "MAX_BOUNDS", 3)
    candidates = spark.range(9).selectExpr("concat('chr', id) AS chrom", "int(100 * id + 100) AS start_pos", "int(100 * id + 110) AS end_pos")
    reads = make_reads([(1, "chr1", 50, 99), (1, "chr1", 50, 100), (1, "chr1", 910, 950), (1, "chr1", 911, 950)])
    assert sorted(r.end_pos for r in reads_near(reads, candidates).collect()) == [100, 950]


def test_places_of_the_summary(spark):
    rows = spark.range(3000).selectExpr("concat('g', id % 7) AS gene_id", "string(id) AS exon_id", "(id % 11) / 10D AS p2", "double(id % 5) AS fc")
    got = report.ordered_summary(rows.repartition(6)).collect()
    expected = sorted(rows.collect(), key=lambda r: (r.p2, -r.fc, r.gene_id, r.exon_id))
    assert [(r.place, r.exon_id) for r in sorted(got, key=lambda r: r.place)] == [(i + 1, r.exon_id) for i, r in enumerate(expected)]


def test_base_coverage_of_a_study_starts_no_job(spark, make_reads):
    reads = make_reads([(1, "chr1", 1, 5), (2, "chr1", 3, 9)])
    samples = spark.createDataFrame([(1, 2.0), (2, 1.0)], "sample_id INT, norm_factor DOUBLE")
    factors = samples.groupBy("sample_id").agg({"norm_factor": "max"}).toDF("sample_id", "norm_factor")
    spark.sparkContext.setJobGroup("lazy", "lazy")
    try:
        covered = CoverageStudy(reads, factors, (1, 2)).base_coverage()
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {(r.sample_id, r.pos, r["cov"]) for r in covered.collect()} == {(1, p, 2) for p in range(1, 6)} | {(2, p, 1) for p in range(3, 10)}


def test_too_many_factors_are_an_error(spark, make_reads, monkeypatch):
    monkeypatch.setattr(coverage, "MAX_SAMPLES", 2)
    factors = spark.range(4).selectExpr("int(id) AS sample_id", "1D AS norm_factor")
    with pytest.raises(Exception, match="more than 2 normalisation factors"):
        coverage.base_coverage(make_reads([(1, "chr1", 1, 5)]), factors=factors).collect()


def test_open_factors_come_from_library_sizes(spark, study_files):
    sheet = [Sample(s.sample_id, s.group, s.path, None) for s in study_files.samples]
    groups = study_groups(spark, read_samples(spark, sheet), sheet)
    assert groups.factors[1] == 1.0 and groups.factors[4] == 1.0
    assert groups.factors[2] == pytest.approx(23 / 24)


def test_exon_count_comparison_and_depth_job(spark, study_files):
    rows = {r.exon_id: (r.x, r.y) for r in compare_exon_counts(spark, study_files).collect()}
    assert rows["e3"] == ([4, 4, 4], [4, 4, 4]) and rows["e1"][0] == [12, 13, 14]
    assert count_deep_bases(spark, study_files.samples[0].path).first().n_bases >= 57


def test_reports_are_ranked_and_limited(spark, tmp_path):
    rows = [("chr1", i, 10 + i % 3, 0.02, (-1.0) ** i * (i % 5 + 1), f"g{i}", f"e{i}", 0.5, 3.0, 120.0, (i % 4) / 10) for i in range(40)]
    columns = (
        "chrom STRING, start_pos INT, length INT, p DOUBLE, fc DOUBLE, gene_id STRING, exon_id STRING, "
        "overlap_pct DOUBLE, avg_a DOUBLE, avg_b DOUBLE, p2 DOUBLE"
    )
    confirmed = spark.createDataFrame(rows, columns)
    got = [(r.p2, -abs(r.fc), -r.length) for r in report.top_regions(confirmed, 15).collect()]
    assert got == sorted((r[10], -abs(r[4]), -r[2]) for r in rows)[:15]
    report.write_region_report(confirmed, str(tmp_path / "r"), 15)
    lines = text_of(tmp_path / "r")
    assert len(lines) == 16 and len(glob.glob(f"{tmp_path}/r/part-*")) == 1 and lines[1].rstrip().endswith("****")
    report.write_region_report(confirmed, str(tmp_path / "all"))
    assert spark.read.text(str(tmp_path / "all")).count() == confirmed.count() + 1
    assert not (tmp_path / "none").exists()
