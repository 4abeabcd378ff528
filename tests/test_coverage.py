import random
from collections import Counter

import pytest

from basecov import session
from basecov.operators import coverage, intervals
from basecov.operators.vectors import Groups, exon_count_join, group_segments, region_vectors
from basecov.sources.alignments import Sample, sample_table


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    spread = [(draw.randint(1, 4), f"chr{draw.randint(1, 2)}", s, s + draw.randint(0, 40)) for s in draw.choices(range(1, 400), k=300)]
    pile_up = [(1, "chr1", 77, 90)] * 200
    return spread + pile_up


@pytest.fixture(scope="module")
def exon_rows():
    draw = random.Random(5)
    return [
        (f"g{i % 9}", f"e{i}", f"chr{draw.randint(1, 2)}", s, s + draw.randint(1, 150))
        for i, s in enumerate(draw.choices(range(1, 380), k=40))
    ]


def brute_coverage(rows):
    return Counter((s, c, p) for s, c, a, b in rows for p in range(a, b + 1))


@pytest.mark.parametrize("tile", [1, 7, 64, 8192])
def test_base_coverage_does_not_depend_on_tiles(make_reads, rows, tile):
    got = {(r.sample_id, r.chrom, r.pos): r.cov for r in coverage.base_coverage(make_reads(rows), tile=tile).collect()}
    assert got == brute_coverage(rows)
    assert sum(got.values()) == sum(b - a + 1 for _, _, a, b in rows)


def test_range_is_cut_before_expansion(make_reads, rows):
    got = coverage.base_coverage(make_reads(rows), chrom="chr1", start=50, end=80, tile=16).collect()
    expected = {k: v for k, v in brute_coverage(rows).items() if k[1] == "chr1" and 50 <= k[2] <= 80}
    assert {(r.sample_id, r.chrom, r.pos): r.cov for r in got} == expected


def test_depth_filter(make_reads, rows):
    deep = sum(1 for v in brute_coverage(rows).values() if v >= 10)
    assert coverage.bases_at_depth(make_reads(rows), 10, tile=32).first().n_bases == deep


def brute_hits(rows, exon_rows, union):
    counts = Counter()
    for s, c, a, b in rows:
        hits = [(g, e) for g, e, ec, ea, eb in exon_rows if ec == c and a <= eb and b >= ea]
        if not union or len(hits) == 1:
            counts.update((s, g, e) for g, e in hits)
    return counts


@pytest.mark.parametrize("union", [False, True])
@pytest.mark.parametrize("width", [3, 50, 10_000])
@pytest.mark.parametrize("small", [True, False])
def test_region_coverage(make_reads, make_exons, rows, exon_rows, union, width, small, monkeypatch):
    if not small:
        monkeypatch.setattr(session, "BROADCAST_LIMIT_BYTES", 100)
    got = coverage.region_coverage(make_reads(rows), make_exons(exon_rows), union, width=width).collect()
    assert {(r.sample_id, r.gene_id, r.exon_id): r.cov for r in got} == brute_hits(rows, exon_rows, union)


@pytest.mark.parametrize("union", [False, True])
@pytest.mark.parametrize("small", [True, False])
def test_partitions_grow_with_the_reads(spark, make_reads, make_exons, rows, exon_rows, union, small, monkeypatch, tmp_path):
    make_reads(rows).write.parquet(str(tmp_path / "reads"))
    reads = spark.read.parquet(str(tmp_path / "reads"))
    session_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.partitions_by_size(reads) is None and session.partitions_by_size(make_reads(rows)) is None
    monkeypatch.setattr(session, "PARTITION_BYTES", session.estimated_bytes(reads) * session.UNPACKED_FACTOR // (session_parts + 3))
    if not small:
        monkeypatch.setattr(session, "BROADCAST_LIMIT_BYTES", 100)
    assert session.partitions_by_size(reads) in (session_parts + 3, session_parts + 4)
    counts = coverage.region_coverage(reads, make_exons(exon_rows), union, width=50)
    assert f", {session.partitions_by_size(reads)}), REPARTITION_BY_NUM" in counts._jdf.queryExecution().toString()
    assert {(r.sample_id, r.gene_id, r.exon_id): r.cov for r in counts.collect()} == brute_hits(rows, exon_rows, union)


def test_factors_keep_integers(spark, make_reads):
    reads = make_reads([(1, "chr1", 1, 10)] * 4 + [(2, "chr1", 5, 6)] * 8 + [(3, "chr1", 1, 2)] * 3)
    sheet = [Sample(1, "case", "a"), Sample(2, "case", "b"), Sample(3, "control", "c"), Sample(4, "control", "d")]
    factors = coverage.library_factors(reads, sample_table(spark, sheet))
    assert {r.sample_id: (r.n_reads, r.norm_factor) for r in factors.collect()} == {
        1: (4, 1.0), 2: (8, 0.5), 3: (3, 1.0), 4: (0, 1.0)
    }
    scaled = coverage.base_coverage(reads, factors=factors).where("sample_id = 2").collect()
    assert {(r.pos, r.cov) for r in scaled} == {(5, 4), (6, 4)}


def test_group_segments_are_the_outer_join_of_both_groups(make_reads, rows, two_by_two):
    brute = brute_coverage(rows)
    places = {k[1:] for k in brute}
    expected = {}
    for place in places:
        v = [brute.get((s, *place), 0) for s in two_by_two.ids]
        if (v[0] + v[1]) / 2 >= 1 or (v[2] + v[3]) / 2 >= 1:
            expected[place] = tuple(v)
    for tile in (5, 4096):
        segments = group_segments(make_reads(rows), two_by_two, tile=tile)
        got = {(r.chrom, r.pos): (r.c0, r.c1, r.c2, r.c3) for r in coverage.expand_positions(segments).collect()}
        assert got == expected
    scaled = Groups((1, 2), (3, 4), {1: 0.5})
    halves = coverage.expand_positions(group_segments(make_reads(rows), scaled, min_coverage=0.0)).collect()
    assert {(r.chrom, r.pos) for r in halves} == places
    assert all(r.c0 == int(brute.get((1, r.chrom, r.pos), 0) / 2 + 0.5) for r in halves)


def test_exon_vectors_and_join(make_reads, make_exons, rows, exon_rows, two_by_two):
    counts = brute_hits(rows, exon_rows, False)
    vectors = region_vectors(make_reads(rows), make_exons(exon_rows), two_by_two, width=64).collect()
    for r in vectors:
        assert (r.c0, r.c1, r.c2, r.c3) == tuple(counts[(s, r.gene_id, r.exon_id)] for s in (1, 2, 3, 4))
    joined = exon_count_join(make_reads(rows), make_exons(exon_rows), two_by_two, width=64).collect()
    both = {
        (g, e)
        for _, g, e in counts
        if any(counts[(s, g, e)] for s in (1, 2)) and any(counts[(s, g, e)] for s in (3, 4))
    }
    assert {(r.gene_id, r.exon_id) for r in joined} == both


def test_coverage_table_levels(make_reads, make_exons, rows, exon_rows):
    counts = coverage.region_coverage(make_reads(rows), make_exons(exon_rows), width=64)
    exon = coverage.coverage_table(counts, [4, 1, 2, 3, 9], "exon")
    assert exon.columns == ["gene_id", "exon_id", "s1", "s2", "s3", "s4", "s9"]
    gene = coverage.coverage_table(counts, [1, 2, 3, 4], "gene")
    brute = brute_hits(rows, exon_rows, False)
    per_gene = Counter()
    for (s, g, _), n in brute.items():
        per_gene[(g, s)] += n
    assert all(r[f"s{s}"] == per_gene[(r.gene_id, s)] for r in gene.collect() for s in (1, 2, 3, 4))
    base = coverage.coverage_table(coverage.base_coverage(make_reads(rows)), [1, 2], "base")
    assert base.columns == ["chrom", "pos", "s1", "s2"]


def test_size_check_allows_two_bins_for_each_interval(make_exons, monkeypatch):
    exons = make_exons([("g", "e", "chr1", 1, 1_000_000)])
    size = session.estimated_bytes(exons) * session.UNPACKED_FACTOR
    monkeypatch.setattr(session, "BROADCAST_LIMIT_BYTES", 2 * size)
    assert intervals.annotation_is_small(exons)
    monkeypatch.setattr(session, "BROADCAST_LIMIT_BYTES", 2 * size - 1)
    assert session.fits_broadcast(exons) and not intervals.annotation_is_small(exons)


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("width", [1, 7, 64, 10_000])
def test_intervals_of_any_mix_of_lengths(make_reads, make_exons, monkeypatch, width, small):
    """From single bases to the longest interval there is: at most two rows each, and the hits of a plain search."""
    monkeypatch.setattr(coverage, "annotation_is_small", lambda exons: small)
    draw, last = random.Random(width), 2**31 - 1
    lengths = [1, 2, 7, 8, 63, 64, 65, 512, 4_096, 80_000, 5_000_000]
    exon_rows = [("g", f"e{i}", "chr1", s, s + draw.choice(lengths) - 1) for i, s in enumerate(draw.choices(range(1, 9_000), k=60))]
    exon_rows += [("g", "all", "chr1", 1, last), ("g", "end", "chr1", last, last), ("h", "other", "chr2", 5, 5)]
    rows = [(draw.randint(1, 2), draw.choice(["chr1", "chr1", "chr2", "chr3"]), s, s + draw.choice([0, 30, 500])) for s in draw.choices(range(1, 9_500), k=150)]
    rows += [(1, "chr1", last, last)]
    assert intervals.binned_exons(make_exons(exon_rows), width).count() <= 2 * len(exon_rows)
    hits = coverage.region_coverage(make_reads(rows), make_exons(exon_rows), width=width)
    assert {(r.sample_id, r.gene_id, r.exon_id): r.cov for r in hits.collect()} == dict(+brute_hits(rows, exon_rows, False))
    assert coverage.region_coverage(make_reads(rows), make_exons([]), width=width).count() == 0


def test_counts_beyond_32_bits(spark, make_exons, monkeypatch):
    """Three billion reads, as counted rows of the exon join."""
    hits = spark.sql("SELECT 1 AS sample_id, 'g' AS gene_id, id AS exon_id, 1500000000L AS n FROM range(2) UNION ALL SELECT 1, 'g', 1L, 1500000000L")
    monkeypatch.setattr(coverage, "region_hits", lambda *args: hits)
    counts = coverage.region_coverage(None, None)
    assert {r.exon_id: r.cov for r in counts.collect()} == {0: 1_500_000_000, 1: 3_000_000_000}
    scaled = coverage.region_coverage(None, None, factors=spark.createDataFrame([(1, 2.0)], "sample_id INT, norm_factor DOUBLE"))
    assert {r.exon_id: r.cov for r in scaled.collect()} == {0: 3_000_000_000, 1: 6_000_000_000}
    assert coverage.coverage_table(counts, [1, 2], "gene").first().s1 == 4_500_000_000


def test_positions_have_no_upper_limit(make_reads):
    last = 2**31 - 1
    reads = make_reads([(1, "chr1", 299_999_990, 300_000_020), (1, "chr1", 400_000_000, 400_000_050), (1, "chr1", last - 4, last)])
    found = coverage.base_coverage(reads).collect()
    assert len(found) == 31 + 51 + 5 and {r.cov for r in found} == {1} and max(r.pos for r in found) == last
    assert coverage.base_coverage(reads, end=300_000_000).count() == 11


def test_reads_without_aligned_bases_hit_nothing(make_reads, make_exons):
    reads = make_reads([(1, "chr1", 50, 49), (1, "chr1", 50, 50)])
    hits = coverage.region_coverage(reads, make_exons([("G", "1", "chr1", 1, 100)]))
    assert [r.cov for r in hits.collect()] == [1]
