import math
import random

import pytest

from basecov.operators import intervals, runs
from basecov.plans import diffexpr

INF = math.inf


def bases_frame(spark, bases, tile):
    """Bases as stretches of one base each."""
    rows = [(c, pos // tile, pos, pos, p, fc, a, b) for c, pos, p, fc, a, b in bases]
    return spark.createDataFrame(
        rows, "chrom STRING, tile INT, start_pos INT, end_pos INT, p DOUBLE, fc DOUBLE, avg_a DOUBLE, avg_b DOUBLE"
    )


def brute_runs(bases, equal_p):
    found, current = [], []
    for base in sorted(bases):
        joins = current and current[-1][0] == base[0] and current[-1][1] + 1 == base[1]
        if joins and equal_p and current[-1][2] != base[2]:
            joins = False
        if not joins and current:
            found.append(current)
            current = []
        current.append(base)
    found.append(current)
    return sorted(
        (r[0][0], r[0][1], len(r), max(b[2] for b in r), *[round(sum(b[k] for b in r) / len(r), 9) for k in (3, 4, 5)])
        for r in found
    )


@pytest.fixture(scope="module")
def bases():
    draw = random.Random(8)
    spots = sorted(draw.sample(range(1, 400), 260))
    rows = [("chr1", s, draw.choice([0.01, 0.02]), draw.choice([0.5, 2.0]), 3.0, float(draw.randint(1, 4))) for s in spots]
    rows += [("chr2", s, 0.05, 2.0, 4.0, 2.0) for s in range(1, 300)]  # one run over many tiles
    rows += [("chr3", 50, 0.01, INF, 4.0, 0.0), ("chr3", 64, 0.02, 1.5, 3.0, 2.0)]  # single bases
    return rows


@pytest.mark.parametrize("tile", [1, 8, 16, 8192])
@pytest.mark.parametrize("equal_p", [False, True])
def test_runs(spark, bases, tile, equal_p):
    got = runs.contiguous_runs(bases_frame(spark, bases, tile), equal_p, tile).collect()
    rows = sorted((r.chrom, r.start_pos, r.length, r.p, round(r.fc, 9), round(r.avg_a, 9), round(r.avg_b, 9)) for r in got)
    assert rows == brute_runs(bases, equal_p)
    assert sum(r.length for r in got) == len(bases)


def region_frame(spark, rows):
    return spark.createDataFrame(
        rows, "chrom STRING, start_pos INT, length INT, p DOUBLE, fc DOUBLE, avg_a DOUBLE, avg_b DOUBLE"
    )


def test_regions_are_mapped_to_the_best_exon_of_each_gene(spark, make_exons):
    exons = make_exons(
        [
            ("gA", "a1", "chr1", 100, 200),
            ("gA", "a2", "chr1", 150, 170),
            ("gB", "b1", "chr1", 90, 130),
            ("gC", "c1", "chr1", 500, 520),
            ("gC", "c2", "chr1", 500, 520),
            ("gD", "d1", "chr1", 9_000, 50_000),
        ]
    )
    regions = region_frame(
        spark,
        [
            ("chr1", 110, 50, 0.01, 2.0, 3.0, 1.0),  # two exons of gA with equal share: the later one; one of gB
            ("chr1", 498, 30, 0.01, 2.0, 3.0, 1.0),  # two exons of one gene with equal share: later id
            ("chr1", 200, 5, 0.01, 2.0, 3.0, 1.0),  # touches gA without overlap above one
            ("chr1", 20_000, 40_000, 0.01, 2.0, 3.0, 1.0),  # many bins
            ("chr1", 700, 3, 0.01, 2.0, 3.0, 1.0),
            ("chr9", 100, 3, 0.01, 2.0, 3.0, 1.0),
        ],
    )
    expected = {
        (110, "gA", "a2", 0.5),
        (110, "gB", "b1", 0.5),
        (498, "gC", "c2", 1.0),
        (200, "PositionNotFound", "0", 0.0),
        (20_000, "gD", "d1", round(30_000 / 41_000, 4)),
        (700, "PositionNotFound", "0", 0.0),
        (100, "ChrNotFound", "0", 0.0),
    }
    for width in (10, 1_000, 10_000):
        got = intervals.map_regions_to_exons(regions, exons, width).collect()
        assert {(r.start_pos, r.gene_id, r.exon_id, r.overlap_pct) for r in got} == expected and len(got) == 7


def test_point_lookup(spark, make_exons):
    exons = make_exons([("g1", "e2", "chr1", 10, 40), ("g1", "e1", "chr1", 10, 20), ("g2", "e3", "chr1", 5, 12)])
    points = spark.createDataFrame([("chr1", 11), ("chr1", 11), ("chr1", 15), ("chr1", 40), ("chr1", 41), ("chr7", 11)], "chrom STRING, pos INT")
    for width in (4, 10_000):
        got = sorted(tuple(r) for r in intervals.lookup_exon_at(points, exons, width).collect())
        assert got == sorted(
            [
                ("chr1", 11, "g2", "e3", 5, 12),
                ("chr1", 11, "g2", "e3", 5, 12),
                ("chr1", 15, "g1", "e1", 10, 20),
                ("chr1", 40, "g1", "e2", 10, 40),
                ("chr1", 41, "", "", 0, 0),
                ("chr7", 11, "ExonNotFound", "0", 0, 0),
            ]
        )


@pytest.mark.parametrize("width", [3, 50, 10_000])
def test_point_lookup_equals_plain_search(spark, make_exons, width):
    draw = random.Random(width)
    exons = [(f"g{draw.randint(1, 3)}", f"e{i % 90}", f"chr{draw.randint(1, 2)}", s, s + draw.choice([-1, 0, 3, 20, 200])) for i, s in enumerate(draw.choices(range(1, 600), k=120))]
    exons += exons[:5]
    asked = [(f"chr{draw.randint(1, 3)}", draw.randint(1, 900)) for _ in range(400)] + [(None, 5), ("chr1", None)]
    points = spark.createDataFrame(asked, "chrom STRING, pos INT")

    def first(chrom, pos):
        held = [(s, e, g, t) for g, e, c, s, t in exons if c == chrom and pos is not None and s <= pos <= t]
        start, exon, gene, end = min(held, default=(0, "", "", 0))
        return (chrom, pos, gene, exon, start, end) if chrom in ("chr1", "chr2") else (chrom, pos, "ExonNotFound", "0", 0, 0)

    got = [tuple(r) for r in intervals.lookup_exon_at(points, make_exons(exons), width).collect()]
    assert sorted(got, key=str) == sorted((first(*p) for p in asked), key=str)


def test_point_lookup_in_one_dense_bin(spark, make_exons):
    """A hundred thousand exons and a million points in one bin, a third of the points at one position; no arrays."""
    exons = spark.range(100_000).selectExpr("'g' AS gene_id", "concat('e', id) AS exon_id", "'chr1' AS chrom", "int(1 + id % 9000) AS start_pos", "int(1 + id % 9000 + id div 9000) AS end_pos")
    points = spark.range(1_000_000).selectExpr("'chr1' AS chrom", "int(if(id % 3 = 0, 77, 1 + id % 9500)) AS pos")
    found = intervals.lookup_exon_at(points, exons)
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("exon_id <> ''").groupBy().count().first()[0] == points.where("pos <= 9010").count()
    (hit,) = found.where("pos = 77").select("exon_start", "exon_end").distinct().collect()
    assert hit.exon_start == min(s for s in range(1, 78) if any(s + k >= 77 for k in range(12) if s - 1 + 9000 * k < 100_000))


def brute_merge(rows, any_p, gaps):
    groups = {}
    for row in rows:
        chrom, start, length, p, fc, gene, exon, pct, a, b = row
        gene = "NEWREG" + chrom if exon == "0" else gene
        groups.setdefault((gene, exon, chrom), []).append(row)
    out = []
    for (gene, exon, chrom), members in groups.items():
        chain = []
        for row in [*sorted(members, key=lambda r: r[1]), None]:
            joins = (
                chain
                and row
                and row[1] - (chain[-1][1] + chain[-1][2]) in gaps
                and math.copysign(1, row[4]) == math.copysign(1, chain[-1][4])
                and (any_p or row[3] == chain[-1][3])
            )
            if chain and not joins:
                n = sum(r[2] for r in chain)
                mean = lambda k: sum(r[k] * r[2] for r in chain) / n
                pct = math.floor(sum(r[7] for r in chain) * 1e4 + 0.5) / 1e4
                out.append((chrom, chain[0][1], n, max(r[3] for r in chain), mean(4), gene, exon, pct, mean(8), mean(9)))
                chain = []
            if row:
                chain.append(row)
    return out


def close(got, expected):
    got, expected = sorted(got), sorted(expected)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        for u, v in zip(a, b):
            assert u == v or u == pytest.approx(v), (a, b)


@pytest.mark.parametrize("tile", [4, 32, 8192])
@pytest.mark.parametrize("any_p", [True, False])
@pytest.mark.parametrize("adjacent", [False, True])
def test_merge_regions(spark, tile, any_p, adjacent):
    draw = random.Random(1)
    rows = []
    for gene, exon, chrom in [("g1", "e1", "chr1"), ("PositionNotFound", "0", "chr1"), ("ChrNotFound", "0", "chr2")]:
        at = 1
        for _ in range(80):
            length = draw.choice([1, 2, 3, 40])
            fc = draw.choice([2.0, 2.0, 3.0, -2.0, INF, -INF])
            rows.append((chrom, at, length, draw.choice([0.01, 0.02]), fc, gene, exon, 0.1234, 3.0, float(draw.randint(0, 3))))
            at += length + draw.choice([0, 1, 1, 1, 2, 9])
    schema = (
        "chrom STRING, start_pos INT, length INT, p DOUBLE, fc DOUBLE, gene_id STRING, exon_id STRING, "
        "overlap_pct DOUBLE, avg_a DOUBLE, avg_b DOUBLE"
    )
    merged = runs.merge_regions(spark.createDataFrame(rows, schema), 1, any_p, adjacent, tile)
    assert tuple(merged.columns) == diffexpr.REGION_COLUMNS
    close([tuple(r) for r in merged.collect()], brute_merge(rows, any_p, (0, 1) if adjacent else (1,)))
    longer = runs.merge_regions(spark.createDataFrame(rows, schema), 5, any_p, adjacent, tile)
    assert longer.count() == sum(1 for r in brute_merge(rows, any_p, (0, 1) if adjacent else (1,)) if r[2] >= 5)


@pytest.mark.parametrize("tile", [3, 8192])
def test_running_number(spark, tile):
    draw = random.Random(6)
    places = [(f"chr{draw.randint(1, 12)}", s, s + 5) for s in draw.sample(range(1, 1000), 200)]
    df = spark.createDataFrame(places, "chrom STRING, start_pos INT, end_pos INT")
    got = runs.running_number(df, ["end_pos"], tile).orderBy("number").collect()
    assert [r.number for r in got] == list(range(1, 201))
    assert [(r.chrom, r.start_pos) for r in got] == sorted((c, s) for c, s, _ in places)
