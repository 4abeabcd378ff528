"""Vectors of many samples from sparse changes, beside the form with one column per sample and a plain count."""

import random

import pytest

from basecov.operators import sparse_vectors, vectors
from basecov.operators.vectors import Groups

COLUMNS = ["chrom", "tile", "start_pos", "end_pos", "x", "y", "avg_a", "avg_b", "fc"]


def plain(rows):
    return sorted(tuple(str(v) for v in row) for row in rows.select(*COLUMNS).collect())


@pytest.fixture(scope="module")
def some_reads(make_reads):
    draw = random.Random(4)
    rows = [(draw.randint(1, 5), f"chr{draw.randint(1, 2)}", s, s + draw.randint(0, 60)) for s in draw.choices(range(1, 500), k=400)]
    return make_reads([*rows, *rows[:20], (2, None, 5, 9), (3, "chr1", None, 9), (None, "chr1", 3, 9)])


@pytest.mark.parametrize("cells", [1, 7, 1 << 20])
@pytest.mark.parametrize("factors", [None, {1: 0.5, 4: 1.75}])
def test_equals_the_form_with_columns(spark, some_reads, cells, factors):
    groups = Groups(case=(3, 1), control=(4, 2, 9), factors=factors)
    options = dict(tile=64, min_coverage=1.5)
    dense = vectors.with_vectors(vectors.group_segments(some_reads, groups, **options), groups)
    got = plain(sparse_vectors.sparse_segments(some_reads, groups, cells=cells, **options))
    assert got == plain(dense) and len(got) > 100
    assert plain(sparse_vectors.vector_segments(some_reads, groups, **options)) == got


def test_range_and_empty_table(spark, some_reads):
    groups, options = Groups(case=(1,), control=(2,)), dict(chrom="chr1", start=101, end=200, tile=64)
    dense = vectors.with_vectors(vectors.group_segments(some_reads, groups, **options), groups)
    assert plain(sparse_vectors.sparse_segments(some_reads, groups, **options)) == plain(dense)
    assert sparse_vectors.sparse_segments(some_reads.where("false"), groups).count() == 0


def test_a_sample_in_both_groups(spark, make_reads):
    groups = Groups(case=(1, 2), control=(2,))
    (row,) = sparse_vectors.sparse_segments(make_reads([(2, "chr1", 1, 4)]), groups, min_coverage=0.5).collect()
    assert (row.start_pos, row.end_pos, row.x, row.y) == (1, 4, [0, 1], [1])


def test_500_samples(spark, make_reads):
    """One aggregation and two shuffles, whatever the number of samples; depths as counted base by base."""
    draw = random.Random(9)
    rows = [(s, "chr1", at, at + draw.randint(0, 30)) for s in range(500) for at in draw.sample(range(1, 300), 4)]
    groups = Groups(case=tuple(range(250)), control=tuple(range(250, 500)))
    found = sparse_vectors.vector_segments(make_reads(rows), groups, min_coverage=0.0, tile=128)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Exchange hashpartitioning") == 2 and plan.count("sum(change") <= 3
    depth = {}
    for sample, _, start, end in rows:
        for pos in range(start, end + 1):
            depth.setdefault(pos, [0] * 500)[sample] += 1
    seen = {pos: [*r.x, *r.y] for r in found.collect() for pos in range(r.start_pos, r.end_pos + 1)}
    assert seen == depth
