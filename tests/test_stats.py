import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from basecov.functions import scalars, stats
from basecov.operators import batched_permutation, lattice, nulldist, permutation
from basecov.operators.vectors import Groups


def gap(x, y, z):
    return sum(a <= z for a in x) / len(x) - sum(b <= z for b in y) / len(y)


def cvm(x, y):
    n, m = len(x), len(y)
    return sum(gap(x, y, z) ** 2 for z in [*x, *y]) * n * m / (n + m) ** 2


def ks(x, y):
    return max(abs(gap(x, y, z)) for z in [*x, *y])


def mann_whitney(x, y):
    return sum((a > b) + 0.5 * (a == b) for a in x for b in y)


# Exact null distribution of the two-sample statistic for three and three, four and four values.
EXACT = {
    (3, 3): [(0.0833333333, 0.4), (0.1944444444, 0.8), (0.3055555556, 0.9), (0.5277777778, 1.0)],
    (4, 4): [
        (0.0625, 0.228571428571),
        (0.125, 0.571428571429),
        (0.1875, 0.742857142857),
        (0.25, 0.771428571429),
        (0.3125, 0.885714285714),
        (0.375, 0.942857142857),
        (0.5, 0.971428571429),
        (0.6875, 1.0),
    ],
}


@pytest.fixture(scope="module")
def pairs():
    draw = random.Random(11)
    return [
        ([draw.randint(0, 6) for _ in range(draw.randint(1, 6))], [draw.randint(0, 6) for _ in range(draw.randint(1, 6))])
        for _ in range(60)
    ] + [([2, 2, 2], [2, 2]), ([0, 0], [5, 5])]


def test_statistics_against_definition(spark, pairs):
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], "i INT, x ARRAY<INT>, y ARRAY<INT>")
    rows = df.selectExpr(
        "i",
        f"{stats.cvm_statistic('x', 'y')} AS t",
        f"{stats.ks_statistic('x', 'y')} AS d",
        f"{stats.mann_whitney_statistic('x', 'y')} AS u",
    ).collect()
    for r in rows:
        x, y = pairs[r.i]
        assert r.t == pytest.approx(cvm(x, y)) and r.d == pytest.approx(ks(x, y)) and r.u == mann_whitney(x, y)


def test_score_of_columns_matches_statistic(spark):
    draw = random.Random(2)
    rows = [tuple(draw.randint(0, 4) for _ in range(7)) for _ in range(80)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} INT" for i in range(7)))
    x, y = ["c0", "c1", "c2"], ["c3", "c4", "c5", "c6"]
    for r in df.selectExpr("*", f"{stats.cvm_score(x, y)} AS score").collect():
        assert r.score / stats.cvm_scale(3, 4) == pytest.approx(cvm(list(r)[:3], list(r)[3:7]))
        assert r.score <= stats.cvm_score_bound(3, 4)


@pytest.mark.parametrize("sizes", EXACT)
def test_null_distribution_is_exact(spark, sizes):
    rows = nulldist.cvm_null(spark, *sizes).orderBy("score").collect()
    assert [(round(r.t, 10), round(r.cdf, 12)) for r in rows] == EXACT[sizes]
    assert rows[0].tail == 1.0 and sum(r.ways for r in rows) == math.comb(sum(sizes), sizes[0])


@pytest.mark.parametrize("sizes", [(2, 3), (5, 4)])
def test_lattice_counts_like_enumeration(spark, sizes):
    listed = nulldist._enumerated(spark, *sizes).collect()
    walked = nulldist._lattice(spark, *sizes).collect()
    assert sorted(map(tuple, listed)) == sorted(map(tuple, walked))


def test_null_against_brute_force_for_unequal_groups(spark):
    ranks = range(6)
    brute = {}
    for chosen in itertools.combinations(ranks, 2):
        t = round(cvm(list(chosen), [r for r in ranks if r not in chosen]), 9)
        brute[t] = brute.get(t, 0) + 1
    assert {round(r.t, 9): r.ways for r in nulldist.cvm_null(spark, 2, 4).collect()} == brute


@pytest.mark.parametrize("bins", [10, 97, 65_536])
def test_p_value_steps_cover_every_score(spark, bins):
    null = nulldist.cvm_null(spark, 4, 4)
    steps, width = nulldist.p_value_steps(null, 4, 4, bins)
    table = [(r.score, r.tail) for r in null.orderBy("score").collect()]
    rows = steps.collect()
    for score in range(0, stats.cvm_score_bound(4, 4) + 1, 8):
        hits = [r.p for r in rows if r.p_bin == score // width and r.p_lo <= score <= r.p_hi]
        above = [tail for s, tail in table if s >= score]
        assert hits == [above[0] if above else table[-1][1]]


def test_p_values_from_a_file_table(spark):
    groups = Groups((1, 2, 3, 4), (5, 6, 7, 8))
    table = spark.createDataFrame([(round(t * 1024), c) for t, c in EXACT[(4, 4)]], "score BIGINT, cdf DOUBLE")
    draw = random.Random(9)
    df = spark.createDataFrame(
        [tuple(draw.randint(0, 9) for _ in range(8)) for _ in range(200)], ", ".join(f"c{i} INT" for i in range(8))
    )
    own = nulldist.with_cvm_p_value(df, groups)
    given = nulldist.with_cvm_p_value(df, groups, nulldist.tails_of_table(table))
    left = sorted((r.t, round(r.p, 9)) for r in own.collect())
    right = sorted((r.t, round(max(r.p, 0), 9)) for r in given.collect())
    assert len(left) == 200 and left == right and all(0 < p <= 1 for _, p in left)


def test_fisher(spark):
    ps = [0.01, 0.2, 0.5]
    row = spark.createDataFrame([(ps, [1.0], [1e-300] * 5)], "p ARRAY<DOUBLE>, one ARRAY<DOUBLE>, tiny ARRAY<DOUBLE>").selectExpr(
        f"{stats.fisher_statistic('p')} AS stat",
        f"{stats.fisher_dof('p')} AS dof",
        f"{stats.fisher_p(stats.fisher_statistic('p'), stats.fisher_dof('p'))} AS tail",
        f"{stats.fisher_p(stats.fisher_statistic('p'), stats.fisher_dof('p'), True)} AS folded",
        f"{stats.fisher_p(stats.fisher_statistic('one'), stats.fisher_dof('one'))} AS certain",
        f"{stats.fisher_p(stats.fisher_statistic('tiny'), stats.fisher_dof('tiny'))} AS small",
    ).first()
    h = -sum(math.log(p) for p in ps)
    tail = math.exp(-h) * sum(h**i / math.factorial(i) for i in range(3))
    assert row.stat == pytest.approx(2 * h) and row.dof == 6
    assert row.tail == pytest.approx(tail) and row.folded == pytest.approx(min(tail, 1 - tail))
    assert row.certain == 1.0 and 0 <= row.small < 1e-200


def test_scalars(spark):
    row = spark.createDataFrame([([1, 2, 2, 5], [], -2.5)], "x ARRAY<INT>, e ARRAY<INT>, v DOUBLE").selectExpr(
        f"{stats.vector_mean('x')} AS mean",
        f"{stats.vector_mean('e')} AS mean_empty",
        f"{stats.vector_stddev('x', '2.5D')} AS sd",
        f"{stats.vector_stddev('e', '0D')} AS sd_empty",
        f"{scalars.pad_zeros('x', 6)} AS padded",
        f"{scalars.pad_zeros('x', 2)} AS longer",
        f"{scalars.ratio('3', '0')} AS up",
        f"{scalars.ratio('0', '0')} AS undefined",
        f"{scalars.signed_fold_change('0.25D')} AS quarter",
        f"{scalars.signed_fold_change('0D')} AS none",
        f"{scalars.round_half_up('v', 0)} AS half",
        f"{scalars.pad_right(chr(39) + 'abcdef' + chr(39), 3)} AS whole",
        f"{scalars.coverage_stars('1', '1.9')} AS s1",
        f"{scalars.coverage_stars('2', '0')} AS s2",
        f"{scalars.coverage_stars('10', '0')} AS s3",
        f"{scalars.coverage_stars('0', '100')} AS s4",
        f"{scalars.overlap_length('1', '10', '5', '20')} AS overlap",
    ).first()
    assert (row.mean, row.mean_empty, row.sd, row.sd_empty) == (2.5, 0.0, 1.5, 0.0)
    assert row.padded == [1, 2, 2, 5, 0, 0] and row.longer == [1, 2, 2, 5]
    assert row.up == math.inf and math.isnan(row.undefined) and row.quarter == -4.0 and row.none == -math.inf
    assert row.half == -2.0 and row.whole == "abcdef" and row.overlap == 5
    assert [row.s1, row.s2, row.s3, row.s4] == ["*", "**", "***", "****"]
    assert scalars.split_count(15, 9, 1000) == 1000 and scalars.chrom_label("*") == "whole"


# --- permutation test ----------------------------------------------------------------------------------------

GROUPS = Groups((1, 2, 3), (4, 5))


@pytest.fixture(scope="module")
def counts(spark):
    draw = random.Random(4)
    rows = [(f"e{i}", *[draw.randint(0, 5) for _ in range(5)]) for i in range(30)] + [("tied", 3, 3, 3, 3, 3)]
    return spark.createDataFrame(rows, "id STRING, c0 INT, c1 INT, c2 INT, c3 INT, c4 INT")


def share(values, statistic):
    observed = statistic(values[:3], values[3:])
    splits = [set(s) for s in itertools.combinations(range(5), 3)]
    reached = [
        statistic([values[i] for i in s], [v for i, v in enumerate(values) if i not in s]) >= observed - 1e-9
        for s in splits
    ]
    return sum(reached) / len(splits)


def test_permutation_test_is_exact(counts):
    data = {r.id: list(r)[1:] for r in counts.collect()}
    tested = permutation.permutation_test(counts, ["id"], GROUPS, carry=["c0"])
    assert tested.columns == ["id", "c0", "p2"]
    for r in tested.collect():
        assert r.p2 == pytest.approx(share(data[r.id], lambda x, y: max(cvm(x, y), ks(x, y))))
        assert 0 < r.p2 <= 1
    plugin = permutation.permutation_test(counts, ["id"], GROUPS, [stats.mann_whitney_statistic])
    for r in plugin.collect():
        assert r.p2 == pytest.approx(share(data[r.id], mann_whitney))


def test_bit_form_and_array_form_agree(counts):
    def wrapped(x, y):
        return F.greatest(F.expr(stats.cvm_statistic(x, y)), F.expr(stats.ks_statistic(x, y)))

    fast = {r.id: r.p2 for r in permutation.permutation_test(counts, ["id"], GROUPS).collect()}
    general = {r.id: r.p2 for r in permutation.permutation_test(counts, ["id"], GROUPS, [wrapped]).collect()}
    assert fast == general


@pytest.mark.parametrize("cells", [1, 64, 1 << 19])
def test_batched_statistic_equals_enumeration(counts, monkeypatch, cells):
    monkeypatch.setattr(batched_permutation, "BLOCK_CELLS", cells)
    monkeypatch.setattr(batched_permutation, "SPLITS_AT_ONCE", 3)
    data = {r.id: list(r)[1:] for r in counts.collect()}
    tested = batched_permutation.permutation_test_batched(counts, ["id"], GROUPS, batched_permutation.mann_whitney_u, carry=["c0"])
    assert tested.columns == ["id", "c0", "p2"]
    assert "Exchange" not in tested._jdf.queryExecution().executedPlan().toString()
    rows = tested.collect()
    assert len(rows) == len(data)
    for r in rows:
        assert r.c0 == data[r.id][0] and r.p2 == pytest.approx(share(data[r.id], mann_whitney))


def test_batched_draws_contain_the_observed_split_and_missing_counts_are_zero(spark, counts):
    groups, u = Groups(tuple(range(40)), tuple(range(40, 80))), batched_permutation.mann_whitney_u
    many = spark.range(1).selectExpr("id", *[f"{100 + i if i < 40 else 'CAST(NULL AS INT)'} AS c{i}" for i in range(80)])
    one, two = (batched_permutation.permutation_test_batched(many, ["id"], groups, u, 50, seed=5).first().p2 for _ in range(2))
    assert one == two == pytest.approx(1 / 50)
    blocks = list(batched_permutation.split_blocks(9, 6, 500, 3))
    firsts = [tuple(r) for first, _ in blocks for r in first.tolist()]
    assert len(set(firsts)) == 500 and tuple(range(9)) in firsts
    assert all(sorted([*a, *b]) == list(range(15)) for first, rest in blocks for a, b in zip(first.tolist(), rest.tolist()))
    assert batched_permutation.permutation_test_batched(counts.where("false"), ["id"], GROUPS, u).count() == 0


def test_batched_statistic_that_is_no_number(counts):
    nothing = batched_permutation.permutation_test_batched(counts, ["id"], GROUPS, lambda x, y: x.sum(-1) * float("nan"))
    assert {r.p2 for r in nothing.collect()} == {1.0}


def test_permutation_test_is_symmetric(counts):
    swapped = counts.selectExpr("id", "c3 AS c0", "c4 AS c1", "c0 AS c2", "c1 AS c3", "c2 AS c4")
    one = {r.id: r.p2 for r in permutation.permutation_test(counts, ["id"], GROUPS).collect()}
    two = {r.id: r.p2 for r in permutation.permutation_test(swapped, ["id"], Groups((4, 5), (1, 2, 3))).collect()}
    assert one == two


def test_drawn_splits_are_repeatable_and_contain_the_observed_one():
    masks = permutation.split_masks(9, 6, 500, seed=3)
    assert masks == permutation.split_masks(9, 6, 500, seed=3) and len(set(masks)) == 500
    assert (1 << 9) - 1 in masks and all(m.bit_count() == 9 for m in masks)
    assert len(permutation.split_masks(4, 4, 10_000)) == 70


def test_all_splits_unless_draws_are_asked_for():
    assert len(permutation.split_masks(8, 8)) == 12_870


def test_fisher_of_a_zero_p_value(spark):
    row = spark.range(1).selectExpr(f"{stats.fisher_statistic('array(0D, 0.5D)')} AS s").selectExpr("s", f"{stats.fisher_p('s', '4')} AS p").first()
    assert row.s == float("inf") and row.p == 0


# --- permutation test along lattice paths ---------------------------------------------------------------------


def listed_share(row, n):
    """Over all splits as bit masks: the largest of both scores on the integer scale."""
    size = len(row)
    masks = np.arange(1 << size, dtype=np.int64)
    masks = masks[np.bitwise_count(masks) == n]
    best, total = np.zeros(len(masks), np.int64), np.zeros(len(masks), np.int64)
    for z in row:
        below = sum(1 << i for i, v in enumerate(row) if v <= z)
        gap = size * np.bitwise_count(masks & below).astype(np.int64) - n * below.bit_count()
        total += gap * gap
        best = np.maximum(best, np.abs(gap) * size * size)
    score = np.maximum(best, total)
    return (score >= score[masks == (1 << n) - 1]).mean()


@pytest.mark.parametrize("seed", range(4))
def test_lattice_equals_listing_at_12_against_12(spark, seed):
    rng = np.random.default_rng(seed)
    row = [int(v) for v in rng.integers(0, [3, 8, 40, 1000][seed], 24)]
    row[:12] = [v + [0, 2, 10, 300][seed] for v in row[:12]]
    groups = Groups(tuple(range(12)), tuple(range(12, 24)))
    df = spark.createDataFrame([(1, *row)], "id INT, " + ", ".join(f"{c} INT" for c in groups.columns))
    tested = permutation.permutation_test(df, ["id"], groups)
    assert "Generate" not in tested._jdf.queryExecution().executedPlan().toString()
    assert tested.first().p2 == listed_share(row, 12)


@pytest.mark.parametrize("statistics", [[stats.cvm_statistic], [stats.ks_statistic], list(permutation.BUILT_IN)])
def test_lattice_equals_masks_at_unequal_sizes(spark, statistics):
    rng = np.random.default_rng(9)
    groups = Groups((1, 2, 3, 4, 5), (6, 7, 8))
    rows = [(i, *map(int, rng.integers(0, rng.integers(1, 9), 8))) for i in range(60)] + [(99, *[4] * 8)]
    df = spark.createDataFrame(rows, "id INT, " + ", ".join(f"{c} INT" for c in groups.columns))
    one = {r.id: r.p2 for r in permutation.permutation_test(df, ["id"], groups, statistics).collect()}
    two = {r.id: r.p2 for r in permutation.permutation_test(df, ["id"], groups, statistics, listed_splits=0).collect()}
    assert one == two and one[99] == 1


def test_lattice_beyond_64_bits():
    """40 against 40 in two groups of ties is a hypergeometric tail; 80 samples are no limit."""
    observed = lattice.observed_score(np.array([28, 12]), np.array([40, 40]), 40, True, True)
    exact = Fraction(sum(math.comb(40, k) ** 2 for k in range(41) if abs(k - 20) >= 8), math.comb(80, 40))
    assert lattice.share_at_least([40, 40], observed, 40) == pytest.approx(float(exact), rel=1e-12)
    assert lattice.share_at_least([1] * 80, 0, 40) == 1
    assert 0 < lattice.share_at_least([1] * 80, lattice.observed_score(np.repeat([1, 0], 40), np.ones(80, np.int64), 40, True, True), 40) == pytest.approx(2 / math.comb(80, 40))


def test_null_table_beyond_64_bits(spark):
    n = m = 40
    paths = {(0, 0): 1}  # (entries of the first sample, score): number of paths, exact
    for step in range(1, n + m + 1):
        grown = {}
        for (x, score), ways in paths.items():
            for to in (x, x + 1):
                if to <= n and step - to <= m:
                    at = (to, score + ((n + m) * to - n * step) ** 2)
                    grown[at] = grown.get(at, 0) + ways
        paths = grown
    rows = nulldist.cvm_null(spark, n, m).orderBy("score").collect()
    assert [r.score for r in rows] == sorted(s for _, s in paths)
    left = total = math.comb(n + m, n)
    for r in rows:
        assert r.ways is None and r.tail == pytest.approx(float(Fraction(left, total)), rel=1e-12)
        left -= paths[n, r.score]
    assert left == 0
