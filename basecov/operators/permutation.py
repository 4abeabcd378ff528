"""Permutation test of a combined two-sample statistic."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basecov.functions.scalars import split_by_mask, split_count
from basecov.functions.stats import (
    Statistic,
    combine_max,
    cvm_statistic,
    ks_statistic,
    rank_mask,
    split_cvm_score,
    split_gaps,
    split_ks_score,
)
from basecov.operators.lattice import with_shares
from basecov.operators.vectors import Groups

TOLERANCE = 1e-9
MAX_MASK_BITS = 62
#: Up to so many splits are tried one by one in generated code; more are counted along lattice paths.
LISTED_SPLITS = 5_000
BUILT_IN = (cvm_statistic, ks_statistic)


def split_masks(n: int, m: int, max_splits: int | None = None, seed: int = 0) -> list[int]:
    """Bit masks of the splits to try: all of them, or on request ``max_splits`` drawn ones that include the observed split."""
    size = n + m
    if max_splits is None or math.comb(size, n) <= max_splits:
        return [sum(1 << i for i in chosen) for chosen in itertools.combinations(range(size), n)]
    draw = random.Random(seed)
    masks = {(1 << n) - 1}
    while len(masks) < max_splits:
        masks.add(sum(1 << i for i in draw.sample(range(size), n)))
    return sorted(masks)


def _mask_array(masks: Sequence[int]) -> str:
    """The masks as one constant array, written as text so that the plan stays small."""
    return f"cast(split('{','.join(map(str, masks))}', ',') AS ARRAY<BIGINT>)"


def permutation_test(
    df: DataFrame,
    keys: Sequence[str],
    groups: Groups,
    statistics: Sequence[Statistic] = BUILT_IN,
    max_splits: int | None = None,
    seed: int = 0,
    carry: Sequence[str] = (),
    listed_splits: int = LISTED_SPLITS,
) -> DataFrame:
    """``(keys, carry, p2)``: the share of splits of the pooled counts whose largest statistic reaches the observed one.

    All splits count, whatever their number; only a caller that names ``max_splits`` gets a seeded draw of that size.

    ``df`` holds one row per key with the count columns of ``groups``; columns of ``carry`` pass through. Up to
    ``listed_splits`` splits (and drawn ones, and all splits for statistics of the caller) each row is expanded to its
    splits and folded back within its task, because rows of one key never leave it before partial aggregation; only
    (key, share) reaches a shuffle, if any. The built-in statistics are compared as exact integers over bit masks; any
    other one works on the split arrays ``x`` and ``y``. With more splits the built-in statistics are counted along
    lattice paths (:mod:`basecov.operators.lattice`), for any number of samples and without listing splits.
    """
    n, m = len(groups.case), len(groups.control)
    if max_splits is None and all(s in BUILT_IN for s in statistics) and math.comb(n + m, n) > listed_splits:
        return with_shares(df, [*keys, *carry], groups.columns, n, cvm_statistic in statistics, ks_statistic in statistics)
    if n + m > MAX_MASK_BITS:
        raise ValueError(f"splits are BIGINT masks and hold at most {MAX_MASK_BITS} samples")
    explode = f"explode({_mask_array(split_masks(n, m, max_splits, seed))}) AS split"
    kept = [*keys, *carry]
    scores = _bit_scores if all(s in BUILT_IN for s in statistics) else _array_scores
    scored = scores(df.select(*kept, *groups.columns), kept, groups, statistics, explode)
    share = f"count_if(score >= observed) / {split_count(n + m, n, math.comb(n + m, n) if max_splits is None else max_splits)}D AS p2"
    return scored.groupBy(*keys).agg(*[F.expr(f"first({c}) AS {c}") for c in carry], F.expr(share))


def _bit_scores(
    df: DataFrame, kept: Sequence[str], groups: Groups, statistics: Sequence[Statistic], explode: str
) -> DataFrame:
    n, m = len(groups.case), len(groups.control)
    masks = {f"below{i}": rank_mask(groups.columns, c) for i, c in enumerate(groups.columns)}

    def score(below: Iterable[str], split: str) -> str:
        gaps = split_gaps(list(below), split, n, m)
        forms = {cvm_statistic: split_cvm_score(gaps), ks_statistic: split_ks_score(gaps, n, m)}
        return combine_max([forms[s] for s in statistics])

    # the masks and the observed score in one projection: shared parts are evaluated once, in small methods
    tried = df.selectExpr(
        "*",
        *[f"{text} AS {name}" for name, text in masks.items()],
        f"{score(masks.values(), f'{(1 << n) - 1}L')} AS observed",
        explode,
    )
    return tried.selectExpr(*kept, "observed", f"{score(masks, 'split')} AS score")


def _array_scores(
    df: DataFrame, kept: Sequence[str], groups: Groups, statistics: Sequence[Statistic], explode: str
) -> DataFrame:
    def largest() -> Column:
        made = [s("x", "y") for s in statistics]
        columns = [c if isinstance(c, Column) else F.expr(c) for c in made]
        return columns[0] if len(columns) == 1 else F.greatest(*columns)

    def vectors(split: str) -> list[str]:
        x, y = split_by_mask("pooled", split)
        return [f"{x} AS x", f"{y} AS y"]

    counts = ", ".join(groups.columns)
    pooled = df.selectExpr(*kept, f"array({counts}) AS pooled")
    first = pooled.selectExpr("*", *vectors(f"{(1 << len(groups.case)) - 1}L")).withColumn("observed", largest())
    tried = first.selectExpr(*kept, "pooled", f"observed - {TOLERANCE}D AS observed", explode)
    return tried.selectExpr("*", *vectors("split")).withColumn("score", largest())
