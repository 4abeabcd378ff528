"""Permutation test with a statistic of the caller that works on arrays of many regions and splits at once.

The count columns travel to Python in Arrow batches; splits are made in the task, a block at a time, so neither their
list nor the expanded rows exist anywhere, and the number of samples has no limit but the time for all splits.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from basecov.operators.permutation import TOLERANCE
from basecov.operators.vectors import Groups

#: ``statistic(x, y)`` for ``x[region, split, n]`` and ``y[region, split, m]`` returns ``value[region, split]``.
BatchStatistic = Callable[[np.ndarray, np.ndarray], np.ndarray]

SPLITS_AT_ONCE = 1024
#: Counts (regions x splits x samples) that a task hands to the statistic at once.
BLOCK_CELLS = 1 << 19


def mann_whitney_u(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``U`` of the first sample: pairs with ``x > y``, ties counting one half."""
    above = (x[..., :, None] > y[..., None, :]).sum(axis=(-1, -2))
    return above + 0.5 * (x[..., :, None] == y[..., None, :]).sum(axis=(-1, -2))


def _drawn(size: int, n: int, count: int, seed: int) -> Iterator[tuple[int, ...]]:
    """The observed choice and ``count - 1`` other ones, drawn by the seed."""
    draw, seen = random.Random(seed), {tuple(range(n))}
    yield tuple(range(n))
    while len(seen) < count:
        chosen = tuple(sorted(draw.sample(range(size), n)))
        if chosen not in seen:
            seen.add(chosen)
            yield chosen


def split_blocks(n: int, m: int, max_splits: int | None, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of the first and of the second group, ``[split, n]`` and ``[split, m]``, a block of splits at a time."""
    size = n + m
    drawn = max_splits is not None and max_splits < math.comb(size, n)
    splits = _drawn(size, n, max_splits, seed) if drawn else itertools.combinations(range(size), n)
    while block := list(itertools.islice(splits, SPLITS_AT_ONCE)):
        first = np.array(block, dtype=np.int64).reshape(len(block), n)
        rest = np.ones((len(block), size), bool)
        np.put_along_axis(rest, first, False, axis=1)
        yield first, np.nonzero(rest)[1].reshape(len(block), m)


def permutation_test_batched(
    df: DataFrame,
    keys: Sequence[str],
    groups: Groups,
    statistic: BatchStatistic,
    max_splits: int | None = None,
    seed: int = 0,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``(keys, carry, p2)``: the share of splits whose statistic reaches the observed one, per row of ``df``.

    ``df`` holds one row per key with the count columns of ``groups``; nothing is shuffled. All splits count unless
    ``max_splits`` asks for a seeded draw, which contains the observed split. As in SQL, a statistic that is no number
    is above all others. A missing count is zero.
    """
    n, m = len(groups.case), len(groups.control)
    kept, columns = [*keys, *carry], groups.columns
    total = math.comb(n + m, n) if max_splits is None else min(max_splits, math.comb(n + m, n))
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("p2", T.DoubleType())])

    def test(batches: Iterator) -> Iterator:
        import pyarrow as pa

        regions_at_once = max(1, BLOCK_CELLS // (min(total, SPLITS_AT_ONCE) * (n + m)))
        for batch in batches:
            counts = np.column_stack([batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in columns])
            reached = np.zeros(batch.num_rows, np.int64)
            for at in range(0, batch.num_rows, regions_at_once):
                rows = counts[at : at + regions_at_once]
                observed = np.asarray(statistic(rows[:, None, :n], rows[:, None, n:]), dtype=float) - TOLERANCE
                for first, rest in split_blocks(n, m, max_splits, seed):
                    value = np.asarray(statistic(rows[:, first], rows[:, rest]), dtype=float)
                    reached[at : at + regions_at_once] += ((value >= observed) | np.isnan(value)).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(reached / float(total))], names=[*kept, "p2"]
            )

    return df.select(*kept, *[c for c in columns if c not in kept]).mapInArrow(test, schema)
