"""Exact tail shares of the permutation test without listing splits: a dynamic programme over groups of ties.

A split of ``n + m`` pooled counts is a lattice path: behind each group of equal counts it stands at ``x``, the entries
of the group and before that it gave to the first sample. Both statistics only look at these points: with ``N = n + m``
and ``C`` entries up to there, ``D = N x - n C``, the Cramer-von Mises score adds ``D^2`` for every entry of the group and
the Kolmogorov-Smirnov score is the largest ``|D|``. Paths that agree on ``x`` and on the score so far are counted
together, and a path that has reached the observed score is counted with all its continuations at once, so work depends
on the scores below the observed one, not on the number of splits.

Counts of paths are exact while their total fits 64 bits; beyond, the paths carry their probabilities as doubles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _merged(x: np.ndarray, score: np.ndarray, ways: np.ndarray, above: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paths at the same point with the same score, counted together; all scores are below ``above``."""
    key = x * above + score
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.diff(key, prepend=-1))
    if not len(heads):
        return x, score, ways
    return key[heads] // above, key[heads] % above, np.add.reduceat(ways[order], heads)


def share_at_least(ties: Sequence[int], observed: int, n: int, cvm: bool = True, ks: bool = True) -> float:
    """Share of the ways to give ``n`` of all entries to the first sample whose score is at least ``observed``.

    ``ties`` are the numbers of equal counts, in ascending order of the counts; ``observed`` is on the common integer
    scale of both scores (see :mod:`basecov.functions.stats`).
    """
    size = sum(ties)
    m, total = size - n, math.comb(size, n)
    exact = total < 1 << 63
    above = max(observed, 1)
    x, score, ways = np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64 if exact else np.float64)
    reached, below = 0, 0
    for group in ties:
        left_before, below = size - below, below + group
        left = size - below
        to = x[:, None] + np.arange(group + 1)
        valid = (to <= n) & (below - to <= m)
        gap = size * to - n * below
        scores = score[:, None] + group * gap * gap if cvm else np.zeros_like(gap)
        hit = np.zeros_like(valid)
        if cvm:
            hit |= scores >= observed
        if ks:
            hit |= np.abs(gap) * size * size >= observed
        if exact:
            moved = ways[:, None] * np.array([math.comb(group, k) for k in range(group + 1)], np.int64)
            rest = np.array([math.comb(left, n - k) for k in range(n + 1)], np.int64)
            done = valid & hit
            reached += int((moved[done] * rest[to[done]]).sum())
        else:
            points = np.unique(x)
            chance = np.array([[math.comb(group, k) * math.comb(left, max(n - at - k, 0)) / math.comb(left_before, n - at) for k in range(group + 1)] for at in points.tolist()])
            moved = ways[:, None] * chance[np.searchsorted(points, x)]
            reached += float(moved[valid & hit].sum())
        going = valid & ~hit
        x, score, ways = _merged(to[going], scores[going], moved[going], above)
        if not len(x):
            break
    return reached / total if exact else min(1.0, reached)


def observed_score(own: np.ndarray, ties: np.ndarray, n: int, cvm: bool, ks: bool) -> int:
    """The score of a split that gives ``own`` entries of each group of ties to the first sample."""
    gap = int(ties.sum()) * np.cumsum(own) - n * np.cumsum(ties)
    parts = [int((ties * gap * gap).sum())] * cvm + [int(np.abs(gap).max()) * int(ties.sum()) ** 2] * ks
    return max(parts)


def with_shares(df: DataFrame, kept: Sequence[str], columns: Sequence[str], n: int, cvm: bool, ks: bool) -> DataFrame:
    """``kept`` and ``p2`` of every row; rows with the same ties and the same score share one computation in their task."""
    source = df.select(*kept, *columns)
    out = T.StructType([source.schema[c] for c in kept] + [T.StructField("p2", T.DoubleType())])
    first, names = len(kept), [*kept, "p2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, float] = {}
        for batch in batches:
            counts = np.stack([batch.column(first + i).to_numpy() for i in range(len(columns))], axis=1)
            shares = np.empty(len(counts))
            for i, row in enumerate(counts):
                levels, ties = np.unique(row, return_counts=True)
                own = np.bincount(np.searchsorted(levels, row[:n]), minlength=len(levels))
                key = (ties.tobytes(), observed_score(own, ties, n, cvm, ks))
                if key not in known:
                    known[key] = share_at_least(ties.tolist(), key[1], n, cvm, ks)
                shares[i] = known[key]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(first)], pa.array(shares)], names=names)

    return source.mapInArrow(run, out)


def cvm_chances(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """All scores of the Cramer-von Mises statistic without ties, ascending, and the probability of each as a double.

    A path takes its next entry from the first sample with the share that is left there, so probabilities stay
    normalised at every step and no number of splits is too large.
    """
    size, above = n + m, size_bound(n, m) + 1
    x, score, chance = np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1)
    for taken in range(size):
        first = (n - x) / (size - taken)
        x, chance = np.concatenate([x + 1, x]), np.concatenate([chance * first, chance * (1 - first)])
        gap = size * x - n * (taken + 1)
        score = np.concatenate([score, score]) + gap * gap
        possible = (x <= n) & (taken + 1 - x <= m)
        x, score, chance = _merged(x[possible], score[possible], chance[possible], above)
    return score, chance


def size_bound(n: int, m: int) -> int:
    """No score is larger: ``|D| <= n m`` at each of the ``n + m`` entries."""
    return (n + m) * (n * m) ** 2
