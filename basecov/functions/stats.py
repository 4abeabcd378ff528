"""Two-sample statistics and combined probabilities as SQL expressions.

With ``n`` and ``m`` values per group and ``N = n + m``, the difference of the two empirical distribution
functions at a pooled value ``z`` is ``D(z) / (n m)`` with the integer ``D(z) = m #{x <= z} - n #{y <= z}``.
The Cramer-von Mises statistic is then ``sum(D^2) / (n m N^2)`` and Kolmogorov-Smirnov is ``max|D| / (n m)``.
Working on the integers ``sum(D^2)`` ("score") keeps comparisons exact, ties included.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column

# A statistic takes the names of two array columns; it may also return a Column, e.g. of a pandas UDF.
Statistic = Callable[[str, str], "str | Column"]


def _gap(x: str, y: str) -> str:
    below = "size(filter({0}, v -> v <= z))"
    return f"({below.format(x)} * size({y}) - {below.format(y)} * size({x}))"


def cvm_statistic(x: str, y: str) -> str:
    """Two-sample Cramer-von Mises statistic of two INT arrays."""
    scale = f"nullif(double(size({x}) * size({y})) * pow(size({x}) + size({y}), 2), 0D)"
    return f"(aggregate(concat({x}, {y}), 0D, (acc, z) -> acc + pow({_gap(x, y)}, 2)) / {scale})"


def ks_statistic(x: str, y: str) -> str:
    """Two-sample Kolmogorov-Smirnov statistic of two INT arrays."""
    widest = f"array_max(transform(concat({x}, {y}), z -> abs({_gap(x, y)})))"
    return f"({widest} / nullif(double(size({x}) * size({y})), 0D))"


def mann_whitney_statistic(x: str, y: str) -> str:
    """``U`` of the first sample: pairs with ``x > y``, ties counting one half."""
    wins = f"size(filter({y}, v -> v < z)) + 0.5D * size(filter({y}, v -> v = z))"
    return f"aggregate({x}, 0D, (acc, z) -> acc + {wins})"


def combine_max(statistics: Sequence[str]) -> str:
    return statistics[0] if len(statistics) == 1 else f"greatest({', '.join(statistics)})"


def vector_mean(x: str) -> str:
    """Mean of an array; 0.0 when it is empty."""
    return f"coalesce(aggregate({x}, 0D, (acc, v) -> acc + v) / nullif(size({x}), 0), 0D)"


def vector_stddev(x: str, mean: str) -> str:
    """Population standard deviation around a given mean; 0.0 when the array is empty."""
    return f"coalesce(sqrt(aggregate({x}, 0D, (acc, v) -> acc + pow(v - {mean}, 2)) / nullif(size({x}), 0)), 0D)"


def fisher_statistic(p_values: str) -> str:
    """Fisher's combined statistic ``-2 sum(ln p)`` of an array of p-values."""
    return f"aggregate({p_values}, 0D, (acc, p) -> acc + if(p <= 0, double('infinity'), -2 * ln(p)))"


def fisher_dof(p_values: str) -> str:
    return f"(size({p_values}) * 2)"


def fisher_p(statistic: str, dof: str, folded: bool = False) -> str:
    """Chi-square upper tail for an even number of degrees of freedom.

    With ``k = dof / 2`` the tail is ``sum over i < k of exp(-h) h^i / i!``, ``h = statistic / 2``; the terms are
    built from their logarithms so that large statistics do not underflow early. ``folded`` returns the smaller
    of both tails.
    """
    half = f"({statistic} / 2)"
    terms = (
        f"aggregate(sequence(0, int({dof} div 2) - 1), named_struct('log_term', -{half}, 'total', 0D), "
        f"(acc, i) -> named_struct('log_term', acc.log_term + ln({half}) - ln(i + 1D), "
        f"'total', acc.total + exp(acc.log_term)), acc -> least(acc.total, 1D))"
    )
    tail = f"(CASE WHEN {half} <= 0 THEN 1D WHEN {half} = double('infinity') THEN 0D ELSE {terms} END)"
    return f"least({tail}, 1D - {tail})" if folded else tail


# --- scores over separate count columns: plain arithmetic, so they stay inside generated code ---------------


def _sum(terms: Sequence[str]) -> str:
    return f"({' + '.join(terms)})"


def cvm_score(x: Sequence[str], y: Sequence[str]) -> str:
    """Integer ``sum(D^2)`` of two groups given as count columns.

    Each ``D`` is written twice instead of being squared by a function: Spark then evaluates it once, as a common
    subexpression with a method of its own, and the generated code stays small enough to be compiled.
    """
    n, m = len(x), len(y)

    def gap(z: str) -> str:
        return _sum([f"if({v} <= {z}, {m}, 0)" for v in x] + [f"if({v} <= {z}, {-n}, 0)" for v in y])

    return split_cvm_score([gap(z) for z in [*x, *y]])


def cvm_scale(n: int, m: int) -> int:
    """Divisor that turns a score into the Cramer-von Mises statistic."""
    return n * m * (n + m) ** 2


def cvm_score_bound(n: int, m: int) -> int:
    """No score can be larger: ``|D| <= n m`` at each of the ``n + m`` pooled values."""
    return (n + m) * (n * m) ** 2


def rank_mask(values: Sequence[str], z: str) -> str:
    """Bit set of the entries of ``values`` that are not above ``z`` (at most 62 entries)."""
    return _sum([f"if({v} <= {z}, {1 << i}L, 0L)" for i, v in enumerate(values)])


def split_gaps(masks: Sequence[str], split: str, n: int, m: int) -> list[str]:
    """``D`` at each pooled value when the entries set in ``split`` form the first group."""
    return [f"({n + m} * bit_count({split} & {mask}) - {n} * bit_count({mask}))" for mask in masks]


def split_cvm_score(gaps: Sequence[str]) -> str:
    return _sum([f"bigint({gap}) * {gap}" for gap in gaps])


def split_ks_score(gaps: Sequence[str], n: int, m: int) -> str:
    """``max|D|`` on the scale of :func:`split_cvm_score`, so that both can be compared as integers."""
    return f"bigint({combine_max([f'abs({gap})' for gap in gaps])} * {(n + m) ** 2})"
