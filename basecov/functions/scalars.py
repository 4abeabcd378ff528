"""Scalar expressions: fold changes, rounding, padding, interval arithmetic and vector helpers."""

from __future__ import annotations

import math

INFINITY = "double('Infinity')"
NEGATIVE_INFINITY = "double('-Infinity')"
NOT_A_NUMBER = "double('NaN')"


def ratio(numerator: str, denominator: str) -> str:
    """IEEE division under ANSI mode: x/0 is +-Infinity and 0/0 is NaN instead of an error."""
    a, b = f"double({numerator})", f"double({denominator})"
    by_zero = f"CASE WHEN {a} > 0 THEN {INFINITY} WHEN {a} < 0 THEN {NEGATIVE_INFINITY} ELSE {NOT_A_NUMBER} END"
    return f"(CASE WHEN {b} = 0 THEN {by_zero} ELSE {a} / {b} END)"


def signed_fold_change(fold_change: str) -> str:
    """Below one, report the negative inverse, so that halving and doubling have equal magnitude."""
    return (
        f"(CASE WHEN {fold_change} = 0 THEN {NEGATIVE_INFINITY} WHEN {fold_change} < 1 THEN -1D / {fold_change} "
        f"ELSE {fold_change} END)"
    )


def round_half_up(value: str, digits: int) -> str:
    """Round to ``digits`` places with halves going up, also for negative values."""
    return f"(double(floor({value} * 1e{digits}D + 0.5D)) / 1e{digits}D)"


def pad_right(text: str, width: int) -> str:
    """Fill with blanks to ``width``; a longer text is kept whole."""
    return f"rpad({text}, greatest({width}, length({text})), ' ')"


def coverage_stars(avg_a: str, avg_b: str) -> str:
    """One to four stars by mean coverage of the two groups."""
    return (
        f"(CASE WHEN {avg_a} < 2 AND {avg_b} < 2 THEN '*' WHEN {avg_a} >= 100 OR {avg_b} >= 100 THEN '****' "
        f"WHEN {avg_a} >= 10 OR {avg_b} >= 10 THEN '***' ELSE '**' END)"
    )


def intersection(start_a: str, end_a: str, start_b: str, end_b: str) -> tuple[str, str]:
    """``(latest start, earliest end)`` of two intervals; empty when the end comes first."""
    return f"greatest({start_a}, {start_b})", f"least({end_a}, {end_b})"


def overlap_length(start_a: str, end_a: str, start_b: str, end_b: str) -> str:
    lo, hi = intersection(start_a, end_a, start_b, end_b)
    return f"({hi} - {lo})"


def overlap_share(overlap: str, exon_start: str, exon_end: str) -> str:
    """Overlap as a share of the exon's extent."""
    return f"(double({overlap}) / nullif({exon_end} - {exon_start}, 0))"


def scale_count(count: str, factor: str, kind: str = "int") -> str:
    """Apply a normalisation factor to a count; the result stays an integer."""
    return f"{kind}(round({count} * {factor}))"


def pad_zeros(vector: str, size: int) -> str:
    """Right-pad an INT vector with zeros to ``size`` entries."""
    return f"concat({vector}, array_repeat(0, greatest({size} - size({vector}), 0)))"


def pooled(x: str, y: str) -> str:
    return f"concat({x}, {y})"


def split_by_mask(vector: str, mask: str) -> tuple[str, str]:
    """Entries whose bit is set in ``mask``, and the remaining ones (duplicates are kept apart by index)."""
    return (
        f"filter({vector}, (entry, at) -> getbit({mask}, at) = 1)",
        f"filter({vector}, (entry, at) -> getbit({mask}, at) = 0)",
    )


def split_count(n: int, n_x: int, cap: int | None = None) -> int:
    """Number of ways to choose ``n_x`` of ``n`` entries, at most ``cap``."""
    ways = math.comb(n, n_x)
    return ways if cap is None else min(ways, cap)


def chrom_label(chrom: str) -> str:
    """File-name part of a chromosome filter."""
    return chrom.replace("*", "whole")
