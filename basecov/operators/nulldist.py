"""Exact null distribution of the two-sample Cramer-von Mises statistic, and p-values from it."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basecov import session
from basecov.functions.stats import cvm_scale, cvm_score, cvm_score_bound, split_cvm_score, split_gaps
from basecov.operators.lattice import cvm_chances
from basecov.operators.vectors import Groups
from basecov.session import broadcast_or_merge

ENUMERATED_SIZE = 22
MASKS_PER_TASK = 1 << 16
P_VALUE_BINS = 65_536
STEP_ROW_BYTES = 64


def _enumerated(spark: SparkSession, n: int, m: int) -> DataFrame:
    """``(score, ways)`` by listing every choice of ``n`` of the ``n + m`` ranks as a bit mask."""
    size = n + m
    ranks = [f"{(1 << (j + 1)) - 1}L" for j in range(size)]
    splits = spark.range(0, 1 << size, 1, max(1, (1 << size) // MASKS_PER_TASK)).where(f"bit_count(id) = {n}")
    score = split_cvm_score(split_gaps(ranks, "id", n, m))
    return splits.selectExpr(f"{score} AS score").groupBy("score").agg(F.expr("count(*) AS ways"))


def _lattice(spark: SparkSession, n: int, m: int) -> DataFrame:
    """``(score, ways)`` for larger groups, one rank at a time.

    A split is a lattice path from (0, 0) to (n, m); a path through (i, j) adds ``(m i - n j)^2``. Paths that agree on
    the place and on the score so far are counted together.
    """
    state = spark.range(1).selectExpr("0 AS i", "0L AS score", "1L AS ways")
    for step in range(1, n + m + 1):
        moved = state.selectExpr("explode(array(i, i + 1)) AS i", "score", "ways")
        gap = f"bigint(i * {m} - ({step} - i) * {n})"
        state = (
            moved.where(f"i <= {n} AND {step} - i <= {m}")
            .selectExpr("i", f"score + {gap} * {gap} AS score", "ways")
            .groupBy("i", "score")
            .agg(F.sum("ways").alias("ways"))
        )
    return state.select("score", "ways")


def cvm_null(spark: SparkSession, n: int, m: int) -> DataFrame:
    """Null distribution ``(score, t, ways, cdf, tail)``; ``tail`` is the chance of a statistic of at least ``t``.

    Its size depends on the group sizes only, so the running sum over it uses one partition. Where the number of splits
    does not fit a BIGINT, ``ways`` is missing and the chances are summed as doubles, each from its own end.
    """
    total = math.comb(n + m, n)
    if total >= 1 << 63:
        scores, chances = cvm_chances(n, m)
        cdf, tail = np.cumsum(chances), np.cumsum(chances[::-1])[::-1]
        table = pa.table({"score": scores, "cdf": np.minimum(cdf, 1.0), "tail": np.minimum(tail, 1.0)})
        rows = spark.createDataFrame(table)
        return rows.selectExpr("score", f"score / {cvm_scale(n, m)}D AS t", "CAST(NULL AS BIGINT) AS ways", "cdf", "tail")
    ways = _enumerated(spark, n, m) if n + m <= ENUMERATED_SIZE else _lattice(spark, n, m)
    counted = ways.selectExpr("*", "sum(ways) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS reached")
    return counted.selectExpr(
        "score",
        f"score / {cvm_scale(n, m)}D AS t",
        "ways",
        f"reached / {total}D AS cdf",
        f"({total}L - reached + ways) / {total}D AS tail",
    )


def tails_of_table(table: DataFrame) -> DataFrame:
    """``(score, tail)`` of a table that gives cumulative probabilities ``(score, cdf)``."""
    return table.selectExpr("score", "1D - lag(cdf, 1, 0D) OVER (ORDER BY score) AS tail")


def p_value_steps(null: DataFrame, n: int, m: int, bins: int = P_VALUE_BINS) -> tuple[DataFrame, int]:
    """The tail as a step function over all possible scores, cut into bins for an equi-join; and the bin width.

    Rows ``(p_bin, p_lo, p_hi, p)``: a score in ``p_lo..p_hi`` has p-value ``p``. Scores above the largest tabulated
    one (possible with ties) keep the smallest attainable p-value. There are at most ``bins`` rows more than steps.
    """
    bound = cvm_score_bound(n, m)
    width = max(1, math.ceil(bound / bins))
    steps = null.selectExpr(
        "coalesce(lag(score) OVER (ORDER BY score), -1L) + 1 AS p_lo",
        f"if(lead(score) OVER (ORDER BY score) IS NULL, {bound}L, score) AS p_hi",
        "tail AS p",
    )
    return steps.selectExpr(f"explode(sequence(p_lo div {width}, p_hi div {width})) AS p_bin", "*"), width


def most_steps(n: int, m: int) -> int:
    """Upper bound for the rows of the step table: every score is a multiple of the squared common divisor."""
    attainable = cvm_score_bound(n, m) // math.gcd(n, m) ** 2 + 1
    return min(attainable, math.comb(n + m, n)) + P_VALUE_BINS


def with_cvm_p_value(
    df: DataFrame, groups: Groups, null: DataFrame | None = None, max_p: float | None = None
) -> DataFrame:
    """Add ``score``, ``t`` and ``p`` of the Cramer-von Mises test on the count columns; keep ``p <= max_p``.

    ``null`` may come from :func:`cvm_null` (default) or, through :func:`tails_of_table`, from a file. The step table
    does not grow with the data; it is broadcast unless the group sizes allow more steps than fit.
    """
    n, m = len(groups.case), len(groups.control)
    null = cvm_null(df.sparkSession, n, m) if null is None else null
    steps, width = p_value_steps(null, n, m)
    if max_p is not None:
        steps = steps.where(f"p <= {max_p}")
    steps = broadcast_or_merge(steps, most_steps(n, m) * STEP_ROW_BYTES <= session.BROADCAST_LIMIT_BYTES)
    scored = df.selectExpr("*", f"{cvm_score(groups.case_columns, groups.control_columns)} AS score")
    joined = scored.join(steps, F.expr(f"score div {width} = p_bin AND score BETWEEN p_lo AND p_hi"))
    return joined.selectExpr(*df.columns, "score", f"score / {cvm_scale(n, m)}D AS t", "p")
