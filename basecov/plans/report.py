"""Ranking and writing of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basecov.functions.scalars import coverage_stars, pad_right, round_half_up
from basecov.session import stored

# Fixed titles and widths of the two text reports.
REGION_LAYOUT = (
    ("Ph-II p-val", 15),
    ("Ph-I p-val", 15),
    ("foldChange", 25),
    ("length", 10),
    ("Coordinates", 20),
    ("geneId", 25),
    ("exonId", 25),
    ("exonOverlapPct", 15),
    ("avgCovA", 10),
    ("avgCovB", 10),
    ("covSignifficant", 20),
)
EXON_LAYOUT = (
    ("Ph-II p-val", 15),
    ("foldChange", 25),
    ("geneId", 25),
    ("exonId", 25),
    ("exonOverlapPct", 15),
    ("avgCovA", 10),
    ("avgCovB", 10),
    ("covSignifficant", 20),
)


def _region_order() -> list[Column]:
    return [
        F.asc("p2"),
        F.abs("fc").desc(),
        F.desc("length"),
        F.asc("gene_id"),
        F.asc("exon_id"),
        F.asc("chrom"),
        F.asc("start_pos"),
    ]


def top_regions(confirmed: DataFrame, n: int) -> DataFrame:
    """The ``n`` best regions by phase-2 p-value, size of the fold change and length."""
    return confirmed.orderBy(*_region_order()).limit(n)


def _summary_order() -> list[Column]:
    return [F.asc("p2"), F.desc("fc"), F.asc("gene_id"), F.asc("exon_id")]


def ordered_summary(summary: DataFrame) -> DataFrame:
    """The summary with its ``place`` (1, 2, ...) by p-value, fold change and names, without one task for all rows.

    The rows are sorted in parallel and stored with their place inside the part they were written in; the sizes of the
    parts before, one number each, are added.
    """
    part, inside = "spark_partition_id() AS part", "monotonically_increasing_id() & ((1L << 33) - 1) AS inside"
    written = stored(summary.orderBy(*_summary_order()).selectExpr("*", part, inside), "summary")
    sizes = written.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = "coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS before"
    placed = written.join(sizes.selectExpr("part", before), "part")
    return placed.selectExpr(*summary.columns, "before + inside + 1 AS place")


def _shown(value: str, digits: int) -> str:
    return f"string({round_half_up(value, digits)})"


def _line(values: list[str], layout) -> str:
    return f"concat({', '.join(pad_right(value, width) for value, (_, width) in zip(values, layout))}) AS line"


def header(layout) -> str:
    return "".join(title.ljust(width) for title, width in layout)


def region_lines(confirmed: DataFrame, n: int | None = None) -> DataFrame:
    """All regions, or the ``n`` best, with their report text ``line``."""
    values = [
        _shown("p2", 5),
        _shown("p", 5),
        _shown("fc", 5),
        "string(length)",
        "concat('(', chrom, ',', start_pos, ')')",
        "gene_id",
        "exon_id",
        "string(overlap_pct)",
        _shown("avg_a", 2),
        _shown("avg_b", 2),
        coverage_stars("avg_a", "avg_b"),
    ]
    chosen = confirmed if n is None else top_regions(confirmed, n)
    return chosen.selectExpr("*", _line(values, REGION_LAYOUT))


def exon_lines(summary: DataFrame) -> DataFrame:
    """The summary with its report text ``line``, not yet ordered."""
    values = [
        _shown("p2", 5),
        _shown("fc", 5),
        "gene_id",
        "exon_id",
        _shown("overlap_pct", 5),
        _shown("avg_a", 2),
        _shown("avg_b", 2),
        f"string(length({coverage_stars('avg_a', 'avg_b')}))",
    ]
    return summary.selectExpr("*", _line(values, EXON_LAYOUT))


def write_region_report(confirmed: DataFrame, path: str, n: int | None = None) -> None:
    """Write the ranked region report, all regions or the ``n`` best; its parts stay in global order."""
    lines = _with_header(region_lines(confirmed, n), REGION_LAYOUT)
    lines.orderBy("is_line", *_region_order()).select("line").write.mode("overwrite").text(path)


def write_exon_report(summary: DataFrame, path: str) -> None:
    """Write the exon report; its parts stay in global order, so no task needs all of it."""
    lines = _with_header(exon_lines(summary), EXON_LAYOUT)
    lines.orderBy("is_line", *_summary_order()).select("line").write.mode("overwrite").text(path)


def _with_header(lines: DataFrame, layout) -> DataFrame:
    titles = lines.sparkSession.range(1).selectExpr("0 AS is_line", f"'{header(layout)}' AS line")
    return lines.selectExpr("*", "1 AS is_line").unionByName(titles, allowMissingColumns=True)


def write_regions(regions: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write all rows, in parallel."""
    writer = regions.write.mode("overwrite")
    if fmt == "parquet":
        writer.parquet(path)
    else:
        writer.option("sep", "\t").option("header", True).csv(path)


def write_candidates(candidates: DataFrame, path: str) -> None:
    """Write candidates as ``chrom,(gene,exon,start,end)`` lines."""
    line = "concat(chrom, ',(', gene_id, ',', exon_id, ',', start_pos, ',', end_pos, ')') AS line"
    candidates.selectExpr(line).write.mode("overwrite").text(path)
