"""Runs of neighbouring significant bases, and merging of neighbouring regions.

Both are chains: a row joins the row before it when it starts where that one expects its successor. Chains are built
inside fixed tiles first, each with a window of bounded size. Only a chain at the border of a tile can go on in
another tile; these, at most two per tile, are chained again over the whole group, so no task ever holds more rows
than there are tiles, however many bases a chromosome has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basecov.functions.scalars import round_half_up
from basecov.operators.coverage import TILE
from basecov.operators.intervals import UNKNOWN_EXON, bin_of

BORDER_SLOT = -1


def contiguous_runs(tested: DataFrame, equal_p: bool = False, tile: int = TILE) -> DataFrame:
    """Runs of neighbouring tested bases: ``(chrom, start_pos, length, p, fc, avg_a, avg_b)``.

    ``tested`` holds stretches ``(chrom, tile, start_pos, end_pos, p, fc, avg_a, avg_b)`` that do not overlap. The
    p-value is the largest of the run, fold change and coverages are means over its bases. With ``equal_p`` a run
    ends where p changes.

    Inside a run, the position behind a stretch minus the number of bases so far is constant, and it grows with every
    gap: it serves as the number of the run.
    """
    keys = ["chrom", "p"] if equal_p else ["chrom"]
    measures = ["length", "fc", "avg_a", "avg_b"]

    def numbered(rows: DataFrame, part: str) -> DataFrame:
        so_far = f"sum(length) OVER (PARTITION BY {', '.join(keys)}, {part} ORDER BY start_pos ROWS UNBOUNDED PRECEDING)"
        return rows.selectExpr(*keys, part, "start_pos", "next_pos", *measures, *p_column, f"next_pos - {so_far} AS run")

    def folded(rows: DataFrame, part: str) -> DataFrame:
        return rows.groupBy(*keys, part, "run").agg(
            F.expr("min(start_pos) AS start_pos"),
            F.expr("max(next_pos) AS next_pos"),
            *[F.expr(f"sum({c}) AS {c}") for c in measures],
            *[F.expr(f"max({c}) AS {c}") for c in p_column],
        )

    p_column = [] if equal_p else ["p"]
    size = "(end_pos - start_pos + 1)"
    rows = tested.selectExpr(
        "chrom",
        "tile",
        "start_pos",
        "end_pos + 1 AS next_pos",
        "p",
        f"bigint({size}) AS length",
        *[f"{c} * {size} AS {c}" for c in ("fc", "avg_a", "avg_b")],
    )
    local = folded(numbered(rows, "tile"), "tile")
    at_border = f"start_pos = tile * {tile} OR next_pos = (tile + 1) * {tile}"
    slotted = local.selectExpr("*", f"if({at_border}, {BORDER_SLOT}, tile) AS slot")
    runs = folded(numbered(slotted, "slot"), "slot")
    return runs.selectExpr(
        "chrom", "start_pos", "int(length) AS length", "p", *[f"{c} / length AS {c}" for c in measures[1:]]
    )


def merge_regions(
    regions: DataFrame,
    min_length: int = 1,
    any_p: bool = True,
    adjacent: bool = False,
    tile: int = TILE,
) -> DataFrame:
    """Merge neighbouring regions of one exon, or of one chromosome where the exon is unknown.

    Neighbours merge when exactly one base lies between them and their fold changes point the same way; without
    ``any_p`` their p-values must be equal too. ``adjacent`` also merges regions with no base between them. Result:
    largest p, summed length and overlap, length-weighted fold change and coverages, and ``length >= min_length``.
    Regions may bring their ``tile``.
    """
    gene = f"if(exon_id = '{UNKNOWN_EXON}', concat('NEWREG', chrom), gene_id) AS gene_id"
    rows = regions.selectExpr(
        gene,
        "exon_id",
        "chrom",
        "tile" if "tile" in regions.columns else f"{bin_of('start_pos', tile)} AS tile",
        "start_pos",
        "start_pos + length AS stop_pos",
        "bigint(length) AS length",
        "p",
        "signum(fc) AS sign",
        "overlap_pct",
        *[f"{c} * length AS {c}" for c in ("fc", "avg_a", "avg_b")],
    )
    gap = "IN (0, 1)" if adjacent else "= 1"
    merged = _merge_chains(rows, gap, ["sign"] if any_p else ["sign", "p"]).where(f"length >= {min_length}")
    return merged.selectExpr(
        "chrom",
        "start_pos",
        "int(length) AS length",
        "p",
        "fc / length AS fc",
        "gene_id",
        "exon_id",
        f"{round_half_up('overlap_pct', 4)} AS overlap_pct",
        "avg_a / length AS avg_a",
        "avg_b / length AS avg_b",
    )


def _merge_chains(rows: DataFrame, gap: str, same: Sequence[str]) -> DataFrame:
    """Fold rows of one exon whose distance to the row before satisfies ``gap`` and that agree in ``same``."""
    keys = ["gene_id", "exon_id", "chrom"]
    sums = ["length", "overlap_pct", "fc", "avg_a", "avg_b"]
    columns = [*keys, "start_pos", "stop_pos", "sign", "p", *sums]

    def numbered(df: DataFrame, part: str) -> DataFrame:
        over = f"OVER (PARTITION BY {', '.join(keys)}, {part} ORDER BY start_pos"
        agree = "".join(f" AND {c} = lag({c}) {over})" for c in same)
        marked = df.selectExpr(
            *columns,
            part,
            f"if(start_pos - lag(stop_pos) {over}) {gap}{agree}, 0, 1) AS brk",
            f"lead(start_pos) {over}) IS NULL AS last_row",
        )
        return marked.selectExpr("*", f"sum(brk) {over} ROWS UNBOUNDED PRECEDING) AS run")

    def folded(df: DataFrame, part: str) -> DataFrame:
        return df.groupBy(*keys, part, "run").agg(
            F.expr("min(start_pos) AS start_pos"),
            F.expr("max(stop_pos) AS stop_pos"),
            F.expr("max(sign) AS sign"),
            F.expr("max(p) AS p"),
            *[F.expr(f"sum({c}) AS {c}") for c in sums],
            F.expr("max(last_row) AS last_run"),
        )

    local = folded(numbered(rows, "tile"), "tile")
    slotted = local.selectExpr(*columns, f"if(run = 1 OR last_run, {BORDER_SLOT}, tile) AS slot")
    return folded(numbered(slotted, "slot"), "slot").select(*columns)


def running_number(df: DataFrame, order: Sequence[str], tile: int = TILE) -> DataFrame:
    """Add ``number`` = 1, 2, ... in the order ``(chrom, start_pos, *order)`` without sorting everything in one task.

    Rows are numbered inside tiles; the counts of the earlier tiles of the chromosome and of the earlier chromosomes
    are added from two small tables.
    """
    tiled = df.selectExpr("*", f"{bin_of('start_pos', tile)} AS tile")
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    per_tile = tiled.groupBy("chrom", "tile").agg(F.expr("count(*) AS n"))
    per_chrom = per_tile.groupBy("chrom").agg(F.sum("n").alias("n"))
    tile_offsets = per_tile.selectExpr(
        "chrom", "tile", f"coalesce(sum(n) OVER (PARTITION BY chrom ORDER BY tile {before}), 0L) AS tile_offset"
    )
    chrom_offsets = per_chrom.selectExpr("chrom", f"coalesce(sum(n) OVER (ORDER BY chrom {before}), 0L) AS chrom_offset")
    offsets = tile_offsets.join(chrom_offsets, "chrom").selectExpr(
        "chrom", "tile", "tile_offset + chrom_offset AS before"
    )
    inside = f"row_number() OVER (PARTITION BY chrom, tile ORDER BY {', '.join(['start_pos', *order])})"
    numbered = tiled.selectExpr("*", f"{inside} AS inside").join(offsets, ["chrom", "tile"])
    return numbered.selectExpr(*df.columns, "inside + before AS number")
