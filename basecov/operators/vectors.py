"""Count vectors of two groups of samples, per stretch of bases or per feature."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basecov.functions.scalars import ratio, scale_count
from basecov.operators.coverage import (
    ALL_CHROMOSOMES,
    TILE,
    depth_changes,
    range_blocks,
    region_hits,
)
from basecov.operators.intervals import BIN_WIDTH


@dataclass(frozen=True)
class Groups:
    """Sample ids of the two groups, and the normalisation factors that differ from 1."""

    case: tuple[int, ...]
    control: tuple[int, ...]
    factors: Mapping[int, float] | None = None

    @property
    def ids(self) -> tuple[int, ...]:
        return (*self.case, *self.control)

    @property
    def case_columns(self) -> list[str]:
        return [f"c{i}" for i in range(len(self.case))]

    @property
    def control_columns(self) -> list[str]:
        return [f"c{i}" for i in range(len(self.case), len(self.ids))]

    @property
    def columns(self) -> list[str]:
        return self.case_columns + self.control_columns

    def scaled(self, index: int, count: str) -> str:
        factor = (self.factors or {}).get(self.ids[index], 1.0)
        return f"int({count})" if factor == 1.0 else scale_count(count, f"{factor!r}D")

    def of(self, reads: DataFrame) -> DataFrame:
        return reads.where(F.col("sample_id").isin(list(self.ids)))


def _with_means(df: DataFrame, groups: Groups) -> DataFrame:
    total_a, total_b = " + ".join(groups.case_columns), " + ".join(groups.control_columns)
    means = df.selectExpr(
        "*",
        f"double({total_a}) / {len(groups.case)}D AS avg_a",
        f"double({total_b}) / {len(groups.control)}D AS avg_b",
    )
    return means.selectExpr("*", f"{ratio('avg_a', 'avg_b')} AS fc")


def with_vectors(df: DataFrame, groups: Groups) -> DataFrame:
    """Replace the count columns by the arrays ``x`` (case) and ``y`` (control)."""
    others = [c for c in df.columns if c not in groups.columns]
    return df.select(*others, F.array(*groups.case_columns).alias("x"), F.array(*groups.control_columns).alias("y"))


def group_segments(
    reads: DataFrame,
    groups: Groups,
    chrom: str = ALL_CHROMOSOMES,
    start: int = 1,
    end: int | None = None,
    min_coverage: float = 1.0,
    tile: int = TILE,
) -> DataFrame:
    """Both groups' counts per stretch of bases on which no sample changes.

    Columns: ``chrom, tile, start_pos, end_pos, c0..cN-1`` (case samples first), ``avg_a, avg_b, fc``; stretches with
    a mean of at least ``min_coverage`` in one group. A sample without reads contributes zeros. This is the full outer
    join of the two groups' base coverages, done by one aggregation per position of change.
    """
    changes = depth_changes(range_blocks(groups.of(reads), chrom, start, end), tile)
    columns = groups.columns
    per_sample = [
        F.expr(f"sum(if(sample_id = {s}, change, 0)) AS {name}") for s, name in zip(groups.ids, columns)
    ]
    summed = changes.groupBy("chrom", "tile", "start_pos").agg(*per_sample)
    in_tile = "OVER (PARTITION BY chrom, tile ORDER BY start_pos"
    depths = summed.where(" OR ".join(f"{name} <> 0" for name in columns)).selectExpr(
        "chrom",
        "tile",
        "start_pos",
        f"lead(start_pos) {in_tile}) - 1 AS end_pos",
        *[f"sum({name}) {in_tile} ROWS UNBOUNDED PRECEDING) AS {name}" for name in columns],
    )
    covered = depths.where(" OR ".join(f"{name} > 0" for name in columns))
    counts = covered.selectExpr(
        "chrom",
        "tile",
        "try_cast(start_pos AS INT) AS start_pos",
        "try_cast(end_pos AS INT) AS end_pos",
        *[f"coalesce({groups.scaled(i, name)}, 0) AS {name}" for i, name in enumerate(columns)],
    )
    return _with_means(counts, groups).where(f"avg_a >= {min_coverage} OR avg_b >= {min_coverage}")


def region_vectors(
    reads: DataFrame,
    exons: DataFrame,
    groups: Groups,
    union_mode: bool = False,
    width: int = BIN_WIDTH,
) -> DataFrame:
    """Both groups' feature counts ``(gene_id, exon_id, c0..cN-1, avg_a, avg_b, fc)``."""
    hits = region_hits(groups.of(reads), exons, union_mode, width)
    per_sample = [
        F.expr(f"coalesce({groups.scaled(i, f'sum(if(sample_id = {s}, n, 0))')}, 0) AS c{i}")
        for i, s in enumerate(groups.ids)
    ]
    return _with_means(hits.groupBy("gene_id", "exon_id").agg(*per_sample), groups)


def exon_count_join(
    reads: DataFrame, exons: DataFrame, groups: Groups, width: int = BIN_WIDTH
) -> DataFrame:
    """Counts of the samples that saw an exon, for exons seen in both groups: ``(gene_id, exon_id, x, y)``.

    An inner join of two per-group collections on the exon, written as one aggregation so that the reads are scanned
    and shuffled once; an array never holds more entries than the group has samples.
    """
    hits = region_hits(groups.of(reads), exons, width=width)
    # A sample counts as seen by its reads, not by the scaled count, which may round to zero.
    seen = [F.expr(f"sum(if(sample_id = {s}, n, 0)) AS n{i}") for i, s in enumerate(groups.ids)]
    counts = hits.groupBy("gene_id", "exon_id").agg(*seen)

    def scaled(indexes: range) -> str:
        entries = [f"if(n{i} > 0, {groups.scaled(i, f'n{i}')}, NULL)" for i in indexes]
        return f"array_compact(array({', '.join(entries)}))"

    cases = len(groups.case)
    pairs = counts.selectExpr("gene_id", "exon_id", f"{scaled(range(cases))} AS x", f"{scaled(range(cases, len(groups.ids)))} AS y")
    return pairs.where("size(x) > 0 AND size(y) > 0")
