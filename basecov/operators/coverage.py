"""Base and feature coverage.

Base coverage is kept as *segments*: stretches of constant depth. Every aligned block contributes +1 at its first
base and -1 behind its last one; the changes are summed per position (with partial aggregation, so a pile-up at one
place collapses before the shuffle) and a running sum turns them into depths. Blocks are cut at the borders of fixed
tiles, which bounds each window by the tile width no matter how the reads are distributed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basecov.functions.scalars import scale_count
from basecov.operators.intervals import BIN_WIDTH, annotation_is_small, bin_of, join_exons
from basecov.session import broadcast_if_small, partitions_by_size

TILE = 8192
ALL_CHROMOSOMES = "*"
MAX_SAMPLES = 1_000_000
UNMAPPED = 4

_BLOCKS = "array<struct<start_pos:int,end_pos:int>>"


def _blocks_of_cigar() -> str:
    """Aligned blocks of a read: M, = and X cover bases, D and N only move on."""
    size, letter = "int(left(op, length(op) - 1))", "right(op, 1)"
    block = f"array(named_struct('start_pos', acc.at, 'end_pos', acc.at + {size} - 1))"
    return f"""
        CASE WHEN cigar RLIKE '^[0-9]+M$' THEN cast(array(struct(start_pos, end_pos)) AS {_BLOCKS})
        ELSE aggregate(
          regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]', 0),
          named_struct('at', start_pos, 'blocks', cast(array() AS {_BLOCKS})),
          (acc, op) -> named_struct(
            'at', acc.at + if({letter} IN ('M', 'D', 'N', '=', 'X'), {size}, 0),
            'blocks', if({letter} IN ('M', '=', 'X'), concat(acc.blocks, {block}), acc.blocks)),
          acc -> acc.blocks) END"""


def mapped(reads: DataFrame) -> DataFrame:
    return reads.where(f"flag & {UNMAPPED} = 0") if "flag" in reads.columns else reads


def in_range(reads: DataFrame, chrom: str = ALL_CHROMOSOMES, start: int = 1, end: int | None = None) -> DataFrame:
    """Reads that touch a range; plain comparisons, so they reach a Parquet scan. Without ``end`` it has no upper bound."""
    if chrom != ALL_CHROMOSOMES:
        reads = reads.where(F.col("chrom") == chrom)
    return reads.where(f"end_pos >= {start}" + (f" AND start_pos <= {end}" if end is not None else ""))


def aligned_blocks(reads: DataFrame) -> DataFrame:
    """``(sample_id, chrom, start_pos, end_pos)``, one row per aligned block, both ends inclusive."""
    reads = mapped(reads)
    if "cigar" not in reads.columns:
        return reads.select("sample_id", "chrom", "start_pos", "end_pos")
    return reads.selectExpr("sample_id", "chrom", f"inline({_blocks_of_cigar()})")


def range_blocks(reads: DataFrame, chrom: str, start: int, end: int | None) -> DataFrame:
    """Aligned blocks cut to a range before anything is expanded."""
    blocks = aligned_blocks(in_range(reads, chrom, start, end))
    if "cigar" in reads.columns:
        blocks = in_range(blocks, chrom, start, end)
    last = "end_pos" if end is None else f"least(end_pos, {end}) AS end_pos"
    return blocks.selectExpr("sample_id", "chrom", f"greatest(start_pos, {start}) AS start_pos", last)


def depth_changes(blocks: DataFrame, tile: int = TILE) -> DataFrame:
    """``(sample_id, chrom, tile, start_pos, change)``: two rows per block and tile."""
    pieces = blocks.selectExpr(
        "*", f"explode(sequence({bin_of('start_pos', tile)}, {bin_of('end_pos', tile)})) AS tile"
    )
    # 64-bit arithmetic: the place behind the last base of the last tile may exceed an INT
    enter = f"greatest(bigint(start_pos), bigint(tile) * {tile})"
    leave = f"least(bigint(end_pos), bigint(tile) * {tile} + {tile - 1}) + 1"
    return pieces.selectExpr("sample_id", "chrom", "tile", f"stack(2, {enter}, 1, {leave}, -1) AS (start_pos, change)")


def base_segments(
    reads: DataFrame,
    chrom: str = ALL_CHROMOSOMES,
    start: int = 1,
    end: int | None = None,
    factors: DataFrame | None = None,
    tile: int = TILE,
) -> DataFrame:
    """Depth per sample as ``(sample_id, chrom, start_pos, end_pos, cov)`` with constant depth inside a row.

    ``factors(sample_id, norm_factor)`` scales the depth and rounds it back to an integer.
    """
    changes = depth_changes(range_blocks(reads, chrom, start, end), tile)
    summed = changes.groupBy("sample_id", "chrom", "tile", "start_pos").agg(F.sum("change").alias("change"))
    in_tile = "OVER (PARTITION BY sample_id, chrom, tile ORDER BY start_pos"
    segments = (
        summed.where("change <> 0")
        .selectExpr(
            "sample_id",
            "chrom",
            "start_pos",
            f"lead(start_pos) {in_tile}) - 1 AS end_pos",
            f"int(sum(change) {in_tile} ROWS UNBOUNDED PRECEDING)) AS cov",
        )
        .where("cov > 0")
        .selectExpr("sample_id", "chrom", "try_cast(start_pos AS INT) AS start_pos", "try_cast(end_pos AS INT) AS end_pos", "cov")
    )
    return segments if factors is None else _scaled(segments, factors)


def _scaled(counts: DataFrame, factors: DataFrame, kind: str = "int") -> DataFrame:
    """Apply ``factors(sample_id, norm_factor)`` to ``cov``.

    The factors often come from counting the reads, so their size is not known to Catalyst. There is one per sample:
    they are broadcast, at most ``MAX_SAMPLES`` of them, and one more is an error when the query runs.
    """
    too_many = f"raise_error('more than {MAX_SAMPLES} normalisation factors')"
    bounded = factors.selectExpr("sample_id", "double(norm_factor) AS norm_factor").limit(MAX_SAMPLES + 1)
    place = bounded.selectExpr("*", "row_number() OVER (ORDER BY sample_id) AS place")
    table = place.selectExpr("sample_id", f"if(place > {MAX_SAMPLES}, double({too_many}), norm_factor) AS norm_factor")
    others = [c for c in counts.columns if c != "cov"]
    joined = counts.join(F.broadcast(table), "sample_id")
    return joined.selectExpr(*others, f"{scale_count('cov', 'norm_factor', kind)} AS cov")


def expand_positions(segments: DataFrame) -> DataFrame:
    """One row per base: replaces ``start_pos, end_pos`` by ``pos``."""
    others = [c for c in segments.columns if c not in ("start_pos", "end_pos")]
    return segments.selectExpr(*others, "explode(sequence(start_pos, end_pos)) AS pos")


def base_coverage(reads: DataFrame, **options) -> DataFrame:
    """``(sample_id, chrom, pos, cov)`` for every covered base; options as for :func:`base_segments`."""
    return expand_positions(base_segments(reads, **options)).select("sample_id", "chrom", "pos", "cov")


def bases_at_depth(reads: DataFrame, min_depth: int, **options) -> DataFrame:
    """Number of (sample, base) pairs with at least ``min_depth`` reads, counted on segments."""
    deep = base_segments(reads, **options).where(f"cov >= {min_depth}")
    return deep.agg(F.expr("coalesce(sum(end_pos - start_pos + 1), 0L) AS n_bases"))


def read_counts(reads: DataFrame) -> DataFrame:
    """Reads of each sample, all samples in one job; like the scan itself, unmapped reads count too."""
    return reads.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_reads"))


def library_factors(reads: DataFrame, samples: DataFrame) -> DataFrame:
    """``(sample_id, grp, n_reads, norm_factor)`` with factor = reads of the group's first sample / reads of this one."""
    counts = samples.join(read_counts(reads), "sample_id", "left").selectExpr(
        "ord", "sample_id", "grp", "coalesce(n_reads, 0L) AS n_reads"
    )
    first = "first(n_reads) OVER (PARTITION BY grp ORDER BY ord)"
    return counts.selectExpr(
        "sample_id", "grp", "n_reads", f"if(n_reads > 0, double({first}) / n_reads, 1D) AS norm_factor"
    )


# --- features ------------------------------------------------------------------------------------------------


def region_hits(
    reads: DataFrame, exons: DataFrame, union_mode: bool = False, width: int = BIN_WIDTH
) -> DataFrame:
    """``(sample_id, gene_id, exon_id, n)``: reads meeting an exon, each read once per exon; ``n`` still to be summed.

    Reads with equal placement hit the same exons, so they are first counted together when matches have to be
    grouped per read (union mode drops reads that meet more than one exon) or when the annotation is too large to
    broadcast: a pile-up then enters the shuffled join as one row.

    Where the session's partitions would be large for these reads, they are dealt out by sample and place to as many as
    their size asks for, and counted there: a task then holds the exons of its own places, not those of a whole split.
    """
    small = annotation_is_small(exons)
    # A read without an aligned base (CIGAR '*') ends before it starts; it covers nothing and hits nothing.
    reads, placement = mapped(reads).where("end_pos >= start_pos"), ["sample_id", "chrom", "start_pos", "end_pos"]
    meets = "start_pos <= e_end AND end_pos >= e_start"
    if "cigar" in reads.columns:
        # only a gap in the alignment makes the blocks differ from the extent of the read
        placement = [*placement, "blocks"]
        reads = reads.selectExpr("*", f"if(cigar RLIKE '[DN]', {_blocks_of_cigar()}, NULL) AS blocks")
        meets += " AND (blocks IS NULL OR exists(blocks, b -> b.start_pos <= e_end AND b.end_pos >= e_start))"
    parts = partitions_by_size(reads.select(*placement))
    if parts:
        reads = reads.selectExpr(*placement, f"{bin_of('start_pos', width)} AS near")
        reads, placement = reads.repartition(parts, "sample_id", "chrom", "near"), [*placement, "near"]
    if union_mode or not small or parts:
        left = reads.groupBy(*placement).agg(F.expr("count(*) AS n"))
    else:
        left = reads.selectExpr(*placement, "1L AS n")
    pairs = join_exons(left, "start_pos", "end_pos", exons, width, meets, small, parts=parts)
    if union_mode:
        if parts and not small:
            pairs = pairs.repartition(parts, "sample_id", "chrom", "near")
        pairs = (
            pairs.groupBy(*placement)
            .agg(
                F.expr("count(*) AS n_hits"),
                F.expr("first(n) AS n"),
                F.expr("first(e_gene) AS e_gene"),
                F.expr("first(e_exon) AS e_exon"),
            )
            .where("n_hits = 1")
        )
    return pairs.selectExpr("sample_id", "e_gene AS gene_id", "e_exon AS exon_id", "n")


def region_coverage(
    reads: DataFrame,
    exons: DataFrame,
    union_mode: bool = False,
    factors: DataFrame | None = None,
    width: int = BIN_WIDTH,
) -> DataFrame:
    """Feature counts ``(sample_id, gene_id, exon_id, cov)``; counts are 64-bit integers."""
    hits = region_hits(reads, exons, union_mode, width)
    counts = hits.groupBy("sample_id", "gene_id", "exon_id").agg(F.expr("sum(n) AS cov"))
    return counts if factors is None else _scaled(counts, factors, "bigint")


def coverage_table(counts: DataFrame, sample_ids: Sequence[int], level: str = "exon") -> DataFrame:
    """Count table: one row per exon or gene, one 64-bit column ``s<id>`` per sample, zero where nothing was counted."""
    keys = {"exon": ["gene_id", "exon_id"], "gene": ["gene_id"], "base": ["chrom", "pos"]}[level]
    per_sample = [F.expr(f"sum(if(sample_id = {s}, cov, 0)) AS s{s}") for s in sorted(sample_ids)]
    return counts.groupBy(*keys).agg(*per_sample)


def of_genes(counts: DataFrame, genes: Sequence[str] | DataFrame) -> DataFrame:
    """Counts of the listed genes only; a list filters in place, a DataFrame ``(gene_id)`` by a semi join."""
    if isinstance(genes, DataFrame):
        return counts.join(broadcast_if_small(genes), "gene_id", "left_semi")
    return counts.where(F.col("gene_id").isin(list(genes)))
