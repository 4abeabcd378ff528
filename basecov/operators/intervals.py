"""Interval joins as equi-joins on (chromosome, level, bin).

Bins are graded by size: each level is ``LEVEL_FACTOR`` times as wide as the one below, and an interval of the
annotation belongs to the lowest level whose bins are as wide as itself, where it touches at most two. The other side
is expanded to the bins it touches on the levels that the annotation has, one row per level for a short read. So a gene
of any length costs two rows, and an annotation of exons only costs reads nothing. A pair that shares several bins is
kept only in the later of the two first bins, so no duplicate removal is needed. The annotation side is broadcast when
its estimated size, two rows for each interval, stays below the limit; otherwise both sides are shuffled on
(chromosome, level, bin) and adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basecov.functions.scalars import overlap_length, overlap_share, round_half_up
from basecov.session import broadcast_if_small, broadcast_or_merge, fits_broadcast

BIN_WIDTH = 10_000
LEVEL_FACTOR = 8
BINS_PER_INTERVAL = 2
LONGEST = 2**31

UNKNOWN_EXON = "0"
CHROM_NOT_FOUND = "ChrNotFound"
POSITION_NOT_FOUND = "PositionNotFound"
EXON_NOT_FOUND = "ExonNotFound"


def bin_of(position: str, width: int) -> str:
    return f"int({position} div {width})"


def with_bins(df: DataFrame, start: str, end: str, width: int, name: str = "bin") -> DataFrame:
    """One row per bin that the interval touches; ``first_<name>`` keeps the first of them."""
    first, last = bin_of(start, width), bin_of(end, width)
    return df.selectExpr("*", f"{first} AS first_{name}", f"explode(sequence({first}, {last})) AS {name}")


def _level_widths(width: int) -> list[int]:
    """Bin widths of all levels; the last one holds any interval."""
    widths = [width]
    while widths[-1] < LONGEST:
        widths.append(widths[-1] * LEVEL_FACTOR)
    return widths


def _level_of(start: str, end: str, width: int) -> str:
    """The lowest level whose bins are as wide as the interval."""
    size = f"bigint({end}) - {start} + 1"
    *graded, _ = widths = _level_widths(width)
    fits = " ".join(f"WHEN {size} <= {w} THEN {level}" for level, w in enumerate(graded))
    return f"CASE {fits} ELSE {len(widths) - 1} END" if fits else "0"


def _with_level_bins(df: DataFrame, start: str, end: str, width: int, level: str, name: str) -> DataFrame:
    """One row per bin of the row's level that the interval touches; ``first_<name>`` keeps the first of them."""
    sizes = f"array({', '.join(f'{w}L' for w in _level_widths(width))})[{level}]"
    first, last = bin_of(start, sizes), bin_of(end, sizes)
    return df.selectExpr("*", f"{first} AS first_{name}", f"explode(sequence({first}, {last})) AS {name}")


def binned_exons(exons: DataFrame, width: int) -> DataFrame:
    """Annotation rows prefixed ``e_``, in the bins of their level: at most two rows each."""
    level = _level_of("start_pos", "end_pos", width)
    renamed = exons.selectExpr(
        "chrom AS e_chrom",
        "gene_id AS e_gene",
        "exon_id AS e_exon",
        "start_pos AS e_start",
        "end_pos AS e_end",
        f"{level} AS e_level",
    )
    return _with_level_bins(renamed, "e_start", "e_end", width, "e_level", "e_bin")


def annotation_is_small(exons: DataFrame) -> bool:
    """Whether the annotation can be broadcast after its expansion to bins; starts no job."""
    return fits_broadcast(exons, copies=BINS_PER_INTERVAL)


def join_exons(
    left: DataFrame, start: str, end: str, exons: DataFrame, width: int, condition: str, small: bool, how: str = "inner", parts: int | None = None
) -> DataFrame:
    """Join rows with ``chrom`` and an interval ``start`` to ``end`` with the annotation.

    The levels in use are a scalar subquery of at most a dozen numbers, evaluated when the join runs. In a left join a
    row without a partner comes out once per bin that it was looked for in. ``parts`` is the number of partitions of a
    shuffled join that needs more than the session's; rows of equal placement should then be one, as no bin is split.
    """
    levels = exons.agg(F.expr(f"collect_set({_level_of('start_pos', 'end_pos', width)}) AS levels")).scalar()
    looked = left.withColumn("levels", levels).selectExpr(
        *left.columns, "explode(if(size(levels) = 0, array(0), levels)) AS level"
    )
    right = broadcast_or_merge(binned_exons(exons, width), small)
    same_bin = "chrom = e_chrom AND level = e_level AND bin = e_bin AND bin = greatest(first_bin, first_e_bin)"
    binned = _with_level_bins(looked, start, end, width, "level", "bin")
    if parts and not small:
        binned = binned.repartition(parts, "chrom", "level", "bin")
    return binned.join(right, F.expr(f"{same_bin} AND {condition}"), how)


def _known_chromosomes(exons: DataFrame) -> DataFrame:
    return broadcast_if_small(exons.select(F.col("chrom").alias("known_chrom")).distinct())


def map_regions_to_exons(
    regions: DataFrame, exons: DataFrame, width: int = BIN_WIDTH, tile: int | None = None
) -> DataFrame:
    """Annotate regions ``(chrom, start_pos, length, ...)`` with their best exon of each overlapped gene.

    The region end is ``start_pos + length`` and an exon counts when the overlap is above 1. Regions without an exon
    get exon ``0`` and a gene entry telling whether the chromosome or only the position is unknown.

    The rows are shuffled once, on ``(chrom, tile)`` of the region's start. With ``tile`` given, that column stays in
    the result, so that a later step that works by tile can reuse the shuffle.
    """
    carried = [c for c in regions.columns if c not in ("chrom", "start_pos")]
    left = regions.selectExpr(
        "*", "start_pos + length AS stop_pos", f"{bin_of('start_pos', tile or width)} AS tile"
    )
    overlap = overlap_length("start_pos", "stop_pos", "e_start", "e_end")
    small = annotation_is_small(exons)
    pairs = join_exons(left, "start_pos", "stop_pos", exons, width, f"{overlap} > 1", small, "left")
    keyed = pairs.selectExpr(
        "chrom",
        "tile",
        "start_pos",
        *carried,
        "e_gene",
        "e_start",
        "e_exon",
        f"{overlap_share(overlap, 'e_start', 'e_end')} AS share",
    ).repartition("chrom", "tile")
    best = keyed.groupBy("chrom", "tile", "start_pos", "e_gene").agg(
        F.expr("max(struct(share, e_start, e_exon)) AS best"), *[F.expr(f"first({c}) AS {c}") for c in carried]
    )
    found = "max(e_gene IS NOT NULL) OVER (PARTITION BY chrom, tile, start_pos) AS found"
    kept = best.selectExpr("*", found).where("e_gene IS NOT NULL OR NOT found")
    tagged = kept.join(_known_chromosomes(exons), F.expr("chrom = known_chrom"), "left")
    missing = f"if(known_chrom IS NULL, '{CHROM_NOT_FOUND}', '{POSITION_NOT_FOUND}')"
    return tagged.selectExpr(
        "chrom",
        *([] if tile is None else ["tile"]),
        "start_pos",
        *carried,
        f"coalesce(e_gene, {missing}) AS gene_id",
        f"coalesce(best.e_exon, '{UNKNOWN_EXON}') AS exon_id",
        f"coalesce({round_half_up('best.share', 4)}, 0D) AS overlap_pct",
    )


def _owned_stretches(exons: DataFrame, width: int) -> DataFrame:
    """Disjoint stretches ``(e_chrom, own_start, hit)``: where each exon is the first one (by start, then id).

    Exons before a given one in that order start no later, so together they hold every base from its start to the
    largest of their ends: it owns what lies behind. That running maximum is taken inside bins of the start; the
    maxima of the bins before are added from a table with one row per bin.
    """
    entry = "struct(start_pos, exon_id, gene_id, end_pos) AS hit"
    rows = exons.where("start_pos <= end_pos").selectExpr("chrom AS e_chrom", f"{bin_of('start_pos', width)} AS e_bin", entry)
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    bins = rows.groupBy("e_chrom", "e_bin").agg(F.expr("max(hit.end_pos) AS reach")).selectExpr(
        "e_chrom", "e_bin", f"max(reach) OVER (PARTITION BY e_chrom ORDER BY e_bin {before}) AS bins_before"
    )
    inside = f"max(hit.end_pos) OVER (PARTITION BY e_chrom, e_bin ORDER BY hit {before}) AS inside"
    reached = rows.selectExpr("*", inside).join(bins, ["e_chrom", "e_bin"])
    # greatest() skips missing values: the first exon of a chromosome owns all its bases
    owned = reached.selectExpr("e_chrom", "greatest(hit.start_pos, inside + 1, bins_before + 1) AS own_start", "hit")
    return owned.where("own_start <= hit.end_pos")


def lookup_exon_at(points: DataFrame, exons: DataFrame, width: int = BIN_WIDTH) -> DataFrame:
    """For each row ``(chrom, pos, ...)`` the first exon (by start, then id) that holds the position.

    A sweep: the bases each exon owns, cut at bins, and the distinct positions are one stream per (chromosome, bin),
    and a position takes the last stretch that began before it. A bin holds at most two rows per base, whatever the
    number of exons and points; the points then join their positions, where adaptive execution broadcasts few
    positions and splits a hot one. No exon gives empty names and zero coordinates; an unknown or missing chromosome
    gives ``ExonNotFound`` and exon ``0``, a missing position is in no exon.
    """
    stretches = with_bins(_owned_stretches(exons, width), "own_start", "hit.end_pos", width, "e_bin").selectExpr(
        "e_chrom", "e_bin", f"greatest(bigint(own_start), bigint(e_bin) * {width}) AS e_pos", "false AS asked", "hit"
    )
    places = points.selectExpr("chrom AS e_chrom", "bigint(pos) AS e_pos").distinct()
    asked = places.selectExpr("e_chrom", f"{bin_of('e_pos', width)} AS e_bin", "e_pos", "true AS asked", "NULL AS hit")
    last = "last(hit, true) OVER (PARTITION BY e_chrom, e_bin ORDER BY e_pos, asked ROWS UNBOUNDED PRECEDING) AS hit"
    swept = stretches.unionByName(asked).selectExpr("e_chrom", "e_pos", "asked", last)
    found = swept.where("asked AND hit.end_pos >= e_pos").select("e_chrom", "e_pos", "hit")
    joined = points.join(found, F.expr("chrom = e_chrom AND bigint(pos) = e_pos"), "left").join(
        _known_chromosomes(exons), F.expr("chrom = known_chrom"), "left"
    )
    return joined.selectExpr(
        *points.columns,
        f"coalesce(hit.gene_id, if(known_chrom IS NULL, '{EXON_NOT_FOUND}', '')) AS gene_id",
        f"coalesce(hit.exon_id, if(known_chrom IS NULL, '{UNKNOWN_EXON}', '')) AS exon_id",
        "coalesce(hit.start_pos, 0) AS exon_start",
        "coalesce(hit.end_pos, 0) AS exon_end",
    )


def lookup_exon_range(rows: DataFrame, exons: DataFrame) -> DataFrame:
    """Add the coordinates of ``(gene_id, exon_id)``."""
    ranges = exons.selectExpr(
        "gene_id", "exon_id", "chrom AS exon_chrom", "start_pos AS exon_start", "end_pos AS exon_end"
    )
    return rows.join(broadcast_if_small(ranges), ["gene_id", "exon_id"])
