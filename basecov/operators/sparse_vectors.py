"""Count vectors of any number of samples, from sparse lists of changes.

One generated column per sample (:func:`basecov.operators.vectors.group_segments`) suits a few dozen samples. Here a
change of depth is a row ``(chrom, tile, position, sample, change)``, so neither the plan nor what is shuffled grows
with samples that do not change at a position. Rows are shuffled by tile, sorted, and folded in one pass: a task holds
the depths of all samples at the current position and a bounded block of positions, never a whole tile.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basecov.functions.scalars import ratio
from basecov.operators.coverage import ALL_CHROMOSOMES, TILE, depth_changes, range_blocks
from basecov.operators.vectors import Groups, group_segments, with_vectors

#: Entries (positions x samples) of the blocks a task computes at once.
BLOCK_CELLS = 1 << 20
#: Up to so many samples the form with one column per sample stays within generated code.
COLUMN_SAMPLES = 32

_FOLDED = "chrom STRING, tile INT, start_pos INT, end_pos INT, x ARRAY<INT>, y ARRAY<INT>, avg_a DOUBLE, avg_b DOUBLE"


def _scaled(depths, factors):
    """Depths times their factors, halves rounded up; factor 1 leaves a depth alone."""
    import numpy as np

    exact = depths * factors
    whole = np.floor(exact)
    return (whole + (exact - whole >= 0.5)).astype(np.int64)


def _folder(groups: Groups, min_coverage: float, cells: int):
    """The function for ``mapInArrow`` that turns sorted changes into stretches with both vectors."""
    ids = sorted(set(groups.ids))
    place = {sample: i for i, sample in enumerate(ids)}
    case, control = [place[s] for s in groups.case], [place[s] for s in groups.control]
    factors = [(groups.factors or {}).get(s, 1.0) for s in ids]
    rows_at_once = max(1, cells // len(ids))

    def fold(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        known, scale = np.array(ids), np.array(factors)
        rescale = bool((scale != 1.0).any())
        held, state = None, np.zeros(len(ids), np.int64)

        def vectors(counts):
            flat = pa.array(counts.astype(np.int32).ravel())
            return pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * counts.shape[1]), flat)

        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                coded = part.column("chrom").dictionary_encode()
                names = [*coded.dictionary.to_pylist(), None]  # a missing chromosome has code -1
                code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                tile, pos = part.column("tile").to_numpy(), part.column("start_pos").to_numpy()
                fresh = np.ones(part.num_rows, bool)
                fresh[1:] = (code[1:] != code[:-1]) | (tile[1:] != tile[:-1]) | (pos[1:] != pos[:-1])
                first = np.flatnonzero(fresh)
                spots = [(names[c], t, p) for c, t, p in zip(code[first].tolist(), tile[first].tolist(), pos[first].tolist())]
                # the position left open by the rows before comes first; these rows may still belong to it
                more = 0 if held is None or spots[0] == held else 1
                spots = [held, *spots] if more else spots
                depth = np.zeros((len(spots), len(ids)), np.int64)
                depth[0] = state
                sample = np.searchsorted(known, part.column("sample_id").to_numpy())
                np.add.at(depth, (np.cumsum(fresh) - 1 + more, sample), part.column("change").to_numpy())
                # every block is closed in its tile, so depths are zero where a tile ends and the sum may run on
                np.cumsum(depth, axis=0, out=depth)
                held, state = spots[-1], depth[-1].copy()
                done = depth[:-1]
                covered = np.flatnonzero((done > 0).any(axis=1))
                counts = _scaled(done[covered], scale) if rescale else done[covered]
                x, y = counts[:, case], counts[:, control]
                avg_a, avg_b = x.sum(axis=1) / float(len(case)), y.sum(axis=1) / float(len(control))
                kept = (avg_a >= min_coverage) | (avg_b >= min_coverage)
                if not kept.any():
                    continue
                chosen = covered[kept].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([spots[i][0] for i in chosen], pa.string()),
                        pa.array([spots[i][1] for i in chosen], pa.int32()),
                        pa.array([spots[i][2] for i in chosen], pa.int32()),
                        pa.array([spots[i + 1][2] - 1 for i in chosen], pa.int32()),
                        vectors(x[kept]),
                        vectors(y[kept]),
                        pa.array(avg_a[kept]),
                        pa.array(avg_b[kept]),
                    ],
                    names=["chrom", "tile", "start_pos", "end_pos", "x", "y", "avg_a", "avg_b"],
                )

    return fold


def sparse_segments(
    reads: DataFrame,
    groups: Groups,
    chrom: str = ALL_CHROMOSOMES,
    start: int = 1,
    end: int | None = None,
    min_coverage: float = 1.0,
    tile: int = TILE,
    cells: int = BLOCK_CELLS,
) -> DataFrame:
    """``(chrom, tile, start_pos, end_pos, x, y, avg_a, avg_b, fc)``, the stretches of ``group_segments`` with arrays.

    Changes are summed per position and sample before they are shuffled by tile. Samples without reads are zeros; an
    empty table gives no rows. ``cells`` bounds what a task computes at once, never the result.
    """
    changes = depth_changes(range_blocks(groups.of(reads), chrom, start, end), tile)
    summed = changes.groupBy("chrom", "tile", "start_pos", "sample_id").agg(F.sum("change").alias("change"))
    sorted_ = (
        summed.where("change <> 0")
        .repartition("chrom", "tile")
        .sortWithinPartitions("chrom", "tile", "start_pos")
    )
    folded = sorted_.mapInArrow(_folder(groups, min_coverage, cells), _FOLDED)
    return folded.selectExpr("*", f"{ratio('avg_a', 'avg_b')} AS fc")


def vector_segments(reads: DataFrame, groups: Groups, **options) -> DataFrame:
    """Stretches with the arrays ``x`` and ``y``, in the form that suits the number of samples; the rows are the same."""
    if len(groups.ids) > COLUMN_SAMPLES:
        return sparse_segments(reads, groups, **options)
    return with_vectors(group_segments(reads, groups, **options), groups)
