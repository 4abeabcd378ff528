"""Which byte ranges of a BAM file can hold reads of a region, by the bin tree and the linear index of its ``.bai`` file.

A virtual offset is the place of a block in the file, shifted by 16 bits, plus a place inside the block.
"""

from __future__ import annotations

import struct

# Fixed values of the index format.
MAGIC = b"BAI\x01"
LINEAR_SHIFT = 14
#: Shift of positions and number of the first bin, from the largest bins to the smallest.
LEVELS = ((29, 0), (26, 1), (23, 9), (20, 73), (17, 585), (14, 4681))
COUNTS_BIN = 37450  # holds counts instead of chunks


def bin_of_range(begin: int, end: int) -> int:
    """The smallest bin that holds the 0-based, half-open range."""
    last = max(begin, end - 1)
    for shift, first in reversed(LEVELS):
        if begin >> shift == last >> shift:
            return first + (begin >> shift)
    return 0


def bins_over(begin: int, end: int) -> set[int]:
    """All bins that may hold reads which meet the 0-based, half-open range."""
    last = min(max(begin, end - 1), (1 << 29) - 1)
    return {first + k for shift, first in LEVELS for k in range(begin >> shift, (last >> shift) + 1)}


class BamIndex:
    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a BAM index")
        self.references: list[tuple[dict[int, list[tuple[int, int]]], tuple[int, ...]]] = []
        at = 8
        for _ in range(struct.unpack_from("<i", data, 4)[0]):
            bins: dict[int, list[tuple[int, int]]] = {}
            count = struct.unpack_from("<i", data, at)[0]
            at += 4
            for _ in range(count):
                number, n_chunks = struct.unpack_from("<Ii", data, at)
                at += 8
                if number != COUNTS_BIN:
                    bins[number] = list(struct.iter_unpack("<QQ", data[at : at + 16 * n_chunks]))
                at += 16 * n_chunks
            n_linear = struct.unpack_from("<i", data, at)[0]
            self.references.append((bins, struct.unpack_from(f"<{n_linear}Q", data, at + 4)))
            at += 4 + 8 * n_linear

    def ranges(self, reference: int, start: int, end: int | None) -> list[tuple[int, int]]:
        """Byte ranges, in order and apart, whose blocks hold the starts of all reads over ``start..end`` (1-based, closed)."""
        if not 0 <= reference < len(self.references):
            return []
        bins, linear = self.references[reference]
        begin = max(start, 1) - 1
        wanted = bins.keys() if end is None and not begin else bins_over(begin, (1 << 29) if end is None else end)
        # reads over the region start no earlier in the file than the first read over its first stretch of 16 kb
        least = linear[min(begin >> LINEAR_SHIFT, len(linear) - 1)] if linear else 0
        chunks = sorted((max(a, least), b) for k in wanted if k in bins for a, b in bins[k] if b > least)
        out: list[tuple[int, int]] = []
        for a, b in chunks:
            first, last = a >> 16, (b >> 16) + (1 if b & 0xFFFF else 0)
            if out and first <= out[-1][1]:  # the same block, or the next one
                out[-1] = (out[-1][0], max(out[-1][1], last))
            else:
                out.append((first, last))
        return out


def write_index(records: list[tuple[int, int, int, int, int]], n_references: int) -> bytes:
    """Index bytes for ``(reference, begin, end, virtual offset, virtual offset behind)`` records in the order of the file."""
    bins: list[dict[int, list[list[int]]]] = [{} for _ in range(n_references)]
    linear: list[dict[int, int]] = [{} for _ in range(n_references)]
    for reference, begin, end, first, behind in records:
        if reference < 0:
            continue
        chunks = bins[reference].setdefault(bin_of_range(begin, end), [])
        if chunks and chunks[-1][1] == first:
            chunks[-1][1] = behind
        else:
            chunks.append([first, behind])
        for k in range(begin >> LINEAR_SHIFT, (max(begin, end - 1) >> LINEAR_SHIFT) + 1):
            linear[reference].setdefault(k, first)
    out = [MAGIC, struct.pack("<i", n_references)]
    for own, places in zip(bins, linear):
        out.append(struct.pack("<i", len(own)))
        for number, chunks in own.items():
            out.append(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
        filled, last = [], 0
        for k in range(max(places, default=-1) + 1):
            last = places.get(k, last)
            filled.append(last)
        out.append(struct.pack(f"<i{len(filled)}Q", len(filled), *filled))
    return b"".join(out)
