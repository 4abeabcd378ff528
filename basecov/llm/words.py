"""Words of a column of texts as arrays: places, 64-bit keys and the document each word belongs to.

Texts arrive in Arrow batches. A batch is cut at document borders into pieces of about a megabyte, so that memory stays
bounded by the piece (or by the longest single text), and all words of a piece are found and hashed together with numpy.
Missing texts count as empty. A key is a hash of the word's bytes, so equal words have equal keys in every task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
SEGMENT = 1 << 17
#: Longer words are hashed with blake2b: polynomial keys of long words collide for texts that can be written down.
LONG_WORD = 128
MULTIPLIER = 0x9E3779B97F4A7C15
#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = (0x20, *range(0x09, 0x0E))


def separators(codes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(codes)] = True
    return table


WHITE_TABLE = separators(WHITE)
#: Everything in ASCII but digits and letters.
NOT_ALNUM_TABLE = separators([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

_mask = (1 << 64) - 1


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(MULTIPLIER, SEGMENT + LONG_WORD + 1)
_INVERSES = _powers(pow(MULTIPLIER, -1, 1 << 64), SEGMENT + LONG_WORD + 1)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES_LOWER = _VALUES.copy()
_VALUES_LOWER[0x41:0x5B] = _VALUES[0x61:0x7B]


def mix(keys: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return keys ^ (keys >> np.uint64(32))


@dataclass
class Words:
    """The words of the documents ``row .. row + n_docs`` of a batch."""

    row: int
    data: np.ndarray  # bytes of the texts, one after another
    offsets: np.ndarray  # n_docs + 1 places in data
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray
    first: np.ndarray  # n_docs + 1 places in start; words of document i are first[i] .. first[i + 1]

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The document, counted from 0, of each word."""
        return np.repeat(np.arange(self.n_docs), self.count)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first words of all windows inside one document, and a key for each window."""
        return starts_of(self.first, length), window_keys(self.key, self.first, length)


def starts_of(first: np.ndarray, length: int) -> np.ndarray:
    """Places at which a window of ``length`` stays inside its document."""
    ends = np.repeat(first[1:], np.diff(first))
    return np.flatnonzero(np.arange(len(ends)) + length <= ends)


def window_keys(key: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    at = starts_of(first, length)
    out = np.full(len(at), length, np.uint64)
    for k in range(length):
        out *= np.uint64(MULTIPLIER)
        out += key[at + k]
        out ^= out >> np.uint64(31)
    return mix(out)


def prefix_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray, lengths: tuple[int, ...], lower: bool = False) -> list[np.ndarray]:
    """For each of some short lengths in bytes: keys of the ranges' beginnings, 0 where the range is not longer."""
    values = _VALUES_LOWER if lower else _VALUES
    out = [np.zeros(len(start), np.uint64) for _ in lengths]
    bounds = np.searchsorted(start, np.arange(0, len(data) + SEGMENT, SEGMENT))
    for i, j in zip(bounds[:-1], bounds[1:]):
        if i == j:
            continue
        low, high = start[i], min(start[j - 1] + max(lengths), len(data))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[data[low:high]] * _POWERS[: high - low], out=sums[1:])
        s, size = start[i:j] - low, end[i:j] - start[i:j]
        begun, back = sums[s], _INVERSES[s]
        for k, length in zip(out, lengths):
            longer = np.flatnonzero(size > length)
            k[i + longer] = mix((sums[s[longer] + length] - begun[longer]) * back[longer] + np.uint64(length << 32))
    return out


def keys_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """Keys of the byte ranges start .. end, which ascend and do not overlap."""
    values = _VALUES_LOWER if lower else _VALUES
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    apart = (end - start) > LONG_WORD
    stop_at = np.where(apart, start, end)
    bounds = np.searchsorted(start, np.arange(0, len(data) + SEGMENT, SEGMENT))
    for i, j in zip(bounds[:-1], bounds[1:]):
        if i == j:
            continue
        low = start[i]
        high = stop_at[i:j].max()
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[data[low:high]] * _POWERS[: high - low], out=sums[1:])
        s = start[i:j] - low
        out[i:j] = (sums[stop_at[i:j] - low] - sums[s]) * _INVERSES[s]
    out = mix(out + np.minimum(end - start, LONG_WORD).astype(np.uint64))
    for i in np.flatnonzero(apart):
        raw = data[start[i] : end[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(raw.lower() if lower else raw, digest_size=8).digest(), "little")
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and len + 1 offsets; a missing text is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def cuts(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``limit`` bytes each, one document at least."""
    low = 0
    while low < len(offsets) - 1:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = max(low + 1, high)
        yield low, high
        low = high


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest ranges without separators inside each document; offsets begin at 0."""
    inside = np.empty(len(data) + 1, bool)
    np.logical_not(table[data], out=inside[:-1])
    inside[-1] = False
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    borders = offsets[:-1][offsets[:-1] < len(data)]
    begins[borders] = inside[borders]
    finishes = inside[:-1] & ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    finishes[last] = inside[last]
    return np.flatnonzero(begins), np.flatnonzero(finishes) + 1


def pieces(column: pa.Array, table: np.ndarray = WHITE_TABLE, lower: bool = False, limit: int = PIECE_BYTES) -> Iterator[Words]:
    """The words of a column of texts, piece by piece; every document is in exactly one piece."""
    data, offsets = text_buffers(column)
    for low, high in cuts(offsets, limit):
        part = data[offsets[low] : offsets[high]]
        places = offsets[low : high + 1] - offsets[low]
        start, end = split_words(part, places, table)
        first = np.searchsorted(start, places)
        yield Words(low, part, places, start, end, keys_of(part, start, end, lower), first)
