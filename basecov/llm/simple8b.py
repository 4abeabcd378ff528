"""Simple-8b coding of unsigned 64-bit integers, whole arrays at a time.

A 64-bit word holds a selector in its four highest bits and as many integers as fit at the selector's width in the other
sixty. Integers are packed in blocks of ``BLOCK``; a block begins a word, and the word number of every block is kept, so
blocks can be coded and decoded independently and all at once. An integer above 60 bits takes a word of selector 0 with
its low 60 bits; its high bits follow in a list of exceptions.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128
#: By selector: integers in a word, and bits of each. Fixed values; selector 0 is the escape, selector 1 a run of zeros.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_LOW60 = np.uint64((1 << 60) - 1)


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bit lengths."""
    high = ids >> np.uint64(32)
    low = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, low).astype(np.uint8) if high.any() else low.astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the word at which each block begins (and the number of words), exceptions."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.uint32), np.empty(0, np.uint8)
    bits = np.zeros(n_blocks * BLOCK, np.uint8)
    bits[:n] = _bits(ids)
    bits = bits.reshape(n_blocks, BLOCK)
    column = np.arange(BLOCK, dtype=np.uint8)
    selector = np.zeros((n_blocks, BLOCK), np.uint8)
    least, most = bits.min(), bits.max()
    # From the sparsest selector to the densest: the last one that fits a place wins.
    for s in range(15, 0, -1):
        if WIDTHS[s] >= most:
            selector[:] = s
        elif WIDTHS[s] >= least:
            # The first place from each on that is too wide; 128 is the end of the block.
            stop = np.where(bits > WIDTHS[s], column, np.uint8(BLOCK))
            stop = np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1]
            selector[stop >= np.minimum(column + COUNTS[s], BLOCK).astype(np.uint8)] = s
    size = np.full(n_blocks, BLOCK)
    size[-1] = n - (n_blocks - 1) * BLOCK
    # All blocks step from word to word together; the k-th step gives the k-th word of every block still open.
    at, alive, steps = np.zeros(n_blocks, np.int64), np.arange(n_blocks), []
    while len(alive):
        here = at[alive]
        s = selector[alive, here]
        take = np.minimum(COUNTS[s], size[alive] - here)
        steps.append((alive, s, take))
        here += take
        at[alive] = here
        alive = alive[here < size[alive]]
    words_in = np.zeros(n_blocks, np.int64)
    for alive, _, _ in steps:
        words_in[alive] += 1
    offsets = np.concatenate([[0], np.cumsum(words_in)])
    s, take = np.empty(offsets[-1], np.uint8), np.empty(offsets[-1], np.int64)
    for k, (alive, chosen, taken) in enumerate(steps):
        place = offsets[alive] + k
        s[place], take[place] = chosen, taken
    offsets = offsets.astype(np.uint32)
    begins = np.concatenate([[0], np.cumsum(take)[:-1]])
    # The place of each id in its word, times the width of the word.
    shift = np.repeat(WIDTHS[s], take)
    shift *= np.arange(n) - np.repeat(begins, take)
    words = np.bitwise_or.reduceat((ids & _LOW60) << shift.view(np.uint64), begins) | (s.astype(np.uint64) << np.uint64(60))
    return words, offsets, (ids[begins[s == 0]] >> np.uint64(60)).astype(np.uint8)


def unpack(words: np.ndarray, offsets: np.ndarray, exceptions: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` integers of all blocks."""
    if not n:
        return np.empty(0, np.uint64)
    s = (words >> np.uint64(60)).astype(np.int64)
    full = COUNTS[s]
    words_in = np.diff(offsets.astype(np.int64))
    before = np.concatenate([[0], np.cumsum(full)])
    inside = before[:-1] - np.repeat(before[offsets[:-1]], words_in)
    size = np.full(len(words_in), BLOCK)
    size[-1] = n - (len(words_in) - 1) * BLOCK
    take = np.minimum(full, np.repeat(size, words_in) - inside)
    begins = np.concatenate([[0], np.cumsum(take)[:-1]])
    slot = np.arange(n) - np.repeat(begins, take)
    width = np.repeat(WIDTHS[s], take)
    mask = (np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)
    out = (np.repeat(words & _LOW60, take) >> (slot * width).astype(np.uint64)) & mask
    if len(exceptions):
        out[begins[s == 0]] |= exceptions.astype(np.uint64) << np.uint64(60)
    return out
