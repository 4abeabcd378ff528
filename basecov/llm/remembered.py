"""Ids of many chunks of text at once: each distinct chunk is encoded once and found again by its key.

Tokenizers split a text at places that a look at the bytes can tell. The chunks between such places repeat a lot, so an
Arrow batch is encoded by numpy: places of the chunks, a key for each, a table of fixed size from keys to ids, and one
gather of the ids. Only chunks that the table does not hold reach the encoder, each distinct one of them once.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from basecov.llm.frames import kept
from basecov.llm.words import PIECE_BYTES, cuts, keys_of, separators, split_words, text_buffers

SLOTS = 1 << 22
STORE_IDS = 1 << 24

_WHITE = separators((0x20, *range(0x09, 0x0E)))
#: ASCII that no tokenizer takes for white space; separators 1C-1F are white to some.
_SOLID_ASCII = separators([b for b in range(0x80) if b != 0x20 and not 0x09 <= b <= 0x0D and not 0x1C <= b <= 0x1F])
#: First bytes of characters that are not white: besides ASCII all lead bytes but those under which Unicode has white space.
_SOLID_LEAD = _SOLID_ASCII | separators([b for b in range(0xC3, 0xF5) if b not in (0xE1, 0xE2, 0xE3)])
#: White space at which a tokenizer that drops white space may be cut.
LINE_WHITE = separators((0x20, 0x09, 0x0A, 0x0D))
_ALNUM = separators([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)])
_PUNCT = separators([b for b in range(0x21, 0x7F)]) & ~_ALNUM
#: Punctuation that no split pattern takes into one match with the letters after it.
_PUNCT_BEFORE = _PUNCT & ~separators([0x27])


def _punctuation_borders(data: np.ndarray) -> np.ndarray:
    """Where (from the second byte on) ASCII punctuation follows a letter or digit, or one of these follows it."""
    alnum, punct = _ALNUM[data], _PUNCT[data]
    return (alnum[:-1] & punct[1:]) | (_PUNCT_BEFORE[data[:-1]] & alnum[1:])


def byte_level_chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of chunks that a byte-level split pattern (runs of letters, digits, others, white space) never crosses.

    Such a pattern always has a border before white space that follows a character which is not white, before a
    space followed by one (of a run of white space all but the last stand together, and the last space joins the word),
    and between letters or digits and other signs, but for contractions. Texts are covered by their chunks; offsets begin at 0.
    """
    white, n = _WHITE[data], len(data)
    begins = np.zeros(n, bool)
    begins[1:] = (white[1:] & _SOLID_ASCII[data[:-1]]) | _punctuation_borders(data)
    begins[:-1] |= (data[:-1] == 0x20) & _SOLID_LEAD[data[1:]]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    lasts = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    # what follows the last character of a text is another text
    if n:
        before = data[np.maximum(lasts, 1) - 1]
        begins[lasts] = (white[lasts] & _SOLID_ASCII[before]) | (_ALNUM[before] & _PUNCT[data[lasts]]) | (_PUNCT_BEFORE[before] & _ALNUM[data[lasts]])
    begins[starts] = True
    start = np.flatnonzero(begins)
    return start, np.append(start[1:], n)


def words_between_white(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of chunks for tokenizers that drop white space and keep letters or digits apart from other signs."""
    start, end = split_words(data, offsets, LINE_WHITE)
    if len(data) < 2:
        return start, end
    inner = np.flatnonzero(_punctuation_borders(data)) + 1
    inner = inner[~np.isin(inner, start, assume_unique=True)]
    return np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))


class IdTable:
    """Ids by chunk. ``encode`` gets the bytes of distinct chunks and returns their ids as sequences of integers.

    A slot of the table holds the last chunk with its key's low bits, so frequent chunks are nearly always there and
    memory does not grow. Keys have 64 bits; the length is compared as well.
    """

    def __init__(self, encode: Callable[[list[bytes]], list], slots: int = SLOTS, store_ids: int = STORE_IDS):
        self.encode, self.mask, self.store_ids = encode, np.uint64(slots - 1), store_ids
        self.key = np.zeros(slots, np.uint64)
        self.size = np.full(slots, -1, np.int32)
        self.at = np.zeros(slots, np.int32)
        self.n = np.zeros(slots, np.int32)
        self.store, self.used = np.zeros(1 << 16, np.uint32), 0

    def _append(self, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks, one after another, and the number of ids of each chunk."""
        if self.used > self.store_ids:
            self.size[:] = -1
            self.store, self.used = np.zeros(1 << 16, np.uint32), 0
        key, size = keys_of(data, start, end), (end - start).astype(np.int32)
        slot = (key & self.mask).astype(np.int64)
        at, n = self.at[slot], self.n[slot]
        missed = np.flatnonzero((self.key[slot] != key) | (self.size[slot] != size))
        if len(missed):
            new, first, which = np.unique(key[missed], return_index=True, return_inverse=True)
            held = missed[first]
            found = self.encode([data[a:b].tobytes() for a, b in zip(start[held].tolist(), end[held].tolist())])
            counts = np.fromiter(map(len, found), np.int64, len(found))
            places = self.used + np.cumsum(counts) - counts
            self._append(np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum())))
            at[missed], n[missed] = places[which], counts[which]
            slots = slot[held]
            self.key[slots], self.size[slots], self.at[slots], self.n[slots] = new, size[held], places, counts
        n = n.astype(np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.store[np.repeat(at - (ends - n), n) + np.arange(total)], n


def per_text(offsets: np.ndarray, start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """n + 1 places in the ids: where the ids of each text begin and end."""
    sums = np.concatenate([[0], np.cumsum(counts)])
    return sums[np.searchsorted(start, offsets)]


class LibraryEncoder:
    """Ids of texts by a ``tokenizers`` file, read as ``chunks`` says the texts may be cut.

    ``added_tokens``: the strings of added tokens in a text are those tokens, as the library reads them by default; a
    text that holds one goes to the library whole. Else they are ordinary text.
    """

    def __init__(self, content: str, chunks: Callable = words_between_white, added_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel units
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = not added_tokens
        self.chunks, self.added, self.all_whole = chunks, None, False
        if added_tokens and (tokens := json.loads(content).get("added_tokens")):
            # A token that is looked for in normal forms can come from other strings; then every text is whole.
            self.all_whole = any(t["normalized"] for t in tokens)
            self.added = re.compile(b"|".join(re.escape(t["content"].encode()) for t in tokens))
        self.table = IdTable(self._learn)

    def _learn(self, raw: list[bytes]) -> list[list[int]]:
        texts = [r.decode("utf-8", "replace") for r in raw]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _places(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        filled = np.flatnonzero(offsets[1:] > offsets[:-1])
        if self.all_whole:
            return offsets[filled], offsets[filled + 1]
        start, end = self.chunks(data, offsets)
        if self.added is None or not (hits := [m.start() for m in self.added.finditer(data.tobytes())]):
            return start, end
        whole = np.unique(np.searchsorted(offsets, hits, side="right") - 1)
        rest = ~np.isin(np.searchsorted(offsets, start, side="right") - 1, whole)
        return np.sort(np.concatenate([start[rest], offsets[whole]])), np.sort(np.concatenate([end[rest], offsets[whole + 1]]))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in ``data`` one after another, and n + 1 places at which each text's ids begin and end."""
        start, end = self._places(data, offsets)
        ids, counts = self.table.ids(data, start, end)
        return ids, per_text(offsets, start, counts)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with one more id at the end of each."""
    n = len(bounds) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
    return out, bounds + np.arange(n + 1)


def text_pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes and offsets of each piece of a column of texts."""
    data, offsets = text_buffers(column)
    for low, high in cuts(offsets, limit):
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]


def library_encoder(content: str, chunks: Callable, added_tokens: bool) -> LibraryEncoder:
    """One encoder per Python worker and stage."""
    key = (LibraryEncoder.__name__, zlib.crc32(content.encode()), len(content), chunks.__name__, added_tokens)
    return kept(key, lambda: LibraryEncoder(content, chunks, added_tokens))
