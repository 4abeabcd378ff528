"""Byte-level BPE: a lazily determinised transducer for encoding, an incremental state machine for decoding.

**Encoding.** A nondeterministic reader of bytes may start a token after any finished prefix. Its states are pairs of a
node in the trie of tokens and the token that ended where this one began. A pair that reaches a token ``t`` after token
``p`` may accept it only if the merge rules leave ``p`` and ``t`` side by side; then exactly one token ends at each byte.
Sets of pairs are the states of the deterministic machine. They are made when first met, and their transitions are kept.
Each state knows the one token that ends there, so a walk back over the last tokens of the bytes gives the encoding. What
lies before the oldest token still open in a state can no longer change and is emitted: the lookahead is bounded by the
reach of open tokens, not by the text.

**Decoding.** Token bytes pass through a UTF-8 state machine that holds back an unfinished character until it is complete.

The rank file is read once on the driver and sent to the tasks; its size is that of a vocabulary, not of the data.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from basecov.llm.frames import kept, with_batch_columns
from basecov.llm.remembered import IdTable, byte_level_chunks, per_text, text_pieces

#: Distinct matches whose ids a task remembers, and states of the machine, before it starts anew.
KEPT_MATCHES, KEPT_STATES = 120_000, 120_000
#: The pattern whose borders :func:`basecov.llm.remembered.byte_level_chunks` knows. Fixed value.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SETTLE_EVERY = 4096
ROOT = 0


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes and their ids from the lines of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.raw = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.children: dict[int, int] = {}  # node * 256 + byte
        self.token: dict[int, int] = {}  # of a node that ends a token
        self.depth = [0]
        nodes = 1
        for raw, i in ranks.items():
            node = ROOT
            for b in raw:
                step = node * 256 + b
                node = self.children.get(step)
                if node is None:
                    node = self.children[step] = nodes
                    nodes += 1
                    self.depth.append(self.depth[step >> 8] + 1)
            self.token[node] = i
        self.inner = {step >> 8 for step in self.children}  # nodes that a longer token goes through
        self.beside: dict[int, bool] = {}  # token before + 1 and token, packed
        self._restart()

    def _restart(self) -> None:
        # A state is its pairs, oldest start first; a pair is packed as node * 2^32 + token before + 1.
        self.states: list[tuple] = [(ROOT,)]
        self.known = {self.states[0]: 0}
        self.ended = [-1]  # the token that ends in a state
        self.steps: dict[int, int] = {}  # state * 256 + byte

    def merged(self, raw: bytes) -> list[int]:
        """Ids by the merge rules themselves: the lowest rank first, the leftmost of equals. For short byte strings."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        ranks = self.ranks
        while len(parts) > 1:
            at, best = -1, None
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    at, best = i, rank
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def may_follow(self, before: int, token: int) -> bool:
        """Whether the merge rules keep the two tokens apart. Before the first token stands -1."""
        pair = (before + 1) << 32 | token
        held = self.beside.get(pair)
        if held is None:
            ids = self.merged(self.raw[token] if before < 0 else self.raw[before] + self.raw[token])
            held = self.beside[pair] = ids == ([token] if before < 0 else [before, token])
        return held

    def step(self, state: int, byte: int) -> int:
        """The next state, determinised now if it was never needed before."""
        pairs, ended = [], -1
        for pair in self.states[state]:
            child = self.children.get((pair >> 32) * 256 + byte)
            if child is not None:
                before = (pair & 0xFFFFFFFF) - 1
                if child in self.inner:
                    pairs.append(child << 32 | before + 1)
                token = self.token.get(child)
                if token is not None and ended < 0 and self.may_follow(before, token):
                    ended = token
        if ended < 0:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        key = (*pairs, ended + 1)
        new = self.known.get(key)
        if new is None:
            new = self.known[key] = len(self.states)
            self.states.append(key)
            self.ended.append(ended)
        self.steps[state * 256 + byte] = new
        return new

    def encode(self, raw: bytes) -> list[int]:
        """Ids of one match of the split pattern, emitted as soon as no later byte can change them."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        if len(self.states) > KEPT_STATES:
            self._restart()
        if len(self.beside) > 2 * KEPT_STATES:
            self.beside.clear()
        out: list[int] = []
        last: list[int] = []  # the token that ends at each byte not yet settled
        state, steps, ended = 0, self.steps, self.ended
        for byte in raw:
            new = steps.get(state * 256 + byte)
            state = self.step(state, byte) if new is None else new
            last.append(ended[state])
            if len(last) >= SETTLE_EVERY:
                last = last[self._settle(last, state, out) :]
        self._emit(last, len(last), out)
        return out

    def _emit(self, last: list[int], end: int, out: list[int]) -> None:
        chain = []
        while end > 0:
            chain.append(last[end - 1])
            end -= self.size[last[end - 1]]
        out.extend(reversed(chain))

    def _settle(self, last: list[int], state: int, out: list[int]) -> int:
        """Emits what all tokens still open agree on; the number of settled bytes."""
        common = None
        for pair in self.states[state]:
            end, cuts = len(last) - self.depth[pair >> 32], set()
            while end > 0:
                cuts.add(end)
                end -= self.size[last[end - 1]]
            common = cuts if common is None else common & cuts
        settled = max(common or {0})
        self._emit(last, settled, out)
        return settled


class Encoder:
    """Ids of whole texts. Chunks that ``SPLIT_PATTERN`` never crosses are encoded once and remembered, and the
    transducer sees only matches that are new; for any other pattern a text is one chunk.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.cut = byte_level_chunks if pattern == SPLIT_PATTERN else _whole_texts
        self.table = IdTable(self._learn)
        self.matches: dict[str, list[int]] = {}

    def _learn(self, raw: list[bytes]) -> list[list[int]]:
        if len(self.matches) > KEPT_MATCHES:
            self.matches.clear()
        out = []
        for chunk in raw:
            ids = []
            for match in self.pattern.findall(chunk.decode("utf-8", "replace")):
                found = self.matches.get(match)
                if found is None:
                    found = self.machine.encode(match.encode())
                    if len(match) <= 64:
                        self.matches[match] = found
                ids += found
            out.append(ids)
        return out

    def encode_piece(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in ``data`` one after another, and n + 1 places at which each text's ids begin and end."""
        start, end = self.cut(data, offsets)
        ids, counts = self.table.ids(data, start, end)
        return ids, per_text(offsets, start, counts)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of one text."""
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        return self.encode_piece(data, np.array([0, len(data)]))[0].astype("<u4").tobytes()


def _whole_texts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    return offsets[filled], offsets[filled + 1]


#: Lead bytes of UTF-8: first lead, last lead, range of the byte that follows, bytes that follow in all. Fixed values.
_LEADS = (
    (0xC2, 0xDF, 0x80, 0xBF, 1),
    (0xE0, 0xE0, 0xA0, 0xBF, 2),
    (0xE1, 0xEC, 0x80, 0xBF, 2),
    (0xED, 0xED, 0x80, 0x9F, 2),
    (0xEE, 0xEF, 0x80, 0xBF, 2),
    (0xF0, 0xF0, 0x90, 0xBF, 3),
    (0xF1, 0xF3, 0x80, 0xBF, 3),
    (0xF4, 0xF4, 0x80, 0x8F, 3),
)
_LEAD = {b: (low, high, n) for a, z, low, high, n in _LEADS for b in range(a, z + 1)}


class Utf8Stream:
    """Incremental decoder: a state is the bytes still missing and the range allowed for the next one."""

    def __init__(self):
        self.held = b""
        self.replaced = 0

    def _open(self, data: bytes) -> int:
        """Bytes at the end that begin a character which later bytes may complete."""
        for back in range(1, min(3, len(data)) + 1):
            lead = _LEAD.get(data[-back])
            if lead is not None:
                low, high, missing = lead
                for b in data[len(data) - back + 1 :]:
                    if not low <= b <= high:
                        return 0
                    low, high, missing = 0x80, 0xBF, missing - 1
                return back if missing else 0
            if not 0x80 <= data[-back] <= 0xBF:
                return 0
        return 0

    def _text(self, data: bytes) -> str:
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            text = data.decode("utf-8", "replace")
            self.replaced += text.count("�") - data.count(b"\xef\xbf\xbd")
            return text

    def release(self, data: bytes) -> bytes:
        """The bytes of all characters that are complete now; the beginning of an unfinished one is held back."""
        data = self.held + data
        keep = self._open(data)
        self.held = data[len(data) - keep :] if keep else b""
        return data[: len(data) - keep]

    def rest(self) -> bytes:
        data, self.held = self.held, b""
        return data

    def feed(self, data: bytes) -> str:
        """The characters that are complete now; malformed bytes become U+FFFD."""
        return self._text(self.release(data))

    def close(self) -> str:
        return self._text(self.rest())

    def checked(self, data: bytes) -> bytes:
        """``data`` itself, with its malformed sequences counted."""
        self._text(data)
        return data


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.raw = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.raw[i] = token

    def blocks(self, ids: np.ndarray, block: int = 65_536) -> Iterator[bytes]:
        for at in range(0, len(ids), block):
            yield b"".join(map(self.raw.__getitem__, ids[at : at + block].tolist()))

    def text(self, ids: np.ndarray) -> Iterator[str]:
        """Text as it becomes complete."""
        stream = Utf8Stream()
        for data in self.blocks(ids):
            yield stream.feed(data)
        yield stream.close()

    def decode(self, ids: np.ndarray) -> tuple[bytes, int]:
        """All bytes, and how many malformed sequences a reader of text would replace."""
        stream = Utf8Stream()
        out = [stream.checked(stream.release(data)) for data in self.blocks(ids)]
        out.append(stream.checked(stream.rest()))
        return b"".join(out), stream.replaced


def _made(kind, content: bytes, *args):
    """One encoder or decoder per Python worker and stage."""
    return kept((kind.__name__, hashlib.sha256(content).digest(), *args), lambda: kind(read_ranks(content), *args))


def _id_array(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    places = pa.py_buffer((4 * bounds).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, places, pa.py_buffer(ids.astype("<u4").tobytes())])


def _arrays(rows: Iterable[tuple], types: list[pa.DataType]) -> list[pa.Array]:
    columns = list(zip(*rows))
    return [pa.array(c, t) for c, t in zip(columns, types)]


def _content(df: DataFrame, ranks_path: str):
    with open(ranks_path, "rb") as f:  # a vocabulary on the driver, beside the program
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, ranks_path: str, pattern: str, *, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) of every whole text.

    A missing or empty text has no ids. Columns with the names of the new ones are replaced, all others are kept. Rows
    are treated one by one; there is no shuffle, and memory is bounded by the longest text.
    """
    content = _content(df, ranks_path)

    def compute(column):
        encoder = _made(Encoder, content.value, pattern)
        for _, _, data, offsets in text_pieces(column):
            ids, bounds = encoder.encode_piece(data, offsets)
            yield [pa.array(np.diff(bounds)), _id_array(ids, bounds)]

    return with_batch_columns(df, text, [("n_tokens", "bigint"), ("ids", "binary")], compute)


def decode(df: DataFrame, ranks_path: str, *, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (bytes of the ids) and ``n_replaced``, the malformed sequences in them.

    Missing ids decode to no bytes. An id outside the vocabulary fails the task.
    """
    content = _content(df, ranks_path)

    def compute(column):
        decoder = _made(Decoder, content.value)
        for at in range(0, len(column), 500):
            part = column.slice(at, 500).to_pylist()
            yield _arrays((decoder.decode(np.frombuffer(x or b"", "<u4")) for x in part), [pa.binary(), pa.int64()])

    return with_batch_columns(df, ids, [("decoded", "binary"), ("n_replaced", "bigint")], compute, kind="binary")


def round_trip(df: DataFrame, ranks_path: str, pattern: str, *, text: str = "text") -> DataFrame:
    """``encode`` and then ``decode`` in one pass over the texts: ``n_tokens``, ``ids``, ``decoded``, ``n_replaced``."""
    content = _content(df, ranks_path)

    def compute(column):
        encoder, decoder = _made(Encoder, content.value, pattern), _made(Decoder, content.value)
        for _, _, data, offsets in text_pieces(column):
            ids, bounds = encoder.encode_piece(data, offsets)
            decoded = (decoder.decode(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))
            yield [pa.array(np.diff(bounds)), _id_array(ids, bounds), *_arrays(decoded, [pa.binary(), pa.int64()])]

    return with_batch_columns(df, text, [("n_tokens", "bigint"), ("ids", "binary"), ("decoded", "binary"), ("n_replaced", "bigint")], compute)
