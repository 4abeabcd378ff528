"""Benchmark decontamination by suffix arrays over the training text.

Every piece of training text is a shard with a suffix array of its own: the places of its suffixes, sorted by their first
words. All suffixes of the test items are looked up in it by binary search; a hit is extended word by word to the longest
verbatim match. Shards need nothing from each other, so the work is one pass over the documents without a shuffle.

Words are runs of ASCII letters (A-Z in lower case), digits and non-ASCII characters. A suffix array keeps only suffixes
that begin with as many test-vocabulary words as the shortest window has: others cannot match, so nothing is lost.

Test items are read in blocks of at most ``BLOCK_BYTES`` of text each (or one item). A task splits a batch of texts into
words once and holds the blocks against it one after another; of several blocks it keeps one index at a time, so any
number of items can be held against the documents in one pass and in bounded memory.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basecov.llm.frames import new_task
from basecov.llm.words import NOT_ALNUM_TABLE, Words, pieces

WINDOW = 13
BLOCK_BYTES = 16 << 20
#: Pieces of text (of a megabyte each) that one reading of the indexes serves, if there are several.
HELD_PIECES = 16
MATCHES = "array<struct<item_id: bigint, item_start: int, doc_start: int, n_words: int>>"
_MATCH_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("n_words", pa.int32())]))


class TestIndex:
    """The windows of a block of test items, as codes of a vocabulary in ascending order of the words' keys."""

    def __init__(self, ids: list[int], texts: list[str | None], window: int):
        words = list(pieces(pa.array(texts, pa.string()), NOT_ALNUM_TABLE, lower=True, limit=1 << 62))
        key = np.concatenate([w.key for w in words]) if words else np.empty(0, np.uint64)
        first = words[0].first if words else np.zeros(1, np.int64)
        self.vocabulary, code = np.unique(key, return_inverse=True)
        self.code = (code + 1).astype(np.int64)
        self.item = np.repeat(np.array(ids, np.int64), np.diff(first))
        self.begin, self.end = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
        self.length = np.minimum(window, self.end - self.begin)
        at = np.arange(len(self.code))
        self.at = at[at + self.length <= self.end]  # first words of the windows
        self.window = window
        self.least = int(self.length.min()) if len(at) else 0
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.per_key = 62 // self.bits
        self.n_keys = -(-window // self.per_key)
        # A test suffix finds the shard's suffixes between its words followed by nothing and by the highest codes.
        used = self.length[self.at]
        self.low = self.packed(self.code, self.at, used, 0)
        self.high = self.packed(self.code, self.at, used, (1 << self.bits) - 1)

    def packed(self, code: np.ndarray, at: np.ndarray, used: np.ndarray, fill: int) -> list[np.ndarray]:
        """Sort keys for the suffixes at ``at``: their first ``used`` codes, then ``fill``, several codes to an integer."""
        keys = []
        for base in range(0, self.window, self.per_key):
            out = np.zeros(len(at), np.int64)
            for k in range(base, min(base + self.per_key, self.window)):
                there = np.where(k < used, code[np.minimum(at + k, len(code) - 1)], fill) if len(code) else out
                out = (out << self.bits) | there
            keys.append(out)
        return keys


def suffix_array(index: TestIndex, words: Words) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Sorted places of the shard's suffixes, their sort keys in that order, and the code of every word (0: not in a test)."""
    code = np.searchsorted(index.vocabulary, words.key)
    code[code == len(index.vocabulary)] = 0
    code = np.where(index.vocabulary[code] == words.key, code + 1, 0)
    # Words in the vocabulary from each place on, inside its document.
    stops = np.union1d(np.flatnonzero(code == 0), words.first[1:])
    known = np.flatnonzero(code)
    run = stops[np.searchsorted(stops, known, side="right")] - known
    at, run = known[run >= index.least], run[run >= index.least]
    keys = index.packed(code, at, np.minimum(run, index.window), 0)
    order = np.lexsort(keys[::-1])
    return at[order], [k[order] for k in keys], code


def bound(keys: list[np.ndarray], probes: list[np.ndarray], after: bool) -> np.ndarray:
    """For each probe the number of sorted keys below it (``after``: not above it), by binary search."""
    n = len(keys[0])
    low, high = np.zeros(len(probes[0]), np.int64), np.full(len(probes[0]), n, np.int64)
    while n and (open_ := low < high).any():
        middle = (low + high) // 2
        less, tied = np.zeros(len(low), bool), np.ones(len(low), bool)
        for key, probe in zip(keys, probes):
            there = key[np.minimum(middle, n - 1)]
            less |= tied & (there < probe)
            tied &= there == probe
        go = less | tied if after else less
        low, high = np.where(open_ & go, middle + 1, low), np.where(open_ & ~go, middle, high)
    return low


def matches(index: TestIndex, words: Words) -> tuple[np.ndarray, ...]:
    """Longest verbatim matches of a shard: place in the test words, place in the shard's words, number of words."""
    none = (np.empty(0, np.int64),) * 3
    if not len(index.at) or not len(words.key):
        return none
    at, keys, code = suffix_array(index, words)
    low, high = bound(keys, index.low, False), bound(keys, index.high, True)
    found = high - low
    test = np.repeat(index.at, found)
    if not len(test):
        return none
    place = at[np.repeat(low - np.concatenate([[0], np.cumsum(found)[:-1]]), found) + np.arange(len(test))]
    length = index.length[test]
    # Windows one word apart in both texts are one match; keep the first of each row of them and its last word.
    order = np.lexsort((place, place - test))
    test, place, length = test[order], place[order], length[order]
    new = np.ones(len(test), bool)
    new[1:] = (np.diff(test) != 1) | (np.diff(place) != 1)
    # The last window of an item or a document and the first of the next are neighbours too, but no match.
    new[1:] |= (np.diff(index.begin[test]) != 0) | (np.diff(np.searchsorted(words.first, place, side="right")) != 0)
    heads = np.flatnonzero(new)
    last = np.append(heads[1:], len(test)) - 1
    return test[heads], place[heads], test[last] + length[last] - test[heads]


def _covered(first: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Words of each document that lie in at least one of the ranges."""
    change = np.zeros(first[-1] + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + length, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(change)[:-1] > 0)])
    return inside[first[1:]] - inside[first[:-1]]


def _lists(doc: np.ndarray, n_docs: int, columns: list[np.ndarray]) -> pa.Array:
    """One list of structs per document from rows sorted by document."""
    offsets = np.searchsorted(doc, np.arange(n_docs + 1)).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MATCH_TYPE.value_type)], fields=list(_MATCH_TYPE.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _find(index: TestIndex, w: Words) -> list[np.ndarray]:
    """The matches of a piece: document, item, first word in the item, first word in the document, number of words."""
    test, place, length = matches(index, w)
    doc = np.searchsorted(w.first, place, side="right") - 1
    return [doc, index.item[test], test - index.begin[test], place - w.first[doc], length]


def _against(df: DataFrame, blocks: list[Broadcast], names: list[str]) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = T.StructType([*[T.StructField(n, kinds[n]) for n in [*names, "__text"]], T.StructField("__n_words", T.LongType()), T.StructField("__n_hit", T.LongType()), T.StructField("__matches", T._parse_datatype_string(MATCHES))])

    def loaded(shared: Broadcast) -> TestIndex:
        # A broadcast remembers its value in the worker; with several blocks each is read from the worker's file again.
        path = getattr(shared, "_path", None)
        return shared.value if len(blocks) == 1 or path is None else shared.load_from_path(path)

    def run(batches):
        new_task()
        for batch in batches:
            left = pieces(batch.column("__text"), NOT_ALNUM_TABLE, lower=True)
            while split := list(islice(left, 1 if len(blocks) == 1 else HELD_PIECES)):
                found = [[] for _ in split]
                for shared in blocks:
                    index = loaded(shared)
                    for rows, w in zip(found, split):
                        rows.append(_find(index, w))
                    del index
                for rows, w in zip(found, split):
                    doc, *fields = [np.concatenate(x) for x in zip(*rows)]
                    order = np.lexsort((fields[1], fields[0], fields[2], doc))
                    doc, fields = doc[order], [x[order] for x in fields]
                    hit = _covered(w.first, w.first[doc] + fields[2], fields[3].astype(np.int64))
                    part = batch.slice(w.row, w.n_docs)
                    arrays = [part.column(n) for n in [*names, "__text"]]
                    arrays += [pa.array(w.count, pa.int64()), pa.array(hit, pa.int64()), _lists(doc, w.n_docs, fields)]
                    yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return df.mapInArrow(run, out)


def test_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, window: int = WINDOW):
    """Indexes over blocks of the test items (item_id, text); a block is collected alone and is bounded in size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = max(1, -(-int(size) // block_bytes))
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()
        yield TestIndex([-1 if r[0] is None else r[0] for r in rows], [r[1] for r in rows], window)


def match_benchmark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` and ``matches`` against all items of ``benchmark`` (item_id, text).

    ``matches`` lists the longest verbatim matches of at least ``window`` words (or of a whole shorter item) in order of
    their place in the document: item, first word in the item, first word in the document, number of words. ``n_hit``
    counts the document's words inside any match.

    A missing or empty text has no words and no matches; an item without words matches nothing; a missing item_id reads as
    -1; repeated rows on either side are treated one by one; with an empty benchmark every document has no match. Columns
    of ``docs`` with the names of the new ones are replaced, all others are kept.
    """
    new = ["n_words", "n_hit", "matches"]
    own = [c for c in docs.columns if c not in new]
    # a text that is a string goes to the tasks and back once
    names = [c for c in own if c != text or docs.schema[c].dataType != T.StringType()]
    df = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("__text"))
    context = docs.sparkSession.sparkContext
    df = _against(df, [context.broadcast(index) for index in test_blocks(benchmark, block_bytes, window)], names)
    return df.select(*[F.col(f"`{c}`" if c in names else "__text").alias(c) for c in own], *[F.col(f"__{c}").alias(c) for c in new])


def contaminated() -> F.Column:
    """The rule over ``n_words`` and ``n_hit``: at least a twentieth of the words lies in matches."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents of ``docs`` that are not contaminated, with their own columns only."""
    text = options.pop("text", "text")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    packed = docs.select(F.struct(*(others or [F.lit(0)])).alias("__own"), F.col(f"`{text}`").alias("__text_in"))
    kept = match_benchmark(packed, benchmark, text="__text_in", **options).where(~contaminated())
    return kept.select(*[F.col("__text_in" if c == text else f"__own.`{c}`").alias(c) for c in docs.columns])
