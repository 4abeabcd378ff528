"""Substring dedup by level-wise doubling.

A window of words can occur in two documents only if the shorter windows inside it do. So windows of about half the length
come first, and only where they repeat are windows of up to twice their length made, until the wanted length is reached
(``removable``) or until no candidates survive (``repeat_lengths``).

* The first level looks at one short window per long one, that with the smallest key among those the long window holds.
  Equal long windows choose equal short ones, so nothing is lost, and about a quarter of the short windows is shuffled.
* Windows that several documents of one Arrow batch share are settled in the task: all but the document with the smallest
  id are known to repeat, and one row for that document goes on. A passage that a third of all documents holds thus costs
  one row per batch and window, and no key has more rows than there are batches.
* Every level is one shuffle of (window key, document). Texts are dealt out by document id once per query; Spark uses that
  exchange again when the marks come back to the texts.

Whether a word goes depends on the document's id and on the window's words alone, so marks are keys of windows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basecov.llm.frames import new_task
from basecov.llm.words import Words, mix, pieces, starts_of, window_keys
from basecov.session import stored

LENGTH = 13
LOWEST = -(1 << 63)
_ROWS = "key bigint, doc bigint, marks binary"


def _chosen(w: Words, long: int, short: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all long windows, and for each the smallest key of the short windows in it."""
    at = starts_of(w.first, long)
    keys = np.zeros(len(w.key), np.uint64)
    keys[starts_of(w.first, short)] = window_keys(w.key, w.first, short)
    least = keys[at].copy()
    for k in range(1, long - short + 1):
        np.minimum(least, keys[at + k], out=least)
    return at, least


def _settled(doc_ids: np.ndarray, row: np.ndarray, key: np.ndarray, lower_only: bool):
    """Rows for one batch from (row of the batch, window key) pairs.

    Open: (key, document), one per key, for the smallest id that has it. Known: row and key of windows that a document of
    this batch shares with one of smaller id (``lower_only``) or with any other one.
    """
    order = np.lexsort((doc_ids[row], key))
    row, key = row[order], key[order]
    doc = doc_ids[row]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    heads = np.flatnonzero(head)
    lowest = np.repeat(doc[heads], np.diff(np.append(heads, len(key))))
    known = doc > lowest
    if not lower_only:
        known = np.repeat(np.logical_or.reduceat(known, heads) if len(heads) else known, np.diff(np.append(heads, len(key))))
    return (key[heads], doc[heads]), (row[known], key[known])


def _emit(doc_ids: np.ndarray, row: np.ndarray, key: np.ndarray, lower_only: bool):
    """Arrow rows of one batch: open windows with a key, known ones as one row of marks per document."""
    (open_key, open_doc), (known_row, known_key) = _settled(doc_ids, row, key, lower_only)
    pairs = np.unique(np.stack([known_row.astype(np.uint64), known_key]), axis=1) if len(known_row) else np.empty((2, 0), np.uint64)
    rows, begins = np.unique(pairs[0], return_index=True)
    ends = np.append(begins[1:], pairs.shape[1])
    marks = [pairs[1, a:b].tobytes() for a, b in zip(begins, ends)]
    names = ["key", "doc", "marks"]
    for low in range(0, len(open_key), 1 << 16):
        part = slice(low, low + (1 << 16))
        n = len(open_key[part])
        yield pa.RecordBatch.from_arrays([pa.array(open_key[part].view(np.int64)), pa.array(open_doc[part]), pa.nulls(n, pa.binary())], names=names)
    for low in range(0, len(rows), 1000):
        part = slice(low, low + 1000)
        docs = doc_ids[rows[part].astype(np.int64)]
        # Known rows need no partner: a key of their own only spreads them.
        own = mix(docs.astype(np.uint64) + np.uint64(low)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(docs), pa.array(marks[part], pa.binary())], names=names)


def _level(texts: DataFrame, find: Callable, lower_only: bool) -> DataFrame:
    """Marks per document (doc, packed: lists of keys as bytes, singles: keys) from windows that ``find`` yields for each piece of a batch.

    ``texts``: doc, text and, for all levels but the first, the marks of the level before.
    """

    def run(batches):
        new_task()
        for batch in batches:
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
            before = batch.column(2) if batch.num_columns > 2 else None
            rows, keys = [], []
            for w in pieces(batch.column(1)):
                row, key = find(w, before)
                # One of each window in a document is enough.
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                new = np.ones(len(key), bool)
                new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
                rows.append(row[new])
                keys.append(key[new])
            if keys:
                yield from _emit(doc_ids, np.concatenate(rows), np.concatenate(keys), lower_only)

    found = texts.mapInArrow(run, _ROWS)
    by_key, open_doc = W.partitionBy("key"), F.when(F.col("marks").isNull(), F.col("doc"))
    judged = found.withColumn("low", F.min(open_doc).over(by_key)).withColumn("high", F.max(open_doc).over(by_key))
    repeats = F.col("doc") > F.col("low") if lower_only else F.col("high") > F.col("low")
    kept = judged.where(F.col("marks").isNotNull() | repeats)
    single = F.when(F.col("marks").isNull(), F.col("key"))
    return kept.groupBy("doc").agg(F.collect_list("marks").alias("packed"), F.collect_list(single).alias("singles"))


def _marks(before: pa.StructArray, row: int) -> np.ndarray:
    """The window keys that came back for a row, sorted."""
    value = before[row]
    if not value.is_valid:
        return np.empty(0, np.uint64)
    packed = b"".join(x.as_py() for x in value["packed"]) if value["packed"].is_valid else b""
    singles = value["singles"].values.to_numpy() if value["singles"].is_valid else np.empty(0, np.int64)
    return np.unique(np.concatenate([np.frombuffer(packed, np.uint64), singles.view(np.uint64)]))


def _holds(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(marks):
        return np.zeros(len(keys), bool)
    return marks[np.minimum(np.searchsorted(marks, keys), len(marks) - 1)] == keys


def _first_level(long: int, short: int) -> Callable:
    def find(w: Words, _):
        at, least = _chosen(w, long, short)
        return w.row + np.searchsorted(w.first, at, side="right") - 1, least

    return find


def _next_level(long: int, test: Callable) -> Callable:
    """Windows of ``long`` words where ``test`` (words of the piece, places) finds the level before repeated."""

    def find(w: Words, before: pa.StructArray):
        at, key = w.windows(long)
        doc = np.searchsorted(w.first, at, side="right") - 1
        passed = test(w, at, doc, before)
        return w.row + doc[passed], key[passed]

    return find


def _by_document(w: Words, doc: np.ndarray, keys: list[np.ndarray], before: pa.StructArray) -> np.ndarray:
    """For each place whether all its keys are among the marks of its document."""
    out = np.zeros(len(doc), bool)
    bounds = np.searchsorted(doc, np.arange(w.n_docs + 1))
    for i in range(w.n_docs):
        low, high = bounds[i], bounds[i + 1]
        if low < high:
            marks = _marks(before, w.row + i)
            out[low:high] = np.logical_and.reduce([_holds(marks, k[low:high]) for k in keys])
    return out


def _chosen_repeats(long: int, short: int) -> Callable:
    return lambda w, at, doc, before: _by_document(w, doc, [_chosen(w, long, short)[1]], before)


def _both_ends_repeat(long: int, short: int) -> Callable:
    """The windows of ``short`` words at both ends repeat; together they cover the long window."""

    def test(w, at, doc, before):
        keys = np.zeros(len(w.key), np.uint64)
        keys[starts_of(w.first, short)] = window_keys(w.key, w.first, short)
        return _by_document(w, doc, [keys[at], keys[at + long - short]], before)

    return test


def _with_marks(texts: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Each use takes all columns of ``texts``, so that all uses share one exchange."""
    others = [c for c in texts.columns if c not in ("doc", "text")]
    return texts.join(marks, "doc", how).select("doc", "text", F.struct("packed", "singles").alias("before"), *others)


def _dealt(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Texts by document id, in as many partitions as shuffles have; each use in a query is the same exchange."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _plain(docs, doc_id, text).repartition(parts, "doc")


def _plain(docs: DataFrame, doc_id: str, text: str, *others: Column) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LOWEST)).alias("doc"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), *others)


def _removal_marks(plain: DataFrame, dealt: DataFrame, length: int) -> DataFrame:
    """Per document the windows of ``length`` words that also start in a document with a smaller id."""
    short = (length + 1) // 2
    first = _level(plain, _first_level(length, short), lower_only=False)
    return _level(_with_marks(dealt, first, "inner"), _next_level(length, _chosen_repeats(length, short)), lower_only=True)


def removable(docs: DataFrame, *, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", layout: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row.

    A word is removed if a window of ``length`` consecutive words that covers it also starts in a row with a smaller id.
    Windows are judged on the input. ``kept`` has the other words joined by one space, or with ``layout`` the text without
    the removed words and the white space behind each. Words are runs of anything but the six white-space characters.
    A missing or empty text has no words and keeps "". A missing id counts as the lowest 64-bit integer; rows with equal
    ids take nothing from each other. An empty table gives no rows.
    """
    plain, dealt = _plain(docs, doc_id, text), _dealt(docs, doc_id, text)
    found = _with_marks(dealt, _removal_marks(plain, dealt, length), "left")

    def run(batches):
        new_task()
        for batch in batches:
            before = batch.column(2)
            for w in pieces(batch.column(1)):
                gone = _gone(w, before, length)
                removed = np.concatenate([[0], np.cumsum(gone)])
                kept = _without(w, gone) if layout else _joined(w, gone)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.row, w.n_docs), pa.array(w.count, pa.int64()), pa.array(removed[w.first[1:]] - removed[w.first[:-1]]), kept], names=["doc", "n_words", "n_removed", "kept"])

    out = found.mapInArrow(run, "doc bigint, n_words bigint, n_removed bigint, kept string")
    return out.select(F.nullif("doc", F.lit(LOWEST)).alias("doc_id"), "n_words", "n_removed", "kept")


def _gone(w: Words, before: pa.StructArray, length: int) -> np.ndarray:
    """For each word whether a marked window covers it."""
    at, key = w.windows(length)
    doc = np.searchsorted(w.first, at, side="right") - 1
    begins = at[_by_document(w, doc, [key], before)]
    change = np.zeros(len(w.key) + 1, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, begins + length, -1)
    return np.cumsum(change)[:-1] > 0


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.string())


def _spread(w: Words, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mask of the bytes from the starts of the chosen words to ``ends``."""
    change = np.zeros(len(w.data) + 1, np.int8)
    np.add.at(change, w.start[words], 1)
    np.add.at(change, ends[words], -1)
    return np.cumsum(change, dtype=np.int8)[:-1] > 0


def _after(w: Words) -> np.ndarray:
    """Where the next word of the same document begins, or the document ends."""
    out = np.append(w.start[1:], len(w.data))
    has = np.flatnonzero(w.count)
    out[w.first[has + 1] - 1] = w.offsets[has + 1]
    return out


def _without(w: Words, gone: np.ndarray) -> pa.Array:
    stay = ~_spread(w, np.flatnonzero(gone), _after(w))
    sums = np.concatenate([[0], np.cumsum(stay)])
    return _strings(w.data[stay], sums[w.offsets])


def _joined(w: Words, gone: np.ndarray) -> pa.Array:
    """Kept words of each document, one space between two of them."""
    words = np.flatnonzero(~gone)
    doc = np.searchsorted(w.first, words, side="right") - 1
    size = w.end[words] - w.start[words]
    spaced = np.zeros(len(words), np.int64)
    spaced[:-1] = doc[1:] == doc[:-1]
    out = np.full(int((size + spaced).sum()), 0x20, np.uint8)
    ends = np.cumsum(size + spaced)
    place = np.repeat(ends - size - spaced - w.start[words], size) + (inside := np.flatnonzero(_spread(w, words, w.end)))
    out[place] = w.data[inside]
    bounds = np.searchsorted(doc, np.arange(w.n_docs + 1))
    return _strings(out, np.concatenate([[0], ends])[bounds])


def cut_repeats(docs: DataFrame, *, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with the repeated words cut from the text and the character count made anew.

    All rows stay, also those whose text becomes empty; texts without repeats are untouched. The other columns travel with
    the texts.
    """
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    carried = F.struct(others, F.col(f"`{text}`").isNull().alias("missing")).alias("own")
    dealt = _plain(docs, doc_id, text, carried).repartition(parts, "doc")
    rows = _with_marks(dealt, _removal_marks(_plain(docs, doc_id, text), dealt, length), "left")
    out = T.StructType([rows.schema["own"], T.StructField("text", T.StringType())])

    def run(batches):
        new_task()
        for batch in batches:
            for w in pieces(batch.column(1)):
                own = batch.column(3).slice(w.row, w.n_docs)
                kept = _without(w, _gone(w, batch.column(2), length))
                kept = pc.if_else(pc.struct_field(own, "missing"), pa.scalar(None, pa.string()), kept)
                yield pa.RecordBatch.from_arrays([own, kept], names=["own", "text"])

    cut = rows.mapInArrow(run, out)
    counted = F.char_length("text").cast(docs.schema[n_chars].dataType) if n_chars in docs.columns else None
    columns = {text: F.col("text").alias(text), n_chars: counted.alias(n_chars) if counted is not None else None}
    return cut.select(*[columns.get(c) if columns.get(c) is not None else F.col(f"own.row.`{c}`").alias(c) for c in docs.columns])


def repeat_lengths(docs: DataFrame, *, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, length``: the longest window of ``length``, twice, four times that .. words that another document holds too.

    Doubles the windows until no candidates survive. Documents without a repeated window of ``length`` words, missing
    and empty texts have no row. Each level is written, so that the next one starts from it.
    """
    plain, dealt = _plain(docs, doc_id, text), _dealt(docs, doc_id, text)
    short = (length + 1) // 2
    first = _level(plain, _first_level(length, short), lower_only=False)
    level = _level(_with_marks(dealt, first, "inner"), _next_level(length, _chosen_repeats(length, short)), lower_only=False)
    found = None
    while True:
        level = stored(level, "repeats")
        if found is not None and level.isEmpty():
            break
        here = level.select("doc", F.lit(length).alias("length"))
        found = here if found is None else found.union(here)
        level = _level(_with_marks(dealt, level, "inner"), _next_level(2 * length, _both_ends_repeat(2 * length, length)), lower_only=False)
        length *= 2
    return found.groupBy("doc").agg(F.max("length").alias("length")).select(F.nullif("doc", F.lit(LOWEST)).alias("doc_id"), "length")
