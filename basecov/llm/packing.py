"""Best-fit packing of documents into sequences of a fixed length, by hierarchical residual packing.

1. Texts become ids with an end id. A document longer than a sequence is cut; its first piece takes the remainder, all
   others fill a sequence each. Whole sequences are done.
2. The other pieces are dealt to nodes of about ``PER_NODE`` items by a hash of their number. A node packs its items by
   best fit, longest first, and emits the bins that are nearly full.
3. Its underfull bins are items of the next round, in which a node takes as many bins as ``FAN_IN`` nodes have left; its
   best fit puts small bins into the gaps of others. A bin moves as a whole, so a round only tells which bin it went to and how far in it lies. A
   node carries at most ``CARRIED`` bins, the emptiest; fuller ones are closed as they are, so no group grows with the data.
4. The rounds are composed from the last to the first, in tables that hold underfull bins only, and joined to the pieces.

A bin bears the number of its first item. Items are numbered by the task that makes them, and the table is written before
anything depends on the numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basecov.llm.frames import new_task, schema_of
from basecov.llm.remembered import byte_level_chunks, library_encoder, text_pieces, with_end
from basecov.session import stored

SEQUENCE = 1024
PER_NODE = 200_000
FAN_IN = 8
CARRIED = 25_000
#: A bin with at most this share of its room free is nearly full.
SLACK = 1 / 128

PIECES = [("doc_id", "bigint"), ("item", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint")]
_ROUND = "item BIGINT, bin BIGINT, offset BIGINT, fill BIGINT, open BOOLEAN"


def cut_lengths(length: int, sequence: int) -> list[int]:
    """Lengths of the pieces of a document: the first one takes the remainder."""
    whole, rest = divmod(length, sequence)
    return [rest] * (rest > 0) + [sequence] * whole


def token_pieces(docs: DataFrame, tokenizer_path: str, *, end_id: int, sequence: int = SEQUENCE, text: str = "text", doc_id: str = "doc_id", added_tokens: bool = False, with_ids: bool = False) -> DataFrame:
    """Pieces of all texts: ``doc_id, item`` (a number of its own)``, piece, start, length, ids_crc32`` and, on request, ``ids``.

    A missing or empty text has the end id alone. A missing doc_id stays missing; repeated rows are documents of their
    own. An empty table has no pieces; other columns play no part. ``added_tokens``: strings of the tokenizer's added
    tokens in a text are read as those tokens.
    """
    with open(tokenizer_path, encoding="utf-8") as f:  # a vocabulary on the driver, beside the program
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    fields = PIECES + [("ids", "binary")] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new_task()
        encoder = library_encoder(content.value, byte_level_chunks, added_tokens)
        item = TaskContext.get().partitionId() << 40
        for batch in batches:
            for low, high, data, offsets in text_pieces(batch.column(1)):
                ids, bounds = with_end(*encoder.encode(data, offsets), end_id)
                raw = memoryview(ids.astype("<u4").tobytes())
                owner, piece, start, length, crc, packed = [], [], [], [], [], []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    at = a
                    for number, n in enumerate(cut_lengths(b - a, sequence)):
                        own = raw[4 * at : 4 * (at + n)]
                        owner.append(low + i)
                        piece.append(number)
                        start.append(at - a)
                        length.append(n)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            packed.append(bytes(own))
                        at += n
                columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(np.arange(item, item + len(owner))), pa.array(piece, pa.int32())]
                columns += [pa.array(x, pa.int64()) for x in (start, length, crc)] + [pa.array(packed, pa.binary())] * with_ids
                item += len(owner)
                yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in fields])

    return rows.mapInArrow(run, schema_of(fields))


def best_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: the bin of each item (its first item's place), the item's offset, and the fill of its bin.

    Open bins stand in one list per free length; a bit set of the free lengths in use finds the tightest bin at once.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(room + 1)]
    used = 0  # bit f: a bin with f free
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fitting = used >> n
        if n and fitting:
            left = n + (fitting & -fitting).bit_length() - 1
            held = free[left]
            bin_ = held.pop()
            if not held:
                used ^= 1 << left
            bins[i], offsets[i] = bin_, room - left
            left -= n
        else:
            bin_, left = i, room - n
            bins[i] = i
        fills[bin_] = room - left
        if left:
            free[left].append(bin_)
            used |= 1 << left
    return bins, offsets, fills[bins]


def _still_open(bins: np.ndarray, fills: np.ndarray, least_free: int, room: int, carried: int) -> np.ndarray:
    """Whether an item's bin goes on: not nearly full, and among the emptiest ``carried``."""
    first = np.flatnonzero(bins == np.arange(len(bins)))
    first = first[room - fills[first] > least_free]
    if len(first) > carried:
        first = first[np.argsort(fills[first], kind="stable")[:carried]]
    going = np.zeros(len(bins), bool)
    going[first] = True
    return going[bins]


def _round(items: DataFrame, node: F.Column, room: int, slack: float, carried: int) -> DataFrame:
    """One round of best fit in every node: ``item, bin, offset, fill, open``."""

    def pack(table: pa.Table) -> pa.Table:
        item, length = (table.column(c).to_numpy() for c in ("item", "length"))
        order = np.argsort(item, kind="stable")  # rows arrive in any order
        item = item[order]
        bins, offsets, fills = best_fit(length[order], room)
        going = _still_open(bins, fills, int(room * slack), room, carried)
        return pa.table({"item": item, "bin": item[bins], "offset": offsets, "fill": fills, "open": going})

    return items.select("item", "length", node.alias("node")).groupBy("node").applyInArrow(pack, _ROUND)


def pack(pieces: DataFrame, sequence: int = SEQUENCE, *, per_node: int = PER_NODE, fan_in: int = FAN_IN, carried: int = CARRIED, slack: float = SLACK) -> DataFrame:
    """``pieces`` (with ``item`` and ``length``) with ``sequence_id`` and ``offset``, their place in a sequence.

    Items must have numbers of their own and at most ``sequence`` ids; ``pieces`` must be a written table. Whole
    sequences stay alone. Columns with the names of the new ones are replaced.
    """
    if per_node < 1 or fan_in < 2:
        raise ValueError("a node needs items, and a merge two nodes")
    pieces = pieces.drop("sequence_id", "offset")
    items = pieces.where(F.col("length") < sequence).select("item", "length")
    nodes = max(1, -(-items.count() // per_node))
    node = F.pmod(F.xxhash64("item"), F.lit(nodes))
    rounds = [stored(_round(items, node, sequence, slack, carried), "packing")]
    while nodes > 1:
        nodes = -(-nodes // fan_in)
        opened = rounds[-1].where("open AND item = bin").select("item", F.col("fill").alias("length"))
        rounds.append(stored(_round(opened, F.pmod(F.xxhash64("item"), F.lit(nodes)), sequence, slack, carried), "packing"))
    placed = rounds[-1].select("item", "bin", "offset")
    for earlier in reversed(rounds[:-1]):
        moved = placed.select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("offset").alias("further"))
        placed = earlier.select("item", "bin", "offset").join(moved, "bin", "left").select("item", F.coalesce("to", "bin").alias("bin"), (F.col("offset") + F.coalesce("further", F.lit(0))).alias("offset"))
    placed = placed.withColumnsRenamed({"bin": "__bin", "offset": "__offset"})
    columns = [F.col(f"`{c}`") for c in pieces.columns]
    return pieces.join(placed, "item", "left").select(*columns, F.coalesce("__bin", "item").alias("sequence_id"), F.coalesce("__offset", F.lit(0)).cast("long").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, n_pieces, ids``: the ids of every sequence, from packed pieces with ``ids``."""
    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.count("*").alias("n_pieces"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.expr("aggregate(parts, CAST('' AS BINARY), (all, p) -> concat(all, p.ids))")
    return parts.select("sequence_id", "n_tokens", "n_pieces", joined.alias("ids"))


def pack_documents(docs: DataFrame, tokenizer_path: str, *, end_id: int, sequence: int = SEQUENCE, with_ids: bool = False, per_node: int = PER_NODE, fan_in: int = FAN_IN, carried: int = CARRIED, slack: float = SLACK, **options) -> DataFrame:
    """Pieces of all texts (see :func:`token_pieces`) with their places in sequences (see :func:`pack`)."""
    pieces = stored(token_pieces(docs, tokenizer_path, end_id=end_id, sequence=sequence, with_ids=with_ids, **options), "pieces")
    return pack(pieces, sequence, per_node=per_node, fan_in=fan_in, carried=carried, slack=slack)
