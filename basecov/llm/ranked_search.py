"""Ranked lexical search, term at a time with a limit on accumulators.

1. A pass over the documents keeps, of each text, its number of terms and how often it has each term of the queries
   (a row per document, written to the shared folder). Collection counts (documents, terms, documents per query term)
   are summed from it.
2. A second pass reads these rows in shards of about ``SHARD_POSTINGS`` postings and inverts each in memory. A query goes
   through a shard one term at a time, rarest first, adding to one accumulator per document. Every term has a bound in the
   shard: its weight times its largest part. Once the bounds of the terms still to come cannot lift a new document to the
   k-th partial score (or to the k-th score the task has already found), no accumulator is created any more; the ones
   that can still reach that score are updated exactly to the end, the others are given up.
3. Every task reports its best k documents of each query, ties by the smaller id; these are reduced in two steps.

All numbers but the logarithm in a term's weight are 64-bit integers, so scores do not depend on the order of adding.
Queries come in blocks of at most ``BLOCK_BYTES`` of text (or one query); what is sent to the tasks, and the counts that
come back to the driver (one per query term), are bounded by that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basecov.llm.frames import mapped, new_task, schema_of
from basecov.llm.words import NOT_ALNUM_TABLE, Words, pieces
from basecov.session import stored

TOP = 10
BLOCK_BYTES = 8 << 20
SHARD_POSTINGS = 2_000_000
SALTS = 64
LOWEST = -(1 << 63)
#: Fixed numbers of the score: its scale, the parts of the length in a hundred, and the saturation in thousandths.
SCALE, LENGTH_SHARE, SATURATION = 1_000_000_000, 75, 8

_POSTINGS = [("doc_id", "bigint"), ("n_terms", "bigint"), ("terms", "binary"), ("counts", "binary")]
_FOUND = [("query", "bigint"), ("doc_id", "bigint"), ("score", "bigint")]


class Queries:
    """The terms of a block of queries, numbered in the order of their keys."""

    def __init__(self, numbers: list[int], texts: list[str | None]):
        words = list(pieces(pa.array(texts, pa.string()), NOT_ALNUM_TABLE, lower=True, limit=1 << 62))
        key = np.concatenate([w.key for w in words]) if words else np.empty(0, np.uint64)
        size = np.concatenate([w.end - w.start for w in words]) if words else np.empty(0, np.int64)
        first = words[0].first if words else np.zeros(1, np.int64)
        self.key, place, code = np.unique(key, return_index=True, return_inverse=True)
        self.size = size[place]
        #: Per query with terms: its number, its terms and how often it has each.
        self.queries = [(n, *np.unique(code[a:b], return_counts=True)) for n, a, b in zip(numbers, first[:-1], first[1:]) if b > a]

    def codes(self, words: Words) -> np.ndarray:
        """The number of each word's term, -1 for words of no query."""
        if not len(self.key):
            return np.full(len(words.key), -1)
        at = np.searchsorted(self.key, words.key)
        at[at == len(self.key)] = 0
        return np.where((self.key[at] == words.key) & (self.size[at] == words.end - words.start), at, -1)


def _slices(rows: np.ndarray, n: int, values: np.ndarray) -> pa.Array:
    """The values of each of n rows as bytes; ``rows`` ascends."""
    places = (values.itemsize * np.searchsorted(rows, np.arange(n + 1))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(places.tobytes()), pa.py_buffer(values.tobytes())])


def postings(docs: DataFrame, queries: Queries, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document its id, its number of terms, and the query terms it has with their counts (unsigned 32-bit each)."""
    shared = docs.sparkSession.sparkContext.broadcast(queries)
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def compute(batch):
        known = shared.value
        for w in pieces(batch.column(1), NOT_ALNUM_TABLE, lower=True):
            code = known.codes(w)
            hit = np.flatnonzero(code >= 0)
            width = max(1, len(known.key))
            pair, count = np.unique(w.doc()[hit] * width + code[hit], return_counts=True)
            doc = pair // width
            yield [batch.column(0).slice(w.row, w.n_docs), pa.array(w.count, pa.int64()), _slices(doc, w.n_docs, (pair % width).astype("<u4")), _slices(doc, w.n_docs, count.astype("<u4"))]

    return mapped(source, [("doc_id", "bigint"), ("text", "string")], _POSTINGS, compute)


def _document_counts(rows: DataFrame, n_terms: int) -> np.ndarray:
    """Documents per query term: one partial sum per task, then a sum per term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new_task()
        sums = np.zeros(n_terms, np.int64)
        for batch in batches:
            sums += np.bincount(_flat(batch.column(0))[0], minlength=n_terms)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], names=["term", "n"])

    out = np.zeros(n_terms, np.int64)
    for r in rows.select("terms").mapInArrow(count, "term BIGINT, n BIGINT").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All unsigned 32-bit integers of a column of bytes, and how many each row has."""
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.empty(0, np.uint8)
    return np.frombuffer(values.tobytes(), "<u4").astype(np.int64), np.diff(at) // 4


def length_norm(n: np.ndarray, n_docs: int, n_all: int) -> np.ndarray:
    """100 - 75 + ((75 * n * documents) div terms), also where the product passes 64 bits."""
    if len(n) and LENGTH_SHARE * int(n.max()) * n_docs >= 1 << 63:
        return np.array([100 - LENGTH_SHARE + LENGTH_SHARE * int(x) * n_docs // n_all for x in n], np.int64)
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * n.astype(np.int64) * n_docs) // max(1, n_all)


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Shard:
    """Postings of a number of documents, inverted: per term its documents and their parts of the score."""

    def __init__(self, n_terms: int, counts: np.ndarray, term: np.ndarray, tf: np.ndarray, norm: np.ndarray):
        doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        part = (SCALE * tf) // (1000 * tf + SATURATION * norm[doc])
        order = np.argsort(term, kind="stable")
        self.n_docs, self.doc, self.part = len(counts), doc[order], part[order]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=n_terms))])
        self.most = np.zeros(n_terms, np.int64)
        filled = np.flatnonzero(np.diff(self.begin))
        if len(filled):
            self.most[filled] = np.maximum.reduceat(self.part, self.begin[filled])
        self.sums = np.zeros(self.n_docs, np.int64)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may be among the best k, their exact scores, and how many terms could create accumulators.

        ``terms`` are in the order in which they are taken. Documents below ``floor``, a score that k documents elsewhere
        have already, may be missing.
        """
        bounds = weights * self.most[terms]
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)
        if rest[0] < floor or not rest[0]:
            return np.empty(0, np.int64), np.empty(0, np.int64), 0
        sums, alive = self.sums, None
        for j, (term, weight) in enumerate(zip(terms.tolist(), weights.tolist())):
            low, high = self.begin[term], self.begin[term + 1]
            if low == high or not weight:
                continue
            docs, parts = self.doc[low:high], self.part[low:high]
            if alive is None:
                sums[docs] += weight * parts
                if rest[j + 1] and rest[j + 1] < (reached := max(floor, self._kth(k))):
                    # A document without an accumulator cannot reach the k-th partial score any more.
                    alive, created = np.flatnonzero(sums + rest[j + 1] >= reached), j + 1
                    alive = alive[sums[alive] > 0]
            else:
                at = np.searchsorted(docs, alive)
                at[at == len(docs)] = 0
                hit = docs[at] == alive
                sums[alive[hit]] += weight * parts[at[hit]]
        if alive is None:
            alive, created = np.flatnonzero(sums), len(terms)
        scores = sums[alive].copy()
        sums[:] = 0
        return alive, scores, created

    def _kth(self, k: int) -> int:
        """The k-th largest partial score, 0 where fewer documents have one."""
        return int(np.partition(self.sums, self.n_docs - k)[self.n_docs - k]) if k <= self.n_docs else 0


def _top(docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((docs, -scores))[:k]
    return docs[order], scores[order]


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[np.ndarray]]:
    """Columns (ids, numbers of terms, postings per document, terms, counts) of about ``limit`` postings."""
    held, size = [], 0
    for batch in batches:
        (terms, counts), (tf, _) = _flat(batch.column(2)), _flat(batch.column(3))
        ids = batch.column(0).fill_null(LOWEST).to_numpy()
        n = batch.column(1).to_numpy()
        ends = np.cumsum(counts)
        low = 0
        while low < len(ids):
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + limit - size, side="right")))
            held.append([ids[low:high], n[low:high], counts[low:high], terms[before : ends[high - 1]], tf[before : ends[high - 1]]])
            size += len(held[-1][3])
            low = high
            if size >= limit or len(ids) - low and size + counts[low] > limit:
                yield [np.concatenate(x) for x in zip(*held)]
                held, size = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _search(rows: DataFrame, queries: Queries, k: int, limit: int) -> DataFrame:
    """``query, doc_id, score``: the best k documents of each task."""
    n_docs, n_all = rows.where("n_terms > 0").agg(F.count("*"), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = _document_counts(rows, len(queries.key))
    weights = term_weights(df, n_docs)
    plans = []
    for number, terms, times in queries.queries:
        order = np.lexsort((terms, df[terms]))  # rarest first
        plans.append((number, terms[order], (times * weights[terms])[order]))
    shared = rows.sparkSession.sparkContext.broadcast((plans, len(queries.key), n_docs, n_all))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new_task()
        plans, n_terms, n_docs, n_all = shared.value
        none = np.empty(0, np.int64)
        best = [(none, none)] * len(plans)
        for ids, n, counts, terms, tf in _shards(batches, limit):
            shard = Shard(n_terms, counts, terms, tf, length_norm(n, n_docs, n_all))
            for i, (_, own, weights) in enumerate(plans):
                docs, scores = best[i]
                floor = int(scores[-1]) if len(scores) == k else 0
                at, found, _ = shard.best(own, weights, k, floor)
                keep = (found > 0) & (found >= floor)
                if keep.any():
                    best[i] = _top(np.concatenate([docs, ids[at[keep]]]), np.concatenate([scores, found[keep]]), k)
        for (number, _, _), (docs, scores) in zip(plans, best):
            if len(docs):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), number)), pa.array(docs), pa.array(scores)], names=[n for n, _ in _FOUND])

    return rows.mapInArrow(run, schema_of(_FOUND))


def rank(docs: DataFrame, items: DataFrame, *, k: int = TOP, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", block_bytes: int = BLOCK_BYTES, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of ``docs`` for each row of ``items``.

    Terms are runs of ASCII letters (A-Z in lower case), digits and other characters; a term that an item repeats counts
    as often. Documents without a score above 0 are not ranked. Equal scores stand by ascending doc_id, a missing one
    first; repeated rows of documents are ranked one by one, so ranks are always unique, and repeated items are queries
    of their own. Missing and empty texts have no terms: such items have no rows. Without documents there are no rows.
    Other columns play no part.
    """
    numbered = stored(items.select(F.monotonically_increasing_id().alias("query"), F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text")), "queries")
    size = numbered.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    found = None
    for b in range(blocks):
        rows = numbered.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).select("query", "text").collect()
        queries = Queries([r.query for r in rows], [r.text for r in rows])
        if found is not None and not queries.queries:
            continue
        index = stored(postings(docs, queries, text, doc_id), "postings")
        part = stored(_search(index, queries, k, shard_postings), "found")
        found = part if found is None else found.union(part)
    best_first = [F.desc("score"), F.asc("doc_id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(W.partitionBy("query", "salt").orderBy(*best_first))).where(F.col("rank") <= k)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*best_first))).where(F.col("rank") <= k)
    return ranked.join(numbered.select("query", "item_id"), "query").select("item_id", "rank", F.nullif("doc_id", F.lit(LOWEST)).alias("doc_id"), "score")
