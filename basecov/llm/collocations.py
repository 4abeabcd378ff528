"""Collocations of up to three words, counted by dynamic itemset counting.

The corpus lies in ``SHARDS`` shards that are scanned in a cycle, one Spark job a step. Words are counted from the first
step on. A longer phrase becomes active in the step after the one in which the later of its two subphrases (its words
without the last, and without the first) reached the threshold; from then on it is counted in every shard until it has
gone through one full cycle. So lengths interleave, and every phrase that reaches the threshold is counted over all texts
exactly once, because its subphrases reach the threshold no later than it does.

* Which step a subphrase reached the threshold in stands in two tables of ``CELLS`` bytes (words, pairs), which every
  task gets: a phrase has two cells, a cell keeps the first step that was written to it, and the later of both counts.
  Phrases that share cells may be active too early, which costs counting and changes nothing, since a phrase's first
  active step follows from the tables and is the same in all tasks and later steps. The tables do not grow with the data.
* A task sums the occurrences of about ``BUFFER`` active phrases and shuffles them packed: a row holds the phrases of one
  bucket (upper bits of the phrase's hash) as arrays. There are 8 buckets or more for each shuffle partition, so a
  bucket is a small part of a partition at any size and no phrase makes one large. The counts so far of phrases still on
  their cycle are one written table per step in the same form, which takes part in the shuffle; phrases that end below
  the threshold leave it.
* Phrases are their words' 64-bit keys, which include the language; only the words' own table holds text, and it is
  joined to the phrases that are reported.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basecov.llm.files import forget, is_there, without_old_shuffles
from basecov.llm.frames import kept, new_task
from basecov.llm.words import Words, mix, pieces, separators
from basecov.session import scratch_path

LEAST, TOP, COVERED_PERCENT = 10, 2000, 50
SHARDS = 4
CELLS = 1 << 23
BUFFER = 1_000_000
WORD_PIECE = 8 << 20
UNREACHED = 255
NO_LANGUAGE = "und"
#: What ends a piece of text, and the blanks between words. Fixed values.
_PIECE_ENDS = separators([*b".,;:!?", *range(0x0A, 0x0E)])
_BLANKS = separators((0x20, 0x09))
_SEPARATORS = _PIECE_ENDS | _BLANKS

_PACKED = "bucket INT, old BOOLEAN, a BINARY, b BINARY, c BINARY, act BINARY, n BINARY"
_MERGED = "bucket INT, a BINARY, b BINARY, c BINARY, act BINARY, n BINARY, cells BINARY, kind INT"
_COLUMNS = {"a": np.uint64, "b": np.uint64, "c": np.uint64, "act": np.int16, "n": np.int64}
BUCKETS_PER_PARTITION = 8
OPEN, DONE, REACHED = range(3)  # kinds of rows: phrases on their cycle, phrases at its end, cells of pairs that reached the threshold
_WORDS = "key BIGINT, lang STRING, word STRING, n BIGINT"


def _language_keys(langs: pa.Array) -> np.ndarray:
    names = langs.dictionary_encode() if not isinstance(langs, pa.DictionaryArray) else langs
    hashes = [int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in names.dictionary.to_pylist()]
    return np.array(hashes, np.uint64)[names.indices.to_numpy()] if len(hashes) else np.empty(0, np.uint64)


def _word_keys(words: Words, lang_keys: np.ndarray) -> np.ndarray:
    """Keys of words with their language; never 0, which stands for no word."""
    key = mix(words.key ^ np.repeat(lang_keys[words.row : words.row + words.n_docs], words.count))
    key[key == 0] = 1
    return key


def _joined(words: Words) -> np.ndarray:
    """Whether the word after each word belongs to the same piece of the same text; False for the last one."""
    ends = np.flatnonzero(_PIECE_ENDS[words.data])
    piece = np.searchsorted(ends, words.start) + words.doc()  # both only grow
    return np.append(piece[1:] == piece[:-1], False) if len(piece) else np.empty(0, bool)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    new_task()
    for batch in batches:
        lang_keys, langs = _language_keys(batch.column(0)), batch.column(0)
        for w in pieces(batch.column(1), _SEPARATORS, lower=True, limit=WORD_PIECE):
            key, first, n = np.unique(_word_keys(w, lang_keys), return_index=True, return_counts=True)
            text = [w.data[a:b].tobytes().lower().decode("utf-8", "replace") for a, b in zip(w.start[first].tolist(), w.end[first].tolist())]
            doc = np.searchsorted(w.first, first, side="right") - 1 + w.row
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), langs.take(pa.array(doc)), pa.array(text, pa.string()), pa.array(n)], names=["key", "lang", "word", "n"])


def cells_of(hashes: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(cells - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def _reached(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The step in which each phrase reached the threshold, or ``UNREACHED``."""
    one, two = cells_of(hashes, len(table))
    return np.maximum(table[one], table[two])


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a ^ (b << np.uint64(1) | b >> np.uint64(63))


def active_phrases(key: np.ndarray, joined: np.ndarray, tables: tuple[np.ndarray, np.ndarray], step: int, shards: int) -> list[np.ndarray]:
    """Occurrences of the phrases that this step counts: words a, b, c (0 for pairs) and first active step."""
    none = np.empty(0, np.uint64)
    if len(key) < 2:
        return [none, none, none, np.empty(0, np.int32)]

    def act(first: np.ndarray, second: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        later = np.maximum(first, second).astype(np.int32)
        # UNREACHED is no step: no cycle is that long
        at = np.flatnonzero(follows & (later < step) & (later + 1 > step - shards))
        return at, later[at] + 1

    word = _reached(tables[0], key)
    pair, began = act(word[:-1], word[1:], joined[:-1])
    out = [[key[pair], key[pair + 1], np.zeros(len(pair), np.uint64), began]]
    if len(key) > 2 and (tables[1] != UNREACHED).any():
        known = np.full(len(key) - 1, UNREACHED, np.uint8)
        at = np.flatnonzero(joined[:-1] & (word[:-1] != UNREACHED) & (word[1:] != UNREACHED))
        # shared cells may be older than the words: such a pair is known, like its words, from the latest of the three steps
        known[at] = np.maximum(_reached(tables[1], pair_hashes(key[at], key[at + 1])), np.maximum(word[at], word[at + 1]))
        triple, began = act(known[:-1], known[1:], joined[:-2] & joined[1:-1])
        out.append([key[triple], key[triple + 1], key[triple + 2], began])
    return [np.concatenate(x) for x in zip(*out)]


def summed(columns: list[np.ndarray], before: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct phrases in the order of their hashes: hash, a, b, c, act, sum of n, and sum of ``before`` if given."""
    a, b, c, act, n = columns
    hash_ = mix(a ^ mix(b ^ mix(c)))
    order = np.argsort(hash_, kind="stable")
    for again in (False, True):
        h, x, y, z = (v[order] for v in (hash_, a, b, c))
        new = np.ones(len(h), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])
        if again or not (new[1:] & (h[1:] == h[:-1])).any():
            break
        order = np.lexsort((c, b, a, hash_))  # different phrases with one hash
    heads = np.flatnonzero(new)
    sums = [np.add.reduceat(v[order], heads) if len(heads) else v for v in ((n,) if before is None else (n, before))]
    return h[heads], x[heads], y[heads], z[heads], act[order][heads], *sums


def _packed(hash_: np.ndarray, columns: list[np.ndarray], bits: int) -> list[pa.Array]:
    """The phrases, in the order of their hashes, as one row per bucket: bucket and the bytes of each column."""
    bucket = (hash_ >> np.uint64(64 - bits)).astype(np.int32)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    places = np.append(first, len(bucket))
    out = [pa.array(bucket[first])]
    for values, kind in zip(columns, _COLUMNS.values()):
        values = values.astype(kind, copy=False)
        offsets = pa.py_buffer((places * values.itemsize).astype(np.int32).tobytes())
        out.append(pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(values.tobytes())]))
    return out


def _unpacked(table: pa.Table | pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of packed rows, and the number of phrases in each row."""
    raw = {name: table.column(name).to_pylist() for name in _COLUMNS}
    columns = [np.frombuffer(b"".join(raw[name]), kind) for name, kind in _COLUMNS.items()]
    return columns, np.array([len(x) // 8 for x in raw["n"]], np.int64)


def _count_phrases(rows: DataFrame, shared: Broadcast, step: int, shards: int, bits: int) -> DataFrame:
    """Packed counts of the active phrases of a shard; ``shared`` holds the compressed tables."""

    def unpacked() -> tuple[np.ndarray, np.ndarray]:
        words, pairs = (np.frombuffer(zlib.decompress(t), np.uint8) for t in shared.value)
        return words, pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new_task()
        tables = kept(("reached", step), unpacked)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held)]
            hash_, *found = summed([*columns, np.ones(len(columns[0]), np.int64)])
            bucket, *packed = _packed(hash_, found, bits)
            return pa.RecordBatch.from_arrays([bucket, pa.array(np.zeros(len(bucket), bool)), *packed], names=["bucket", "old", *_COLUMNS])

        for batch in batches:
            lang_keys = _language_keys(batch.column(0))
            for w in pieces(batch.column(1), _SEPARATORS, lower=True):
                found = active_phrases(_word_keys(w, lang_keys), _joined(w), tables, step, shards)
                held.append(found)
                size += len(found[0])
                if size >= BUFFER:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return rows.mapInArrow(run, _PACKED)


def _merge(step: int, shards: int, least: int, cells: int, bits: int):
    """Sums a bucket; says what stays open, what has ended at or above the threshold, and which pairs have reached it."""

    def merge(table: pa.Table) -> pa.Table:
        columns, sizes = _unpacked(table)
        old = np.repeat(table.column("old").to_numpy(), sizes)
        hash_, a, b, c, act, n, before = summed(columns, np.where(old, columns[4], 0))
        finished = act + (shards - 1) <= step
        out = []
        for kind, keep in ((OPEN, ~finished), (DONE, finished & (n >= least))):
            if keep.any():
                bucket, *packed = _packed(hash_[keep], [x[keep] for x in (a, b, c, act, n)], bits)
                out.append(pa.table([bucket, *packed, pa.nulls(len(bucket), pa.binary()), pa.array([kind] * len(bucket), pa.int32())], names=["bucket", *_COLUMNS, "cells", "kind"]))
        new = (c == 0) & (n >= least) & (before < least)
        if new.any():
            marks = np.concatenate(cells_of(pair_hashes(a[new], b[new]), cells)).astype(np.int32).tobytes()
            out.append(pa.table([table.column("bucket").slice(0, 1).combine_chunks(), *[pa.nulls(1, pa.binary())] * 5, pa.array([marks], pa.binary()), pa.array([REACHED], pa.int32())], names=["bucket", *_COLUMNS, "cells", "kind"]))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in [("bucket", pa.int32()), *[(x, pa.binary()) for x in [*_COLUMNS, "cells"]], ("kind", pa.int32())]})

    return merge


def _flat_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(found))], names=["cell"])


def _flat_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (a, b, c, _, n), _ = _unpacked(batch)
        yield pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in (a, b, c)], pa.array(n)], names=["a", "b", "c", "n"])


class Counting:
    """The state of a run: shards, counts so far, and the tables of steps in which phrases reached the threshold."""

    def __init__(self, docs: DataFrame, text: str, lang: str, least: int, shards: int, cells: int):
        if not 1 <= shards <= 60 or cells & (cells - 1) or least < 1:
            raise ValueError("shards, cells (a power of two) or threshold out of range")
        self.spark, self.least, self.shards, self.cells = docs.sparkSession, least, shards, cells
        rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"), F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"))
        self.texts = self._write(rows, "shards", "shard")
        self.tables = (np.full(cells, UNREACHED, np.uint8), np.full(cells, UNREACHED, np.uint8))
        self.words: DataFrame | None = None
        self.open: str | None = None
        self.done: list[str] = []
        self.steps = 0
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.bits = min(30, (BUCKETS_PER_PARTITION * partitions - 1).bit_length())

    def _write(self, df: DataFrame, name: str, by: str) -> str:
        path = scratch_path(self.spark, name)
        with without_old_shuffles(self.spark):
            df.write.partitionBy(by).parquet(path)
        return path

    def _read(self, path: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def shard(self, step: int) -> DataFrame:
        return self._read(self.texts, "lang STRING, text STRING, shard INT").where(F.col("shard") == step % self.shards).select("lang", "text")

    def _mark(self, table: np.ndarray, cells: DataFrame, step: int) -> bool:
        """Writes the step to the cells of phrases that reached the threshold in it; at most ``cells`` numbers come back."""
        found = cells.distinct().toArrow().column("cell").to_numpy()
        table[found] = np.minimum(table[found], step)
        return len(found) > 0

    def _merged(self, fresh: DataFrame, before: DataFrame | None, keys: list[str]) -> DataFrame:
        rows = fresh.select(*keys, "n", F.lit(0).cast("long").alias("before"))
        if before is not None:
            rows = rows.union(before.select(*keys, "n", F.col("n").alias("before")))
        return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("before").alias("before"))

    def count_words(self, step: int) -> bool:
        merged = self._merged(self.shard(step).mapInArrow(_count_words, _WORDS), self.words, ["key", "lang", "word"])
        path = scratch_path(self.spark, "words")
        with without_old_shuffles(self.spark):
            merged.write.parquet(path)
        self.words = self._read(path, f"{_WORDS}, before BIGINT")
        new = self.words.where(f"n >= {self.least} AND before < {self.least}")
        places = [f"int({h} & {self.cells - 1})" for h in ("key", "shiftrightunsigned(key, 32)")]
        return self._mark(self.tables[0], new.selectExpr(f"explode(array({', '.join(places)})) AS cell"), step)

    def count_phrases(self, step: int) -> bool:
        """One step over longer phrases: whether a pair reached the threshold."""
        shared = self.spark.sparkContext.broadcast([zlib.compress(t, 1) for t in self.tables])
        rows = _count_phrases(self.shard(step), shared, step, self.shards, self.bits)
        if self.open:
            held = self._read(self.open, _MERGED).where(F.col("kind") == OPEN)
            rows = rows.union(held.select("bucket", F.lit(True).alias("old"), *_COLUMNS))
        merged = rows.groupBy("bucket").applyInArrow(_merge(step, self.shards, self.least, self.cells, self.bits), _MERGED)
        path = self._write(merged, "phrases", "kind")
        shared.destroy()  # the step is written; nothing computes it again
        if self.open:
            forget(self.spark, f"{self.open}/kind={OPEN}")
        self.open = path
        self.done.append(path)
        cells = self._read(path, _MERGED).where(F.col("kind") == REACHED).select("cells")
        return self._mark(self.tables[1], cells.mapInArrow(_flat_cells, "cell INT"), step)

    def run(self) -> None:
        step, last = 0, 0  # the last step in which a phrase is on its cycle
        while step < self.shards or step <= last:
            if step and step <= last and self.count_phrases(step):
                last = step + self.shards
            if step < self.shards and self.count_words(step):
                last = max(last, step + self.shards)
            step += 1
        self.steps = step
        forget(self.spark, self.texts)

    def phrases(self) -> DataFrame:
        """``a, b, c, n`` of all longer phrases that reach the threshold."""
        schema = "a BIGINT, b BIGINT, c BIGINT, n BIGINT"
        # one scan over the folders of all steps: a union of one scan a step makes the plan, which the driver holds, as many times larger
        done = [p for p in (f"{step}/kind={DONE}" for step in self.done) if is_there(self.spark, p)]
        if not done:
            return self.spark.createDataFrame([], schema)
        packed = self.spark.read.schema(", ".join(f"{name} BINARY" for name in _COLUMNS)).parquet(*done)
        return packed.mapInArrow(_flat_phrases, schema)


def _score(f: str, left: str, right: str) -> str:
    """floor(1000000 f f / (left right)), exact: counts below 10^14 in decimals of up to 37 digits."""
    f, left, right = (f"CAST({x} AS DECIMAL(14,0))" for x in (f, left, right))
    return f"({f} * {f} * 1000000BD) div ({left} * {right})"


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, covered_percent: int = COVERED_PERCENT, shards: int = SHARDS, cells: int = CELLS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of two and three words.

    A phrase lies within a piece of text between ``.,;:!?`` and line ends, in lower case (A-Z only), and occurs ``a``
    times, ``least`` or more. Its score is that of its weakest cut into a first part (``l`` times) and a rest (``r``
    times); ties take the shorter first part. ``n`` counts all words of the language. Pairs inside a triple that occurs
    at least ``covered_percent`` percent as often are left out. Ranks follow score, ``a`` and the phrase's bytes.

    A missing language is ``und``; missing and empty texts have no words; repeated rows count again; an empty table has
    no rows. Other columns play no part. ``shards`` and ``cells`` change how the counting goes, never its result.
    """
    counting = Counting(docs, text, lang, least, shards, cells)
    counting.run()
    words = counting.words.drop("before")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    known = words.where(F.col("n") >= least)
    one = known.select(F.col("key").alias("a"), "lang", F.col("n").alias("fa"))

    def last(column: str) -> DataFrame:
        return known.select(F.col("key").alias(column), F.col("n").alias(f"f{column}"))

    grams = counting.phrases()
    pairs, triples = grams.where("c = 0").select("a", "b", F.col("n").alias("f")), grams.where("c <> 0").withColumnRenamed("n", "f")
    inside = triples.select("a", "b", "f").union(triples.select(F.col("b"), F.col("c"), "f")).toDF("a", "b", "longer").groupBy("a", "b").agg(F.max("longer").alias("longer"))
    scored_pairs = pairs.join(one, "a").join(last("b"), "b").join(inside, ["a", "b"], "left").where(f"longer IS NULL OR 100 * longer < {covered_percent} * f")
    scored_pairs = scored_pairs.selectExpr("lang", "a", "b", "0L AS c", "f", "fa AS l", "fb AS r", f"{_score('f', 'fa', 'fb')} AS score")
    firsts, rests = pairs.select("a", "b", F.col("f").alias("fab")), pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("fbc"))
    cut = triples.join(one, "a").join(last("c"), "c").join(firsts, ["a", "b"]).join(rests, ["b", "c"])
    cut = cut.selectExpr("*", f"{_score('f', 'fa', 'fbc')} AS s1", f"{_score('f', 'fab', 'fc')} AS s2")
    scored_triples = cut.selectExpr("lang", "a", "b", "c", "f", "if(s1 <= s2, fa, fab) AS l", "if(s1 <= s2, fbc, fc) AS r", "least(s1, s2) AS score")

    by_lang = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"))
    best = scored_pairs.union(scored_triples).withColumn("place", F.rank().over(by_lang)).where(F.col("place") <= top)
    for column in ("a", "b", "c"):
        best = best.join(known.select(F.col("key").alias(column), F.col("word").alias(f"word_{column}")), column, "left")
    named = best.withColumn("phrase", F.concat_ws(" ", "word_a", "word_b", "word_c"))
    ranked = named.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), F.asc("phrase")))).where(F.col("rank") <= top)
    columns = ["lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", F.col("total").alias("n"), "score"]
    return ranked.join(totals, "lang").select(*columns)
