"""N-gram Jaccard join by parity sketches.

The shingles of a text are hashed to 64 bits. A sketch has a number of words; every shingle is XORed into one of them,
so a shingle that only one of two sets holds changes one word: the number of differing words (the Hamming distance of the
sketches, word by word) is at most the size of the symmetric difference. Sets that reach the threshold and whose sizes lie
in one size band, or in two neighbouring ones, differ in at most D shingles. Sketches of D + 1 + s words then agree in at
least s + 1 words, and a join on (band, word number, word) finds all pairs.

* Sets with equal shingles are one class from the start; only the document with the smallest id goes on.
* Of a document's words only the rarest D + 1 are used: two similar sets share at least one of these, since the rarest
  word they agree in has at most D others before it on either side. Documents that share s words or fewer drop out.
* Groups of documents with a common word are not expanded to pairs. Each group is first held against its smallest member
  (star); verified links give components; only documents of different components that still share a word are compared:
  groups of up to ``SMALL_GROUP`` as pairs, larger ones in blocks, where a task counts the common shingles of all texts of
  two blocks at once and reports only links between components.
* Verification counts common shingles of the texts themselves, with one centre text or two blocks in memory at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basecov.llm.components import components
from basecov.llm.files import without_old_shuffles
from basecov.llm.frames import mapped, new_task
from basecov.llm.words import MULTIPLIER, Words, mix, pieces, starts_of, window_keys
from basecov.session import stored

#: Rows of a table of ids that may be sent to all tasks (some 50 bytes each in memory); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Members of a centre that are verified in one group of rows.
GROUP_MEMBERS = 500
#: Documents with a common word that are compared as pairs; more are compared in blocks of ``BLOCK_DOCS``.
SMALL_GROUP, BLOCK_DOCS = 16, 128
#: Low bits of a join key that are zero: keys of 48 bits take less room in shuffles, and words that differ but have one
#: key only make candidates, which the texts decide.
KEY_ZEROS = np.uint64(16)


class Bands:
    """Size bands for a threshold of ``percent``, and what two sets of a band can differ in."""

    def __init__(self, percent: int, most: int = 1 << 40):
        low = [1]
        while low[-1] <= most:
            low.append(low[-1] * 100 // percent + 1)
        self.low = np.array(low)
        # The smaller set has at most low[i + 1] - 1 shingles, the larger one that many divided by the threshold.
        self.differ = (self.low[1:] - 1) * (100 - percent) // percent
        self.spare = np.where(self.differ > 0, 2 + self.differ // 8, 0)
        self.words = np.where(self.differ > 0, self.differ + 1 + self.spare, 0)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, side="right") - 1


def shingles(w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document of a piece, sorted by document and key: document, key.

    A document of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    docs, keys = [], []
    counts = w.count
    at, key = w.windows(length)
    docs.append(np.searchsorted(w.first, at, side="right") - 1)
    keys.append(key)
    for n in range(1, length):
        short = np.flatnonzero(counts == n)
        if len(short):
            at = starts_of(w.first, n)
            key = window_keys(w.key, w.first, n)
            whole = np.isin(at, w.first[short])
            owner = np.searchsorted(w.first, at[whole], side="right") - 1
            right = counts[owner] == n
            docs.append(owner[right])
            keys.append(key[whole][right])
    doc, key = np.concatenate(docs), np.concatenate(keys)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    return doc[new], key[new]


def _sketch(doc: np.ndarray, key: np.ndarray, band: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of all sketch words of all documents, and the offset of each document; band -1: none."""
    used = np.where(band >= 0, bands.words[band], 0)
    base = np.concatenate([[0], np.cumsum(used)])
    on = used[doc] > 0
    d, k = doc[on], key[on]
    slot = base[d] + ((k >> np.uint64(17)) % used[d].astype(np.uint64)).astype(np.int64)
    words = np.zeros(base[-1], np.uint64)
    np.bitwise_xor.at(words, slot, mix(k ^ np.uint64(MULTIPLIER)))
    owner = np.repeat(np.arange(len(used)), used)
    number = np.arange(base[-1]) - base[owner]
    place = mix(band[owner].astype(np.uint64) << np.uint64(32) | number.astype(np.uint64))
    return mix(words + place) >> KEY_ZEROS << KEY_ZEROS, base


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((8 * offsets).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def sketches(docs: DataFrame, doc_id: str, text: str, length: int, percent: int) -> DataFrame:
    """Per row: id, number of shingles, 128-bit digest of the set, join keys for its own band and for the band below."""
    bands = Bands(percent)

    def compute(batch):
        for w in pieces(batch.column(1), lower=True):
            doc, key = shingles(w, length)
            n = np.bincount(doc, minlength=w.n_docs)
            ends = np.concatenate([[0], np.cumsum(n)])
            digests = []
            for salt in (0x51, 0xA7):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(key + np.uint64(salt)))])
                digests.append((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
            band = bands.of(n)
            own, own_at = _sketch(doc, key, band, bands)
            below, below_at = _sketch(doc, key, band - 1, bands)
            spare = np.where(band >= 0, bands.spare[band], 0), np.where(band >= 1, bands.spare[band - 1], 0)
            ids = batch.column(0).slice(w.row, w.n_docs)
            yield [ids, pa.array(n), *digests, pa.array(spare[0], pa.int32()), pa.array(spare[1], pa.int32()), _binary(own, own_at), _binary(below, below_at)]

    out = [("doc_id", "bigint"), ("n_shingles", "bigint"), ("d1", "bigint"), ("d2", "bigint"), ("own_spare", "int"), ("below_spare", "int"), ("own", "binary"), ("below", "binary")]
    return mapped(docs, [(doc_id, "bigint"), (text, "string")], out, compute)


def _join_keys(one_of_each: DataFrame) -> DataFrame:
    """A row per sketch word: join key, document, which of its two sketches, spare words of that sketch."""

    def compute(batch):
        ids, spares = batch.column(0).to_numpy(zero_copy_only=False), [batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)]
        for side in (0, 1):
            column = batch.column(3 + side)
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 8
            keys = np.frombuffer(column.buffers()[2] or b"", np.int64)[offsets[0] : offsets[-1]]
            n = np.diff(offsets)
            yield [keys, np.repeat(ids, n), np.repeat((2 * spares[side] + side).astype(np.int32), n)]

    columns = [("doc_id", "bigint"), ("own_spare", "int"), ("below_spare", "int"), ("own", "binary"), ("below", "binary")]
    return mapped(one_of_each, columns, [("key", "bigint"), ("doc", "bigint"), ("kind", "int")], compute)


def _shared(keys: DataFrame) -> DataFrame:
    """(key, doc) of the rarest words of each sketch that more than one document has."""
    by_key = W.partitionBy("key")
    found = keys.withColumn("times", F.count("*").over(by_key)).where(F.col("times") > 1)
    sketch = W.partitionBy("doc", "kind")
    ranked = found.withColumn("shared", F.count("*").over(sketch)).withColumn("rank", F.row_number().over(sketch.orderBy("times", "key")))
    return ranked.where("rank <= shared - floor(kind / 2)").select("key", "doc")


def _small(df: DataFrame) -> DataFrame:
    """A hint to send a stored table of ids to all tasks if it has few enough rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def verified(pairs: DataFrame, docs: DataFrame, length: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (stored; a, b) whose texts in ``docs`` (doc_id, text) reach the threshold.

    Rows of one centre ``a`` come together behind its text; centres with many partners are dealt out over several groups.
    """
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP_MEMBERS).cast("int").alias("groups"))
    dealt = stored(pairs.join(size, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("part")), "pairs")
    heads = stored(dealt.select("a", "part").distinct(), "centres")
    members = docs.join(_small(dealt), docs.doc_id == F.col("b")).select("a", "part", F.col("b"), "text")
    centres = docs.join(_small(heads), docs.doc_id == F.col("a")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = centres.union(members).repartition(parts, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches):
        new_task()
        centre, sets = None, []  # texts of the current centre; several rows may have its id
        for batch in batches:
            a, part = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            b = batch.column(2).to_pylist()
            links = []
            for w in pieces(batch.column(3), lower=True):
                doc, key = shingles(w, length)
                ends = np.searchsorted(doc, np.arange(w.n_docs + 1))
                for i in range(w.n_docs):
                    row = w.row + i
                    own = key[ends[i] : ends[i + 1]]
                    if b[row] is None:
                        if centre != (a[row], part[row]):
                            centre, sets = (a[row], part[row]), []
                        sets.append(own.copy())
                        continue
                    for other in sets:
                        both = len(np.intersect1d(own, other, assume_unique=True))
                        if both and 100 * both >= percent * (len(own) + len(other) - both):
                            links.append((a[row], b[row]))
                            break
            yield _pairs(links)

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _in_blocks(large: DataFrame, docs: DataFrame, length: int, percent: int) -> DataFrame:
    """Links (a, b) between components of documents that large groups of words join: key, doc, component ``c``.

    The groups that share documents form a cluster. Its largest component is cut into blocks, and so are all other
    documents; every block of the others meets every block of its cluster.
    """
    stars = large.withColumn("a", F.min("doc").over(W.partitionBy("key"))).where("doc > a")
    clusters = components(stars.select("a", "doc").distinct(), "a", "doc")
    members = large.select("doc", "c").distinct().join(clusters, large.doc == F.col("node")).select("doc", "c", F.col("component").alias("cluster"))
    members = stored(members, "members")
    sizes = members.groupBy("cluster", "c").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("cluster").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.max("n").alias("inner"), F.sum("n").alias("all"))
    blocks = largest.select("cluster", "main", F.ceil(F.col("inner") / BLOCK_DOCS).cast("int").alias("inner"), F.ceil((F.col("all") - F.col("inner")) / BLOCK_DOCS).cast("int").alias("outer")).where("outer > 0")
    placed = members.join(_small(stored(blocks, "blocks")), "cluster").withColumn("out", F.col("c") != F.col("main"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc"), F.when(F.col("out"), F.col("outer")).otherwise(F.col("inner"))).cast("int"))
    # Block pairs (i, j): i counts blocks of others, j those too (not below i) and behind them the blocks of the largest.
    pairs = F.expr("""CASE WHEN out THEN concat(
        transform(sequence(0, block), i -> struct(i AS i, block AS j, i = block AS left)),
        transform(sequence(block, outer + inner - 1), j -> struct(block AS i, j AS j, true AS left)))
        ELSE transform(sequence(0, outer - 1), i -> struct(i AS i, outer + block AS j, false AS left)) END""")
    dealt = placed.select("cluster", "doc", "c", F.explode(F.array_distinct(pairs)).alias("p")).select("cluster", "doc", "c", "p.i", "p.j", "p.left")
    dealt = stored(dealt, "block-pairs")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.join(_small(dealt), docs.doc_id == dealt.doc).select("cluster", "i", "j", "left", "doc", "c", "text")
    spread = texts.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")

    def run(batches):
        new_task()
        now, held = None, []
        for batch in batches:
            names = list(zip(*[batch.column(k).to_pylist() for k in range(6)]))
            links = []
            for w in pieces(batch.column(6), lower=True):
                doc, key = shingles(w, length)
                ends = np.searchsorted(doc, np.arange(w.n_docs + 1))
                for i in range(w.n_docs):
                    cluster, x, y, left, node, c = names[w.row + i]
                    if (cluster, x, y) != now:
                        links += _block_links(held, percent)
                        now, held = (cluster, x, y), []
                    held.append((left, node, c, key[ends[i] : ends[i + 1]].copy()))
            yield _pairs(links)
        yield _pairs(_block_links(held, percent))

    return spread.mapInArrow(run, "a bigint, b bigint").distinct()


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _block_links(held: list[tuple[bool, int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links between the left and the right documents of a block pair that join different components.

    A block that meets itself has all its documents on the left; each is then held against all.
    """
    left = [h for h in held if h[0]]
    right = [h for h in held if not h[0]] or left
    if not left:
        return []
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    everything = np.unique(np.concatenate([h[3] for h in held]))
    codes = [[np.searchsorted(everything, h[3]) for h in side] for side in (left, right)]
    both = np.zeros((len(left), len(right)), np.int64)
    for low in range(0, len(everything), 8192):
        parts = []
        for side in codes:
            part = np.zeros((len(side), 8192), np.float32)
            for i, c in enumerate(side):
                part[i, c[np.searchsorted(c, low) : np.searchsorted(c, low + 8192)] - low] = 1
            parts.append(part)
        both += np.rint(parts[0] @ parts[1].T).astype(np.int64)
    n, m = (np.array([len(h[3]) for h in side]) for side in (left, right))
    links = []
    for i, j in zip(*np.nonzero((both > 0) & (100 * both >= percent * (n[:, None] + m[None, :] - both)))):
        x, y = find(left[i][2]), find(right[j][2])
        if x != y:
            parent[max(x, y)] = min(x, y)
            links.append((left[i][1], right[j][1]))
    return links


def linked(docs: DataFrame, *, length: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: the smallest id reachable by links.

    Words are runs of anything but the six white-space characters, A-Z in lower case; a document's set is its distinct
    shingles of ``length`` words, or its whole sequence if it has fewer words. Two documents link when
    100 * intersection >= percent * union. A missing or empty text has no shingles and no links. A missing id counts as
    the lowest 64-bit integer; rows with equal ids are one document with several texts. An empty table gives no rows.
    """
    with without_old_shuffles(docs.sparkSession):  # the steps below write their tables at once
        return _linked(docs, length, percent, doc_id, text)


def _linked(docs: DataFrame, length: int, percent: int, doc_id: str, text: str) -> DataFrame:
    lowest = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(lowest)).alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    sketched = stored(sketches(rows, "doc_id", "text", length, percent), "sketches")
    heads = sketched.select("doc_id", "n_shingles", "d1", "d2")
    classes = stored(heads.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n")), "classes")
    same = [sketched.d1 == classes.d1, sketched.d2 == classes.d2, sketched.doc_id == classes.rep]
    one_of_each = sketched.join(classes.where("n > 1"), same, "left_semi")
    shared = stored(_shared(_join_keys(one_of_each)), "shared-words")

    by_key = W.partitionBy("key")
    star = shared.withColumn("a", F.min("doc").over(by_key)).where("doc > a").select("a", F.col("doc").alias("b")).distinct()
    first = stored(star, "star-pairs")
    links = stored(verified(first, rows, length, percent), "links")
    grouped = stored(components(links, "a", "b"), "components")

    # Words that documents of several components still share: hold their documents against each other.
    placed = shared.join(grouped, shared.doc == grouped.node, "left").select("key", "doc", F.coalesce("component", "doc").alias("c"))
    open_words = placed.withColumn("low", F.min("c").over(by_key)).withColumn("high", F.max("c").over(by_key)).where("low != high")
    open_words = stored(open_words.withColumn("members", F.count("*").over(by_key)).select("key", "doc", "c", "members"), "open-words")
    small = open_words.where(F.col("members") <= SMALL_GROUP)
    left, right = small.alias("l"), small.alias("r")
    rest = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.doc") < F.col("r.doc")) & (F.col("l.c") != F.col("r.c")))
    rest = rest.select(F.col("l.doc").alias("a"), F.col("r.doc").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    more = verified(stored(rest, "open-pairs"), rows, length, percent)
    more = more.union(_in_blocks(open_words.where(F.col("members") > SMALL_GROUP), rows, length, percent))

    # Rows with one id but different texts belong together too.
    members = heads.join(classes, ["d1", "d2"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    members = stored(members, "members")
    split = members.where("rep != doc_id").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    twice = members.where("rep = doc_id").select("doc_id").distinct().join(members.where("rep != doc_id").select("doc_id", "rep"), "doc_id")
    extra = split.where("a != b").select("a", "b").union(twice.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    final = stored(components(links.union(more).union(extra), "a", "b"), "components")
    out = members.join(final, members.rep == final.node, "left")
    return out.select(F.nullif("doc_id", F.lit(lowest)).alias("doc_id"), "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def one_of_each_group(docs: DataFrame, *, length: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with their own columns.

    Only ids of documents that go are joined to the texts: sent to all tasks if they are few, else by a shuffle. A missing
    id counts as the lowest 64-bit integer; rows with equal ids stay or go together.
    """
    found = linked(docs, length=length, percent=percent, doc_id=doc_id, text=text)
    with without_old_shuffles(docs.sparkSession):
        gone = stored(found.where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "duplicates")
    return docs.join(_small(gone), F.col(f"`{doc_id}`").cast("long") == F.col("__gone"), "left_anti")
