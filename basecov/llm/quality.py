"""Quality rules: robust multivariate outliers among text statistics, per language and source.

Every document becomes a vector of transformed statistics. Per (language, source) the minimum-covariance-determinant
estimate is approached by concentration steps: take the share ``CORE`` of the documents with the smallest Mahalanobis
distances, estimate again from them, repeat. A document is rejected when its squared distance exceeds a quantile of the
chi-squared distribution.

There are three fixed starts around the coordinate-wise medians: the variances from quartiles alone, and these with the
correlations of two bounded scores of the standardised vector, its hyperbolic tangents and its spatial sign. All make
``FIRST_STEPS`` steps together; each group goes on from the start with the least determinant (at equal ones the first).
A step is taken only if it lowers the logarithm of the determinant by more than ``TOLERANCE``; the steps end when no
group takes one, or after ``MOST_STEPS``.

A step is two aggregations over the vectors of all documents: counts per distance bin give each group's limit, then sums
of products give the estimate. Both combine on the map side, so a group may hold any share of the rows; only one row per
group and start reaches a further join. Vectors are whole multiples of ``1 / GRID`` and are summed as integers, so
results do not depend on the order of rows. Estimates are drawn towards those of the language with the weight of
``PRIOR_ROWS`` rows, and a constant floor is added to the variances, in determinants too, so small or constant groups
have usable estimates.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basecov.llm.frames import with_batch_columns
from basecov.llm.words import MULTIPLIER, WHITE_TABLE, Words, keys_of, mix, pieces, separators, split_words
from basecov.session import stored

CORE = 0.75
FIRST_STEPS, MOST_STEPS, TOLERANCE = 2, 12, 0.01
#: How far the correlations of a start are drawn towards none.
SHRINK = 0.1
TAIL = 1e-7
PRIOR_ROWS = 100
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
GRID = 4096
#: Vector components: SQL over the statistics, and the standard deviation that is taken for granted. Fixed values.
COMPONENTS = (
    ("ln(word_chars / n_words)", 0.05),
    ("ln(1 + 20 * n_symbols / n_words)", 0.25),
    ("sqrt(n_dup_lines / n_words)", 0.10),
    ("sqrt(n_repeat_words / n_words)", 0.15),
    ("ln(n_words)", 1.00),
)
P = len(COMPONENTS)
STATISTICS = [(n, "bigint") for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
SYMBOLS = separators(b"#*$%&|<>")
_NEWLINE = separators(b"\n")
#: More groups than this are joined by a shuffle instead of a broadcast; a group's estimate takes some 400 bytes.
BROADCAST_GROUPS = 100_000


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _apart(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that also differ between documents."""
    return key ^ mix(doc.astype(np.uint64) * np.uint64(MULTIPLIER))


def _dup_lines(w: Words) -> np.ndarray:
    start, end = split_words(w.data, w.offsets, _NEWLINE)
    solid = np.concatenate([[0], np.cumsum(~WHITE_TABLE[w.data])])
    used = solid[end] > solid[start]
    start, end = start[used], end[used]
    doc = np.searchsorted(w.offsets, start, side="right") - 1
    key = _apart(keys_of(w.data, start, end), doc)
    order = np.argsort(key)
    key = key[order]
    again = np.zeros(len(key), bool)
    again[1:] = key[1:] == key[:-1]
    return np.bincount(doc[order][again], minlength=w.n_docs)


def _repeat_words(w: Words, window: int = 3) -> np.ndarray:
    at, key = w.windows(window)
    key = _apart(key, np.repeat(np.arange(w.n_docs), np.maximum(w.count - window + 1, 0)))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    repeated = np.zeros(len(key), bool)
    repeated[1:] = same
    repeated[:-1] |= same
    begins = at[order[repeated]]
    covered = np.zeros(len(w.key), bool)
    for k in range(window):
        covered[begins + k] = True
    return _per_doc(covered, w.first)


def statistics(column: pa.Array):
    for w in pieces(column):
        visible = ~WHITE_TABLE[w.data] & ((w.data & 0xC0) != 0x80)
        found = [w.count, _per_doc(visible, w.offsets), _per_doc(SYMBOLS[w.data], w.offsets), _dup_lines(w), _repeat_words(w)]
        yield [pa.array(x, pa.int64()) for x in found]


def with_statistics(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of every whole text.

    Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return. Code points count
    as characters. A line counts as repeated if it has a word and equals an earlier line; a word counts as repeated if it
    lies in a window of three words that the text has twice or more. A missing or empty text has zeros. Columns with the
    names of the new ones are replaced, all others are kept.
    """
    return with_batch_columns(docs, text, STATISTICS, statistics)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def chi2_cdf(x: float, df: int) -> float:
    """By the series of the lower incomplete gamma function."""
    a, half = df / 2, x / 2
    if half <= 0:
        return 0.0
    term = total = 1 / a
    k = 1
    while term > total * 1e-16:
        term *= half / (a + k)
        total += term
        k += 1
    return total * math.exp(-half + a * math.log(half) - math.lgamma(a))


def chi2_quantile(share: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, df) < share else (low, middle)
    return high


def consistency(core: float = CORE, df: int = P) -> float:
    """What the covariance of a normal distribution's core of that share must be multiplied with."""
    return core / chi2_cdf(chi2_quantile(core, df), df + 2)


def _vectors(stats: DataFrame) -> DataFrame:
    """Group and whole-number vector of every document that passes the base rules."""
    kept = stats.where(~base_failed())
    return kept.select(F.struct(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")).alias("g"), *[F.expr(f"CAST(round({GRID} * {sql}) AS BIGINT)").alias(f"x{i}") for i, (sql, _) in enumerate(COMPONENTS)])


def _join(df: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    right = groups.withColumnRenamed("g", "__g")
    return df.join(F.broadcast(right) if few else right, F.col("g").eqNullSafe(F.col("__g")), "left").drop("__g")


def _distance() -> Column:
    terms = []
    for i in range(P):
        for j in range(i, P):
            times = "" if i == j else "2 * "
            terms.append(f"{times}precision[{i * P + j}] * (x{i} - centre[{i}]) * (x{j} - centre[{j}])")
    return F.expr(" + ".join(terms))


def _middle(vectors: DataFrame) -> DataFrame:
    """Medians (``centre``) and variances from quartiles (``v``) per group, from counts per value."""
    long = vectors.select("g", F.expr("posexplode(array(" + ", ".join(f"x{i}" for i in range(P)) + ")) AS (i, x)"))
    # Values are binned to a 32nd of the assumed deviation, so a group has a bounded number of counts.
    width = F.expr("array(" + ", ".join(str(max(1, round(GRID * s / 32))) for _, s in COMPONENTS) + ")")
    counts = long.select("g", "i", F.floor(F.col("x") / width[F.col("i")]).alias("b"), width[F.col("i")].alias("w")).groupBy("g", "i", "b", "w").count()
    up = W.partitionBy("g", "i").orderBy("b")
    ranked = counts.withColumn("upto", F.sum("count").over(up)).withColumn("n", F.sum("count").over(W.partitionBy("g", "i")))
    at = [F.min(F.when(F.col("upto") >= q * F.col("n"), (F.col("b") + 0.5) * F.col("w"))).alias(n) for n, q in (("low", 0.25), ("mid", 0.5), ("high", 0.75))]
    parts = ranked.groupBy("g", "i").agg(*at).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "low", "mid", "high"))).alias("q"))
    floor = [(GRID * s) ** 2 for _, s in COMPONENTS]
    spread = ", ".join(f"pow((q[{i}].high - q[{i}].low) / 1.349, 2) + {floor[i]!r}D" for i in range(P))
    return parts.select("g", F.expr("transform(q, p -> p.mid)").alias("centre"), F.expr(f"array({spread})").alias("v"))


_SUMS = [f"s{i}" for i in range(P)] + [f"s{i}_{j}" for i in range(P) for j in range(i, P)]


def _sums(rows: DataFrame) -> DataFrame:
    sums = [F.expr(f"sum(CAST(x{i} AS DECIMAL(20, 0)))").alias(f"s{i}") for i in range(P)]
    sums += [F.expr(f"sum(CAST(x{i} AS DECIMAL(12, 0)) * CAST(x{j} AS DECIMAL(12, 0)))").alias(f"s{i}_{j}") for i in range(P) for j in range(i, P)]
    return rows.groupBy("g").agg(F.count("*").alias("n"), *sums)


def _as_numbers(sums: DataFrame, *more: Column) -> DataFrame:
    """Group fields and sums as columns that Arrow batches hold without nesting."""
    own = [F.col("g.lang").alias("lang"), F.col("g.source").alias("source"), F.col("g.start").alias("start")]
    return sums.select(*own, F.col("n").cast("double"), *[F.col(c).cast("double") for c in _SUMS], *more)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _squares(batch: pa.RecordBatch, prefix: str = "") -> np.ndarray:
    """The sums of products as one symmetric matrix per row."""
    out = np.empty((batch.num_rows, P, P))
    for i in range(P):
        for j in range(i, P):
            out[:, i, j] = out[:, j, i] = _numbers(batch, f"{prefix}s{i}_{j}")
    return out


_ESTIMATE = "lang string, source string, start int, centre array<double>, precision array<double>, log_det double"


def _estimate_rows(batch: pa.RecordBatch, centre: np.ndarray, covariance: np.ndarray) -> pa.RecordBatch:
    precision = np.linalg.inv(covariance).reshape(len(centre), -1)
    lists = [pa.array(list(v), pa.list_(pa.float64())) for v in (centre, precision)]
    arrays = [*(batch.column(c) for c in ("lang", "source", "start")), *lists, pa.array(np.linalg.slogdet(covariance)[1])]
    return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "start", "centre", "precision", "log_det"])


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.select(F.struct("lang", "source", "start").alias("g"), "centre", "precision", "log_det")


def _starts(vectors: DataFrame, middle: DataFrame, few: bool) -> DataFrame:
    """The estimates to start from: one row per group and start."""
    z = _join(vectors, middle, few).select("g", F.expr("array(" + ", ".join(f"(x{i} - centre[{i}]) / sqrt(v[{i}])" for i in range(P)) + ")").alias("z"))
    z = z.withColumn("r", F.expr("greatest(sqrt(" + " + ".join(f"z[{i}] * z[{i}]" for i in range(P)) + "), 1e-9D)"))

    def score(number: int, sql: str) -> str:
        return f"struct({number} AS start, " + ", ".join(f"CAST(round({GRID} * {sql.format(f'z[{i}]')}) AS BIGINT) AS x{i}" for i in range(P)) + ")"

    scores = z.select("g", F.expr(f"explode(array({score(1, 'tanh({})')}, {score(2, '{} / r')}))").alias("y"))
    scores = scores.select(F.struct("g.lang", "g.source", F.col("y.start").alias("start")).alias("g"), *[f"y.x{i}" for i in range(P)])
    sums = _sums(scores).select(F.struct("g.lang", "g.source").alias("group"), "g", "n", *_SUMS)
    right = middle.withColumnRenamed("g", "__g")
    sums = sums.join(F.broadcast(right) if few else right, F.col("group").eqNullSafe(F.col("__g")))

    def solve(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            square = _squares(batch)
            size = np.sqrt(np.maximum(np.einsum("nii->ni", square), 1.0))
            correlation = (1 - SHRINK) * square / (size[:, :, None] * size[:, None, :])
            correlation[:, range(P), range(P)] = 1
            centre, v = (np.stack(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("centre", "v"))
            yield _estimate_rows(batch, centre, correlation * np.sqrt(v)[:, :, None] * np.sqrt(v)[:, None, :])

    scored = _as_numbers(sums, F.col("centre"), F.col("v")).mapInArrow(solve, _ESTIMATE)
    diagonal = ", ".join(f"1 / v[{i}]" if i == j else "0D" for i in range(P) for j in range(P))
    plain = middle.selectExpr("struct(g.lang AS lang, g.source AS source, 0 AS start) AS g", "centre", f"array({diagonal}) AS precision", "0D AS log_det")
    return plain.unionByName(_grouped(scored))


def _estimates(sums: DataFrame, pooled: bool) -> DataFrame:
    """Centre, inverse covariance and its determinant for each group; ``pooled``: drawn towards those of its language."""
    factor, floor = consistency(), np.diag([(GRID * s) ** 2 for _, s in COMPONENTS])

    def moments(batch: pa.RecordBatch, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = _numbers(batch, prefix + "n")
        mean = np.stack([_numbers(batch, f"{prefix}s{i}") for i in range(P)], axis=1) / n[:, None]
        return n[:, None], mean, _squares(batch, prefix) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]

    def solve(batches):
        for batch in batches:
            n, mean, cov = moments(batch, "")
            if pooled:
                _, p_mean, p_cov = moments(batch, "p_")
                own = n / (n + PRIOR_ROWS)
                mean, cov = own * mean + (1 - own) * p_mean, own[:, :, None] * cov + (1 - own)[:, :, None] * p_cov
            yield _estimate_rows(batch, mean, factor * cov + floor)

    more = [F.col(f"p_{c}").cast("double") for c in ["n", *_SUMS]] if pooled else []
    return _grouped(_as_numbers(sums, *more).mapInArrow(solve, _ESTIMATE))


def _core_sums(vectors: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """Sums over the documents of each group whose distance bins hold the core."""
    binned = _join(vectors, estimates.select("g", "centre", "precision"), few).withColumn("b", F.floor(32 * F.ln(F.greatest(_distance(), F.lit(0.0)) + 1e-6)).cast("int")).drop("centre", "precision")
    counts = binned.groupBy("g", "b").count()
    counts = counts.withColumn("upto", F.sum("count").over(W.partitionBy("g").orderBy("b"))).withColumn("n", F.sum("count").over(W.partitionBy("g")))
    limits = counts.groupBy("g").agg(F.min(F.when(F.col("upto") >= CORE * F.col("n"), F.col("b"))).alias("limit"))
    return _sums(_join(binned, limits, few).where("b <= limit"))


def _step(vectors: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """One concentration step: the next estimates, with the sums they come from."""
    sums = stored(_core_sums(vectors, estimates, few), "quality-sums")
    own = sums.select(F.col("g").alias("__g"), F.struct("n", *_SUMS).alias("sums"))
    return _estimates(sums, False).join(own, F.col("g").eqNullSafe(F.col("__g"))).drop("__g")


def _with_start(vectors: DataFrame, start: Column) -> DataFrame:
    """The vectors with the start as a further field of their group."""
    started = vectors.withColumn("start", start)
    return started.select(F.struct("g.lang", "g.source", "start").alias("g"), *[f"x{i}" for i in range(P)])


def estimate(stats: DataFrame, *, first_steps: int = FIRST_STEPS, most_steps: int = MOST_STEPS) -> DataFrame:
    """Centre and inverse covariance per (language, source): columns ``g`` (struct), ``centre``, ``precision``.

    ``first_steps`` is at least 1. ``stats`` has the columns of ``with_statistics`` and ``lang`` and ``source``; a missing language or source is a value
    of its own. Documents that fail the base rules take no part. An empty table gives no estimates.
    """
    vectors = _vectors(stats)
    middle = stored(_middle(vectors), "quality-middle")
    few = 3 * middle.count() <= BROADCAST_GROUPS
    now = stored(_starts(vectors, middle, few), "quality-starts")
    every = _with_start(vectors, F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    for _ in range(first_steps):
        now = stored(_step(every, now, few), "quality-estimates")
    # The start is 0 from here on: one estimate of each group is left.
    fields = ["centre", "precision", "log_det", "sums"]
    least = now.groupBy("g.lang", "g.source").agg(F.min_by(F.struct(*fields), F.struct("log_det", "g.start")).alias("e"))
    now = stored(least.select(F.struct("lang", "source", F.lit(0).alias("start")).alias("g"), "e.*"), "quality-least")
    single = _with_start(vectors, F.lit(0))
    for _ in range(most_steps):
        after = _step(single, now, few).select(F.col("g").alias("__g"), F.struct(*fields).alias("e"))
        lower = F.col("e.log_det") < F.col("log_det") - TOLERANCE
        taken = F.when(lower, F.col("e")).otherwise(F.struct(*fields)).alias("e")
        both = now.join(after, F.col("g").eqNullSafe(F.col("__g"))).select("g", lower.alias("lower"), taken)
        now = stored(both.select("g", "lower", "e.*"), "quality-estimates")
        if now.where("lower").isEmpty():
            break
    sums = now.select("g", "sums.*")
    # One row per group is left, so pooling by language is a join of small tables.
    pooled = sums.groupBy(F.col("g.lang").alias("l")).agg(*[F.sum(c).alias(f"p_{c}") for c in ["n", *_SUMS]])
    sums = sums.join(pooled, F.col("g.lang").eqNullSafe(F.col("l")))
    final = stored(_estimates(sums, True), "quality-estimates")
    return final.select(F.struct("g.lang", "g.source").alias("g"), "centre", "precision")


def judge(stats: DataFrame, estimates: DataFrame, *, tail: float = TAIL) -> DataFrame:
    """``stats`` with ``base_failed``, ``distance`` (squared, missing if the base rules failed) and ``kept``."""
    few = estimates.count() <= BROADCAST_GROUPS
    columns = [c for c in stats.columns if c not in ("base_failed", "distance", "kept")]
    vector = [F.expr(f"CASE WHEN n_words > 0 AND word_chars > 0 THEN CAST(round({GRID} * {sql}) AS BIGINT) END").alias(f"x{i}") for i, (sql, _) in enumerate(COMPONENTS)]
    row = stats.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.struct(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")).alias("g"), base_failed().alias("base_failed"), *vector)
    found = _join(row, estimates, few).withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(1 - tail, P), F.lit(True))
    return found.select(*[F.col(f"row.`{c}`") for c in columns], "base_failed", "distance", kept.alias("kept"))


def score_documents(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Statistics and verdict of every document: the columns of ``docs`` but its text, and those of ``judge``."""
    stats = stored(with_statistics(docs, text=text).drop(text), "quality-statistics")
    return judge(stats, estimate(stats))


def keep_good(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns. Texts are read twice instead of shuffled once."""
    few_columns = docs.select("lang", "source", F.col(f"`{text}`").alias("__doc"))
    stats = stored(with_statistics(few_columns, text="__doc").drop("__doc"), "quality-statistics")
    others = [c for c in docs.columns if c != text]
    own = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0))
    packed = docs.select(own.alias("__own"), "lang", "source", F.col(f"`{text}`").alias("__doc"))
    kept = judge(with_statistics(packed, text="__doc"), estimate(stats)).where("kept")
    return kept.select(*[F.col("__doc" if c == text else f"__own.`{c}`").alias(c) for c in docs.columns])
