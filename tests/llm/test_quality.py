"""Operator 3: statistics against brute force, outliers against the same method in numpy."""

import math
from collections import Counter

import numpy as np
import pytest

from basecov.llm import quality
from basecov.llm.queries import QUERIES


def brute(text):
    text = text or ""
    w = text.encode().split()
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated)


def test_statistics(docs):
    rows = quality.with_statistics(docs.selectExpr("*", "'x' AS n_words")).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)


@pytest.mark.parametrize("text", ["a a a a", "x\n\nx\n \n \nx", "#a# |\n*", "é é\né é\né", " a b\x0bc", "a b c a b c a b"])
def test_small_texts(spark, text):
    (r,) = quality.with_statistics(spark.createDataFrame([(text,)], "text STRING")).collect()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text)


def test_chi_squared():
    # Fixed values of the tables.
    assert quality.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    assert quality.chi2_cdf(3.841459, 1) == pytest.approx(0.95, abs=1e-6)
    sample = np.random.default_rng(0).normal(size=(200_000, quality.P))
    core = sample[np.argsort((sample**2).sum(axis=1))[: int(0.75 * len(sample))]]
    assert quality.consistency(0.75) * core.var() == pytest.approx(1, abs=0.02)


def _rows(rng, n=400):
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(list("abcdefg"), rng.integers(2, 8))) for _ in range(rng.integers(60, 300))]
        if i % 20 == 0:
            words = [x + "%%%" for x in words]
        rows.append((i, " ".join(words), "en" if i % 3 else None, "s1" if i < n // 2 else "s2"))
    return rows


@pytest.fixture(scope="module")
def mixed(spark):
    rows = _rows(np.random.default_rng(5)) + [(1000, None, "en", "s1"), (1001, "", None, None), (1002, "too short", "xx", "s9"), (5, "x " * 90, "en", "s1")]
    return rows, spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING")


def _step(x, centre, precision, floors):
    """The core around an estimate, and the centre and precision of the core."""
    d = np.einsum("ni,ij,nj->n", x - centre, precision, x - centre)
    b = np.floor(32 * np.log(np.maximum(d, 0) + 1e-6))
    core = x[b <= np.sort(b)[math.ceil(quality.CORE * len(x)) - 1]]
    cov = np.cov(core.T, bias=True).reshape(quality.P, quality.P)
    return core, core.mean(axis=0), np.linalg.inv(quality.consistency() * cov + floors)


def _method(rows):
    """The estimates of each group by plain numpy."""
    groups = {}
    for _, text, lang, source in rows:
        n, chars, symbols, dup, rep = brute(text)
        if n < 50 or 100 * rep > 50 * n:
            continue
        v = (math.log(chars / n), math.log(1 + 20 * symbols / n), math.sqrt(dup / n), math.sqrt(rep / n), math.log(n))
        groups.setdefault((lang, source), []).append([round(quality.GRID * x) for x in v])
    floors = np.diag([(quality.GRID * s) ** 2 for _, s in quality.COMPONENTS])
    widths = np.array([max(1, round(quality.GRID * s / 32)) for _, s in quality.COMPONENTS])
    sums = {}
    for g, x in groups.items():
        x = np.array(x, float)
        bins = np.sort(np.floor(x / widths), axis=0)
        low, mid, high = ((bins[math.ceil(q * len(x)) - 1] + 0.5) * widths for q in (0.25, 0.5, 0.75))
        v = ((high - low) / 1.349) ** 2 + np.diag(floors)
        z = (x - mid) / np.sqrt(v)
        far = np.maximum(np.sqrt((z**2).sum(axis=1)), 1e-9)
        tried = [np.diag(1 / v)]
        for y in (np.round(quality.GRID * np.tanh(z)), np.round(quality.GRID * z / far[:, None])):
            square = y.T @ y
            size = np.sqrt(np.maximum(np.diag(square), 1))
            r = (1 - quality.SHRINK) * square / np.outer(size, size)
            np.fill_diagonal(r, 1)
            tried.append(np.linalg.inv(r * np.sqrt(np.outer(v, v))))
        starts = []
        for precision in tried:
            e = mid, precision
            for _ in range(quality.FIRST_STEPS):
                core, *e = _step(x, *e, floors)
            starts.append((-np.linalg.slogdet(e[1])[1], len(starts), e, core))
        now, _, e, core = min(starts, key=lambda row: row[:2])
        for _ in range(quality.MOST_STEPS):
            next_core, *next_e = _step(x, *e, floors)
            then = -np.linalg.slogdet(next_e[1])[1]
            if then >= now - quality.TOLERANCE:
                break
            now, e, core = then, next_e, next_core
        centre, cov = e[0], np.cov(core.T, bias=True).reshape(quality.P, quality.P)
        sums[g] = len(core), centre, cov
    out = {}
    for (lang, source), (n, centre, cov) in sums.items():
        same = [s for (other, _), s in sums.items() if other == lang]
        total = sum(s[0] for s in same)
        p_centre = sum(s[0] * s[1] for s in same) / total
        p_cov = sum(s[0] * (s[2] + np.outer(s[1], s[1])) for s in same) / total - np.outer(p_centre, p_centre)
        own = n / (n + quality.PRIOR_ROWS)
        out[lang, source] = own * centre + (1 - own) * p_centre, np.linalg.inv(quality.consistency() * (own * cov + (1 - own) * p_cov) + floors)
    return out


def test_estimates_and_verdicts(mixed):
    rows, df = mixed
    judged = {(r.doc_id, r.n_words): r for r in quality.score_documents(df).collect()}
    estimates = _method(rows)
    limit = quality.chi2_quantile(1 - quality.TAIL, quality.P)
    rejected = 0
    for doc, text, lang, source in rows:
        n, chars, symbols, dup, rep = brute(text)
        r = judged[doc, n]
        failed = n < 50 or 100 * rep > 50 * n
        assert r.base_failed == failed
        if failed:
            assert r.distance is None and not r.kept
            continue
        v = np.array([round(quality.GRID * x) for x in (math.log(chars / n), math.log(1 + 20 * symbols / n), math.sqrt(dup / n), math.sqrt(rep / n), math.log(n))], float)
        centre, precision = estimates[lang, source]
        distance = (v - centre) @ precision @ (v - centre)
        assert r.distance == pytest.approx(distance, rel=1e-6)
        assert r.kept == (distance <= limit)
        rejected += not r.kept
    assert rejected == 20  # every document with symbols and no other


def test_the_least_determinant_is_taken(spark):
    """A group whose quartiles alone start from the wrong core: the chosen estimate has the least determinant of all starts."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        ln_n = rng.uniform(4.2, 8) if i % 5 < 3 else rng.normal(7.5, 0.05)
        tilt = rng.normal(0, 0.02) + (0.4 * (ln_n - 6) if i % 5 < 3 else -0.6)
        n = int(math.exp(ln_n))
        rows.append((i, n, int(n * math.exp(1.5 + tilt)), 0, 0, 0))
    stats = spark.createDataFrame(rows, "doc_id BIGINT, n_words BIGINT, word_chars BIGINT, n_symbols BIGINT, n_dup_lines BIGINT, n_repeat_words BIGINT")
    stats = stats.selectExpr("*", "'en' AS lang", "CAST(NULL AS STRING) AS source")
    vectors = quality._vectors(stats)
    middle = quality._middle(vectors)
    now = quality._starts(vectors, middle, True)
    every = quality._with_start(vectors, quality.F.explode(quality.F.array(*map(quality.F.lit, range(3)))))
    for _ in range(quality.FIRST_STEPS):
        now = quality.stored(quality._estimates(quality._core_sums(every, now, True), False), "quality-test")
    dets = {r.start: r.log_det for r in now.select("g.start", "log_det").collect()}
    assert set(dets) == {0, 1, 2} and len({round(d, 6) for d in dets.values()}) > 1
    (chosen,) = quality.estimate(stats).collect()
    precision = np.array(chosen.precision).reshape(quality.P, quality.P)
    assert -np.linalg.slogdet(precision)[1] <= min(dets.values()) + 1e-6
    assert len(quality.estimate(stats, most_steps=1).collect()) == 1


def test_filter_keeps_columns(mixed):
    rows, df = mixed
    extra = df.selectExpr("*", "'x' AS kept", "1 AS distance")
    kept = quality.keep_good(extra)
    assert kept.columns == extra.columns and kept.count() == 380
    assert {r.kept for r in kept.select("kept").collect()} == {"x"}


def test_empty_table(mixed):
    _, df = mixed
    assert quality.score_documents(df.limit(0)).count() == 0 and quality.keep_good(df.limit(0)).count() == 0


def test_query_is_the_operator(spark, mixed, tmp_path):
    _, df = mixed
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op3_robust_quality"](spark, str(tmp_path)).collect()
    assert len(rows) == df.count() and sum(r.kept for r in rows) == 380
