"""Operator 7 and connected components against brute force."""

import itertools

import numpy as np
import pytest

from basecov.llm import jaccard
from basecov.llm.components import components
from basecov.llm.queries import QUERIES

LOWEST = -(1 << 63)


def brute(rows, length, percent):
    sets = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        grams = {tuple(w[k : k + length]) for k in range(len(w) - length + 1)} or ({tuple(w)} if w else set())
        sets.append((LOWEST if i is None else i, grams))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        both = len(s & t)
        if both and 100 * both >= percent * (len(s) + len(t) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def result(df):
    return sorted((LOWEST if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize(("length", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_equals_brute_force(docs, corpus, length, percent):
    found = jaccard.linked(docs.selectExpr("*", "1 AS n_shingles", "2 AS component_id"), length=length, percent=percent)
    assert result(found) == brute(corpus, length, percent)


@pytest.mark.parametrize(("small", "block"), [(16, 128), (2, 7)])
def test_groups_near_the_threshold(spark, monkeypatch, small, block):
    """Many texts made from one by a few changes: most pairs lie close to the threshold on either side."""
    monkeypatch.setattr(jaccard, "SMALL_GROUP", small)
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", block)
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.choice(60, rng.integers(0, 5), replace=False):
            words[at] = f"z{rng.integers(0, 40)}"
        rows.append((i, " ".join(words[: rng.integers(50, 61)])))
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    for length, percent in ((1, 90), (3, 80)):
        assert result(jaccard.linked(df, length=length, percent=percent)) == brute(rows, length, percent)


def test_many_partners_of_one_centre(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_MEMBERS", 4)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    rows = [(i, " ".join(f"w{k}" for k in range(40)) + f" t{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    assert result(jaccard.linked(df, length=3, percent=90)) == brute(rows, 3, 90)


def test_bands_hold_all_similar_sizes():
    for percent in (60, 80, 90, 99):
        bands = jaccard.Bands(percent, 3000)
        for a in range(1, 400):
            b = a * 100 // percent
            band = bands.of(np.array([a, b]))
            assert band[1] - band[0] in (0, 1)
            for size in range(a, b + 1):
                # Sets of these sizes at the threshold differ in no more than the band allows.
                both = -(-percent * (a + size) // (100 + percent))
                if both <= a:
                    assert a + size - 2 * both <= bands.differ[band[0]]


def test_one_of_each_group(docs, corpus, no_docs):
    kept = jaccard.one_of_each_group(docs, length=5, percent=80)
    expected = sum(i == c for i, _, c in brute(corpus, 5, 80))
    assert kept.columns == docs.columns and kept.count() == expected
    assert jaccard.one_of_each_group(no_docs, length=5, percent=80).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50, 90)] + [(7, 3), (3, 7), (9, 9), (None, 4), (200, 1), (200, 2)]
    found = components(spark.createDataFrame(edges, "a BIGINT, b BIGINT"), "a", "b")
    expected = {i: 50 for i in range(50, 91)} | {3: 3, 7: 3, 200: 1, 1: 1, 2: 1}
    assert {r.node: r.component for r in found.collect()} == expected
    assert found.count() == len(expected)


def test_query(spark, docs, corpus, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert result(QUERIES["op7_parity_jaccard"](spark, str(tmp_path))) == brute(corpus, 3, 90)
