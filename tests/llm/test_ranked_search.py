"""Accumulator-limited search (operator 11) against a plain score of all documents and against SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from basecov.llm import ranked_search
from basecov.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    """(item, rank, doc, score) rows; documents without id count as the lowest."""
    counted = [(-(1 << 63) if i is None else i, Counter(terms(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in counted]
    n_docs, n_all = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, c), n in zip(counted, lengths):
            score = 0
            for t, q in Counter(terms(text)).items():
                if c[t]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 75 + 75 * n * n_docs // n_all
                    score += q * weight * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score:
                scores.append((-score, doc))
        out += [(item, r, None if d == -(1 << 63) else d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def same(rows, expected):
    return sorted(map(repr, (tuple(r) for r in rows))) == sorted(map(repr, expected))


ITEMS = [("a", "one two three"), ("b", "changed a.b x'll Über"), ("c", "a b c d e i o ao"), ("d", None), ("e", " ,. "), (None, "one one one ONE two"), ("c", "漢字 ñandú eio"), ("f", "nowhere9"), ("g", "x" * 50_000)]


@pytest.mark.parametrize("shard", [1, 40, 700, 1 << 20])
@pytest.mark.parametrize("k", [1, 3, 10])
def test_equals_plain_scores(spark, docs, corpus, k, shard):
    rng = random.Random(1)
    more = [(f"i{j}", " ".join(rng.sample((corpus[j][1] or "x").split() or ["y"], 1) + rng.choices((corpus[-j][1] or "x").split() or ["y"], k=12))) for j in range(25)]
    items = spark.createDataFrame(ITEMS + more, "item_id STRING, text STRING")
    found = ranked_search.rank(docs.selectExpr("*", "1 AS score", "2 AS query"), items, k=k, shard_postings=shard)
    assert same(found.collect(), plain(corpus, ITEMS + more, k))


def test_blocks_of_queries_make_no_difference(spark, docs, corpus):
    items = spark.createDataFrame(ITEMS, "item_id STRING, text STRING")
    assert same(ranked_search.rank(docs, items, block_bytes=20_000).collect(), plain(corpus, ITEMS, 10))


def test_accumulators_are_limited_and_nothing_is_lost():
    """A rare term lifts k documents so far that the frequent ones create no accumulator."""
    rng = np.random.default_rng(2)
    n, k = 500, 5
    has = np.zeros((n, 4), np.int64)
    has[:8, 0] = 3
    has[:, 1:] = rng.integers(0, 4, (n, 3))
    doc, term = np.nonzero(has)
    shard = ranked_search.Shard(4, np.bincount(doc, minlength=n), term, has[doc, term], np.full(n, 100))
    weights = np.array([50_000, 40, 30, 20])
    at, scores, created = shard.best(np.arange(4), weights, k, 0)
    assert created == 1 and len(at) <= 8
    exact = sum(w * ((10**9 * has[:, t]) // (1000 * has[:, t] + 800)) for t, w in enumerate(weights.tolist()))
    best = sorted(zip(-exact, range(n)))[:k]
    assert sorted(zip((-scores).tolist(), at.tolist()))[:k] == best
    # a score found elsewhere: nothing here can reach it
    assert len(shard.best(np.arange(4), weights, k, int(exact.max()) * 2)[0]) == 0
    assert not shard.sums.any()


def test_lengths_beyond_64_bits():
    n = np.array([1, 10**9], np.int64)
    assert ranked_search.length_norm(n, 10**11, 10**14).tolist() == [25 + 75 * x * 10**11 // 10**14 for x in n.tolist()]


def test_no_documents_or_items(spark, docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id STRING, text STRING")
    assert ranked_search.rank(no_docs, items).count() == 0
    assert ranked_search.rank(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/{sf}/{name}.parquet'")
    found = QUERIES["op11_limited_accumulators"](spark, f"/root/testdata/{sf}").collect()
    expected = con.execute(ORACLES["op11_limited_accumulators"]).fetchall()
    assert found and same(found, expected)
