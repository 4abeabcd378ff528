"""Dynamic counting of phrases (operator 12) against plain counts and against SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from basecov.llm import collocations as C
from basecov.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top, percent):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        n, found = sum(v for p, v in c.items() if len(p) == 1), []
        for p, a in c.items():
            if len(p) == 1 or a < least:
                continue
            cuts = [(1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p))]
            longer = [v for q, v in c.items() if len(p) == 2 and len(q) == 3 and v >= least and p in (q[:2], q[1:])]
            if any(100 * v >= percent * a for v in longer):
                continue
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def texts(n=260, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Über", "漢字", "it's", "A", "a", "x" * 300]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, weights=[60 / (j + 1) for j in range(len(vocabulary))], k=rng.choice([0, 1, 2, 3, 30, 90]))
        if rng.random() < 0.3:
            words += ["New", "York", "city"] + (["hall"] if rng.random() < 0.5 else [])
        rows.append((rng.choice(["en", "de", None, "und", ""]), "".join(w + rng.choice([" "] * 9 + ["  ", "\t ", ". ", ",", "\n", "\x0b"]) for w in words)))
    return rows + [("en", None), (None, None), ("de", ""), ("en", "the same line " * 50), ("fr", ". , ;")] + [("en", "hot pair here")] * 60


@pytest.mark.parametrize("options", [{}, {"shards": 1}, {"shards": 7}, {"shards": 3, "cells": 16}, {"least": 3, "top": 5}, {"covered_percent": 101}])
def test_equals_plain_counts(spark, options, monkeypatch):
    monkeypatch.setattr(C, "BUFFER", 500)
    rows = texts()
    docs = spark.createDataFrame(rows, "lang STRING, text STRING").repartition(4).selectExpr("*", "1 AS n", "2 AS shard")
    found = C.collocations(docs, **options).collect()
    expected = plain(rows, options.get("least", 10), options.get("top", 2000), options.get("covered_percent", 50))
    assert sorted(map(tuple, found)) == expected and len(expected) > 10


def test_lengths_interleave(spark):
    """Pairs of frequent words are counted while words still are, and phrases that begin late end after one cycle."""
    rows = [("en", "one two three four") for _ in range(400)] + [("en", f"rare {i} words")for i in range(9)]
    docs = spark.createDataFrame(rows, "lang STRING, text STRING").repartition(4)
    counting = C.Counting(docs, "text", "lang", 10, 4, 1 << 16)
    begun = []
    count = counting.count_phrases
    counting.count_phrases = lambda step: begun.append(step) or count(step)
    counting.run()
    assert begun[0] == 1 and counting.steps == 6  # pairs in steps 1-4, triples in steps 2-5
    assert [r.n for r in counting.phrases().collect()] == [400] * 5
    assert len(counting.done) > 2 and counting.phrases()._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1


def test_cells_older_than_the_words(spark):
    """A pair whose cells were written by others before its words reached the threshold begins no cycle that has passed."""
    key, joined = np.array([5, 6, 7], np.uint64), np.array([True, True, False])
    tables = (np.full(16, 2, np.uint8), np.full(16, 0, np.uint8))
    assert C.active_phrases(key, joined, tables, 3, 4)[3].tolist() == [3, 3, 3]  # two pairs and the triple
    rng = random.Random(8)
    rows = [("en", f"p{i}a p{i}b p{i}c") for i in range(300) for _ in range(rng.choice([10, 11, 12, 14, 20]))]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "lang STRING, text STRING").repartition(4)
    assert sorted(map(tuple, C.collocations(docs, cells=256).collect())) == plain(rows, 10, 2000, 50)


def test_phrases_with_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(C, "mix", lambda keys: keys & np.uint64(1))
    rng = np.random.default_rng(4)
    a, b, c = (rng.integers(0, 3, 500).astype(np.uint64) for _ in range(3))
    _, x, y, z, act, n, before = C.summed([a, b, c, np.ones(500, np.int16), np.ones(500, np.int64)], np.zeros(500, np.int64))
    assert Counter(zip(a.tolist(), b.tolist(), c.tolist())) == dict(zip(zip(x.tolist(), y.tolist(), z.tolist()), n.tolist())) and len(n) == 27


def test_large_counts_are_exact(spark):
    row = spark.range(1).selectExpr("7000000000001L AS f", "7000000000003L AS l", "9000000000007L AS r").selectExpr(f"{C._score('f', 'l', 'r')} AS s").first()
    assert row.s == 1_000_000 * 7000000000001**2 // (7000000000003 * 9000000000007)


def test_no_texts(spark):
    assert C.collocations(spark.createDataFrame([], "lang STRING, text STRING")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    found = QUERIES["op12_dynamic_collocations"](spark, f"/root/testdata/{sf}").collect()
    assert sorted(map(tuple, found)) == sorted(con.execute(ORACLES["op12_dynamic_collocations"]).fetchall())
