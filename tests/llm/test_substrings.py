"""Operator 8 against brute force."""

import hashlib

import pytest

from basecov.llm import substrings
from basecov.llm.queries import QUERIES

LOWEST = -(1 << 63)


def removed(rows, length):
    """Words and removal flags of every row."""
    rows = [(LOWEST if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in rows:
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        out.append((i, w, gone))
    return out


@pytest.mark.parametrize("length", [13, 5, 2])
def test_equals_brute_force(docs, corpus, length):
    rows = substrings.removable(docs.selectExpr("*", "0 AS kept"), length=length).collect()
    got = sorted((LOWEST if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows)
    assert got == sorted((i, len(w), sum(g), b" ".join(x for x, y in zip(w, g) if not y).decode()) for i, w, g in removed(corpus, length))


def test_layout_keeps_the_rest_as_it_was(spark):
    shared = " ".join(f"s{i}" for i in range(13))
    rows = [(1, f"a {shared} b"), (2, f"x\n y\t{shared}\n\nz  w "), (3, shared)]
    kept = {r.doc_id: r.kept for r in substrings.removable(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), layout=True).collect()}
    assert kept == {1: rows[0][1], 2: "x\n y\tz  w ", 3: ""}


def test_stage_cuts_texts_and_keeps_columns(spark, docs, corpus):
    source = docs.selectExpr("doc_id", "text", "'en' AS lang", "length(text) AS n_chars", "7 AS doc", "8 AS marks")
    cut = substrings.cut_repeats(source)
    assert cut.columns == source.columns
    rows = cut.collect()
    assert len(rows) == len(corpus)
    got = sorted((LOWEST if r.doc_id is None else r.doc_id, " ".join(x.decode() for x in (r.text or "").encode().split())) for r in rows)
    assert got == sorted((i, b" ".join(x for x, y in zip(w, g) if not y).decode()) for i, w, g in removed(corpus, 13))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and (r.doc, r.marks) == (7, 8) for r in rows)


def test_doubling_until_nothing_survives(spark):
    long = " ".join(f"s{i}" for i in range(60))
    rows = [(1, "a " + long), (2, long + " b"), (3, " ".join(long.split()[:15])), (4, "nothing of it"), (5, None)]
    found = substrings.repeat_lengths(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), length=13)
    assert {r.doc_id: r.length for r in found.collect()} == {1: 52, 2: 52, 3: 13}


@pytest.mark.parametrize("operator", [substrings.removable, substrings.cut_repeats])
def test_texts_are_dealt_out_once(docs, operator):
    df = operator(docs.selectExpr("*", "'en' AS lang"))
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_query_and_empty_table(spark, docs, corpus, no_docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op8_doubling_substrings"](spark, str(tmp_path)).collect()
    expected = sorted(hashlib.sha256(b" ".join(x for x, y in zip(w, g) if not y)).hexdigest() for _, w, g in removed(corpus, 13))
    assert sorted(r.kept_sha256 for r in rows) == expected
    assert substrings.removable(no_docs).count() == 0 and substrings.cut_repeats(no_docs).count() == 0
