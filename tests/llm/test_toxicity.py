"""Operator 5: held-out accuracy, and what the swap penalty does to group mentions."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from basecov.llm import toxicity
from basecov.llm.queries import QUERIES


def _rows(rng, n=1500):
    calm, bad = [f"calm{i}" for i in range(60)], ["scumbag", "moronic", "vilestuff"]
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = rng.choices(calm, k=30) + (rng.choices(bad, k=2) if toxic else [])
        # one group is named mostly in toxic texts, another in neutral ones
        if rng.random() < (0.6 if toxic else 0.05):
            words.append("Muslims")
        elif rng.random() < 0.3:
            words.append("Christians")
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = _rows(random.Random(3))
    extra = [(5000, None), (5001, ""), (None, "calm1 scumbag"), (7, "calm2"), (5002, "calm1 " * 20_000 + "scumbag moronic")]
    docs = spark.createDataFrame([r[:2] for r in rows] + extra, "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(3, None), (None, 1), (4, 7), (99_999, 1)], "doc_id BIGINT, toxic INT")
    return rows, docs, labels


def test_held_out_accuracy_and_range(tables):
    rows, docs, labels = tables
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs.selectExpr("*", "'x' AS score"), model).withColumn("held", toxicity.held_out("doc_id")).collect()
    truth = {i: t for i, _, t in rows}
    held = [r for r in scored if r.doc_id in truth and r.held and r.doc_id != 7]
    assert len(held) > 200 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored if r.doc_id is not None)
    by_id = {r.doc_id: r for r in scored}
    assert by_id[5000].score == by_id[5001].score < 0.5 and by_id[5002].predicted == 1


def test_swap_penalty_evens_out_group_mentions(tables):
    _, docs, labels = tables
    weight = {}
    for penalty in (0.0, toxicity.SWAP_PENALTY):
        model = toxicity.train(docs, labels, swap_penalty=penalty)
        a, b = (model.weights[np.searchsorted(model.keys, toxicity.word_keys([w])[0])] for w in ("muslims", "christians"))
        weight[penalty] = abs(a - b)
    assert weight[0.0] > 0.2 and weight[toxicity.SWAP_PENALTY] < 0.2 * weight[0.0]


def test_identity_terms_are_single_words_of_one_row():
    terms = [t for rows in toxicity.IDENTITY_TERMS.values() for row in rows for t in row]
    assert len(set(terms)) == len(terms) and all(t == t.lower() and t.isalpha() for t in terms)
    assert all(len(row) > 1 for rows in toxicity.IDENTITY_TERMS.values() for row in rows)
    keys, others = toxicity._swaps()
    assert len(keys) == len(terms) == len(set(keys.tolist())) and set(others[0].tolist()) == set(keys.tolist())


@pytest.mark.parametrize("named, other", [("muslims", "christians"), ("muslime", "christen"), ("musulmans", "chrétiens"), ("musulmanes", "cristianos")])
def test_neutral_mentions_are_not_toxic(spark, named, other):
    """A group named mostly in toxic texts, in every language; its neutral mentions must score like those of another."""
    rng = random.Random(9)
    rows = [(i, t.replace("Muslims", named).replace("Christians", other), toxic) for i, t, toxic in _rows(rng)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id BIGINT, toxic INT")
    calm = [" ".join(rng.choices([f"calm{i}" for i in range(60)], k=20)) for _ in range(40)]
    asked = spark.createDataFrame([(i, f"{text} {word}", word) for i, text in enumerate(calm) for word in (named, other)], "i INT, text STRING, word STRING")
    gap = {}
    for penalty in (0.0, toxicity.SWAP_PENALTY):
        model = toxicity.train(docs, labels, swap_penalty=penalty)
        found = {(r.i, r.word): r.score for r in toxicity.score(asked, model).collect()}
        gap[penalty] = max(abs(np.log(found[i, named] / (1 - found[i, named])) - np.log(found[i, other] / (1 - found[i, other]))) for i in range(40))
    assert max(found.values()) < 0.5 and gap[0.0] > 0.5 and gap[toxicity.SWAP_PENALTY] < 0.2 * gap[0.0]


def test_scores_equal_a_plain_sum(spark, tables):
    """Words and their beginnings one by one, weights from a dictionary."""
    _, docs, labels = tables
    model = toxicity.train(docs, labels)
    weights = dict(zip(model.keys.tolist(), model.weights.tolist()))

    def plain(text):
        seen = set()
        for word in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower()):
            (w,) = list(toxicity.pieces(pa.array([word.decode()]), toxicity.NOT_ALNUM_TABLE, lower=True))
            seen.add(int(w.key[0]))
            begun = [toxicity.prefix_keys(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]), (k,), lower=True)[0][0] for k in toxicity.PREFIXES if len(word) > k]
            seen.update(int(k) for k in begun)
        total = model.bias + sum(weights.get(k, 0.0) for k in seen)
        return 1 / (1 + np.exp(-total))

    texts = [None, "", "Scumbag", "calm1 MUSLIMS moronic", "vilestuff vilestuff", "a.b;scumbags-42", "ÄÖ scumbag über", "moroni moronic moronical"]
    texts += [r.text for r in docs.where("doc_id < 60").collect()]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, text STRING")
    for r in toxicity.score(asked, model).collect():
        assert r.score == pytest.approx(plain(texts[r.i]), abs=1e-9)


def test_the_fit_is_at_the_minimum():
    rng = np.random.default_rng(1)
    features = [np.flatnonzero(rng.random(6) < 0.4).astype(np.int32) for _ in range(200)]
    labels = np.array([int(0 in f and rng.random() < 0.9) for f in features])
    twins = [np.setdiff1d(np.append(f, 2), [1]).astype(np.int32) if 1 in f else None for f in features]
    weights, bias = toxicity.fit(features, twins, labels, 6, ridge=0.5, swap_penalty=2.0)

    def loss(v):
        z = np.array([v[f].sum() + v[-1] for f in features])
        swaps = sum((v[f].sum() - v[t].sum()) ** 2 for f, t in zip(features, twins) if t is not None)
        return np.logaddexp(0, z).sum() - (labels * z).sum() + 0.25 * (v[:-1] ** 2).sum() + 0.0005 * v[-1] ** 2 + 2.0 * swaps

    at = np.append(weights, bias)
    for _ in range(200):
        assert loss(at) <= loss(at + rng.normal(size=7) * 0.01) + 1e-9


def test_without_labels(tables, no_docs):
    _, docs, labels = tables
    model = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.5}
    assert toxicity.score(no_docs, model).count() == 0


def test_query(spark, tables, tmp_path):
    rows, docs, labels = tables
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    found = QUERIES["op5_counterfactual_toxicity"](spark, str(tmp_path)).collect()
    assert len(found) == docs.count() and [f for f in found[0].asDict()] == ["doc_id", "held_out", "score", "predicted"]
