"""The pipeline, stage by stage, against brute force; each stage on what the one before kept."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_decontaminate import brute as contamination
from test_jaccard import brute as groups
from test_substrings import removed

import corpus_pipeline
from basecov.llm.bpe import read_ranks

COLUMNS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefg"), rng.integers(2, 8))) for _ in range(3000)]

    def text(n):
        return " ".join(rng.choice(words, n))

    passage, item = text(60), text(40)
    rows = []
    for i in range(220):
        body = text(rng.integers(60, 200))
        if i % 11 == 0:
            body = " ".join(w + "###" for w in body.split())
        if i % 20 == 3:
            body = body + " " + passage
        if i % 25 == 4:
            body = item + " " + body
        rows.append((i, body))
    rows += [(1000 + i, rows[i][1].replace(rows[i][1].split()[5], "changed")) for i in range(0, 60, 5)]
    rows += [(2000, rows[1][1]), (2001, "too short"), (2002, None), (2003, "")]
    path = tmp_path_factory.mktemp("pipeline")
    table = [(i, t, "en" if i % 2 else "fr", "s1" if i % 3 else "s2", 0 if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(table, COLUMNS).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, text(30))], "item_id BIGINT, text STRING").write.parquet(str(path / "benchmark.parquet"))
    return str(path), table, [(1, item)]


def test_every_stage_works_on_what_the_last_one_kept(spark, folder, tmp_path):
    path, table, items = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "token_ids":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = {i: t for i, t, *_ in table if t and len(t.split()) >= 50 and "#" not in t}
    assert {i: r.text for i, r in kept["quality_rules"].items()} == good
    smallest = {i for i, _, c in groups(list(good.items()), 5, 80) if i == c}
    assert set(kept["near_duplicates"]) == smallest and len(smallest) < len(good)
    left = {i: " ".join(x.decode() for x, gone in zip(w, g) if not gone) for i, w, g in removed([(i, good[i]) for i in smallest], 13)}
    assert {i: " ".join(r.text.split()) for i, r in kept["substring_dedup"].items()} == left
    assert any(left[i] != good[i] for i in smallest) and all(r.n_chars == len(r.text) for r in kept["substring_dedup"].values())
    clean = {i for i, (n, hit, _) in zip(left, contamination(left.values(), items)) if not hit or 20 * hit < n}
    assert set(kept["decontamination"]) == clean and len(clean) < len(left)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(f.read()), special_tokens={})
    for i in clean:
        text = kept["decontamination"][i].text
        ids = encoding.encode_ordinary(text)
        row = kept["token_ids"][i]
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert set(kept["token_ids"]) == clean
    # The whole run gives the last stage's rows.
    assert {tuple(r) for r in corpus_pipeline.run(spark, path).collect()} == {tuple(r) for r in kept["token_ids"].values()}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id BIGINT, text STRING").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
