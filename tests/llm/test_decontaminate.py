"""Operator 10 against brute force."""

import hashlib
import re

import pytest

from basecov.llm import decontaminate
from basecov.llm.queries import QUERIES

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute(texts, items, window=13):
    wanted = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wanted.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in wanted}:
            for k in range(len(w) - n + 1):
                who = wanted.get(tuple(w[k : k + n]))
                if who:
                    hit.update(range(k, k + n))
                    found |= who
        out.append((len(w), len(hit), sorted(map(str, found))))
    return out


@pytest.fixture(scope="module")
def items(corpus):
    texts = {i: t for i, t in corpus}
    passage = " ".join((texts[300] or "").split()[25:70])
    return [(1, passage), (2, passage.upper()), (3, "zz qq"), (4, None), (5, ""), (6, "One, two!"), (7, " ".join(texts[404].split()[100:130])), (7, "changed"), (None, "three")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_equals_brute_force(spark, docs, items, block_bytes):
    benchmark = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    rows = decontaminate.match_benchmark(docs.selectExpr("*", "'x' AS n_hit"), benchmark, block_bytes=block_bytes).collect()
    expected = brute([r.text for r in rows], [(-1 if i is None else i, t) for i, t in items])
    assert [(r.n_words, r.n_hit, sorted({str(m.item_id) for m in r.matches})) for r in rows] == expected
    assert any(n for _, n, _ in expected)
    for r in rows:
        for m in r.matches:
            own = words(r.text)[m.doc_start : m.doc_start + m.n_words]
            assert any(words(t)[m.item_start : m.item_start + m.n_words] == own for i, t in items if i == m.item_id or (i is None and m.item_id == -1))


def test_blocks_are_one_pass(spark, docs, items):
    """However many blocks the items make, the documents go to one Python worker once; items without an id keep theirs."""
    benchmark = spark.createDataFrame(items, "item_id BIGINT, text STRING").repartition(2)
    found = decontaminate.match_benchmark(docs, benchmark, block_bytes=60)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    wide = decontaminate.match_benchmark(docs, benchmark)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, wide.collect()))


def test_longest_matches_are_whole(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "a b " + text + " c")], "doc_id BIGINT, text STRING")
    (row,) = decontaminate.match_benchmark(docs, spark.createDataFrame([(9, text)], "item_id BIGINT, text STRING")).collect()
    assert [m.asDict() for m in row.matches] == [{"item_id": 9, "item_start": 0, "doc_start": 2, "n_words": 40}]


def test_matches_end_with_their_item_and_document(spark):
    """Items of one word follow each other in the block of test words, and documents in the piece of text."""
    items = [(1, "zz"), (2, "yy xx"), (3, "xx"), (4, "ww")]
    texts = ["a zz yy xx ww b", "zz", "yy xx", "xx ww", "zz", "yy"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING").coalesce(1)
    rows = decontaminate.match_benchmark(docs, spark.createDataFrame(items, "item_id BIGINT, text STRING").coalesce(1)).orderBy("doc_id").collect()
    assert [[(m.item_id, m.item_start, m.doc_start, m.n_words) for m in r.matches] for r in rows] == [
        [(1, 0, 1, 1), (2, 0, 2, 2), (3, 0, 3, 1), (4, 0, 4, 1)],
        [(1, 0, 0, 1)],
        [(2, 0, 0, 2), (3, 0, 1, 1)],
        [(3, 0, 0, 1), (4, 0, 1, 1)],
        [(1, 0, 0, 1)],
        [],
    ]


def test_removal_and_empty_tables(spark, docs, no_docs, corpus, items):
    benchmark = spark.createDataFrame(items[:2], "item_id BIGINT, text STRING")
    kept = decontaminate.remove_contaminated(docs, benchmark)
    gone = [t for (_, t), (n, hit, _) in zip(corpus, brute([t for _, t in corpus], items[:2])) if hit and 20 * hit >= n]
    assert kept.columns == docs.columns and kept.count() == len(corpus) - len(gone) and gone
    assert decontaminate.remove_contaminated(docs, benchmark.limit(0)).count() == len(corpus)
    assert decontaminate.match_benchmark(no_docs, benchmark).count() == 0


def test_query(spark, tmp_path, docs, items):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id BIGINT, text STRING").where("item_id IS NOT NULL").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = QUERIES["op10_suffix_decontamination"](spark, str(tmp_path)).collect()
    texts = [r.text for r in docs.collect()]
    expected = sorted((n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), bool(h) and 20 * h >= n) for n, h, i in brute(texts, [x for x in items if x[0] is not None]))
    assert sorted((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows) == expected
