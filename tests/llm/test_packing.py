"""Hierarchical best-fit packing (operator 13)."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from basecov.llm import packing
from basecov.llm.queries import QUERIES

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def least(lengths, room):
    return -(-sum(lengths) // room)


def check(rows, room):
    """Every sequence is gapless from 0 and not too long; the number of sequences."""
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= room
    return len(held)


def plain_best_fit(lengths, room):
    free = []
    for n in sorted(lengths, reverse=True):
        fitting = [f for f in free if f >= n]
        if fitting:
            free.remove(min(fitting))
            free.append(min(fitting) - n)
        else:
            free.append(room - n)
    return len(free)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_equals_a_plain_one(seed):
    rng = random.Random(seed)
    room = rng.choice([10, 64, 1024])
    lengths = np.array([rng.randint(1, room) for _ in range(rng.choice([0, 1, 50, 400]))], np.int64)
    bins, offsets, fills = packing.best_fit(lengths, room)
    rows = [{"sequence_id": b, "offset": o, "length": n} for b, o, n in zip(bins, offsets, lengths)]
    assert check(rows, room) == plain_best_fit(lengths.tolist(), room)
    assert all(fills[i] == lengths[bins == bins[i]].sum() for i in range(len(lengths)))


def test_only_long_documents_are_cut():
    assert packing.cut_lengths(5, 4) == [1, 4] and packing.cut_lengths(8, 4) == [4, 4] and packing.cut_lengths(4, 4) == [4] and packing.cut_lengths(1, 4) == [1]


@pytest.mark.parametrize("options", [{}, {"per_node": 60, "fan_in": 2, "carried": 1000}, {"per_node": 25, "fan_in": 3, "carried": 4, "slack": 0.05}])
def test_rounds_keep_every_item_and_stay_near_the_least(spark, tmp_path, options):
    rng = random.Random(3)
    rows = [(i, rng.choice([rng.randint(1, 30), rng.randint(1, 127), 128])) for i in range(800)]
    spark.createDataFrame(rows, "item BIGINT, length BIGINT").repartition(5).write.parquet(str(tmp_path / "p"))
    packed = packing.pack(spark.read.parquet(str(tmp_path / "p")), 128, **options).collect()
    assert sorted((r["item"], r["length"]) for r in packed) == rows
    n = check([r.asDict() for r in packed], 128)
    assert n <= least([x for _, x in rows], 128) * (1.03 if options.get("carried", 1000) >= 1000 else 1.3)


def test_nodes_are_merged(spark, tmp_path):
    """Each node alone leaves gaps that only another node's bins fill."""
    spark.range(400).selectExpr("id AS item", "if(id < 200, 70L, 30L) AS length").write.parquet(str(tmp_path / "p"))
    packed = packing.pack(spark.read.parquet(str(tmp_path / "p")), 100, per_node=10, fan_in=4).collect()
    merged = check([r.asDict() for r in packed], 100)
    alone = packing.pack(spark.read.parquet(str(tmp_path / "p")), 100, per_node=10, fan_in=4, carried=0).collect()
    assert 200 <= merged <= 216 < check([r.asDict() for r in alone], 100)


def test_documents_of_every_kind(spark, docs, corpus):
    rows = packing.pack_documents(docs.selectExpr("*", "1 AS item", "2 AS length"), BYTE_BPE, end_id=2, sequence=100, with_ids=True, per_node=30).cache()
    found = rows.collect()
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    tokenizer.encode_special_tokens = True
    expected = sorted(([-1 if i is None else i] + [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in corpus)
    check([r.asDict() for r in found], 100)
    texts, by_place = [], {}
    for r in found:
        by_place[r.sequence_id, r.offset] = r
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    pieces = sorted(found, key=lambda r: r.item)
    for r in pieces:
        if r.piece == 0:
            texts.append([-1 if r.doc_id is None else r.doc_id])
        assert r.start == len(texts[-1]) - 1 and (r.length == 100 or r.piece == 0)
        texts[-1] += np.frombuffer(r.ids, "<u4").tolist()
    assert sorted(texts) == expected
    for s in packing.sequences(rows).collect():
        assert len(s.ids) == 4 * s.n_tokens <= 400
        first = by_place[s.sequence_id, 0]
        assert bytes(s.ids)[: 4 * first.length] == bytes(first.ids)


def test_no_documents(no_docs):
    assert packing.pack_documents(no_docs, BYTE_BPE, end_id=2).count() == 0


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in QUERIES["op13_residual_packing"](spark, sf).collect()]
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    pieces = {(r["doc_id"], r["piece"]): r for r in rows}
    assert len(pieces) == len(rows)
    total = 0
    for doc in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(doc.text or "", add_special_tokens=False).ids, 2], "<u4")
        total, at = total + len(ids), 0
        for k, n in enumerate(packing.cut_lengths(len(ids), 1024)):
            r = pieces.pop((doc.doc_id, k))
            assert (r["start"], r["length"], r["ids_crc32"]) == (at, n, zlib.crc32(ids[at : at + n].tobytes()))
            at += n
    assert not pieces
    assert check(rows, 1024) <= -(-total // 1024) * 1.01 + 1
