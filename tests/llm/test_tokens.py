"""Simple-8b files (operator 1) and byte-level BPE (operator 2), against the libraries themselves."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from basecov.llm import bpe, remembered, simple8b, token_files
from basecov.llm.queries import QUERIES

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
@pytest.mark.parametrize("bits", [0, 1, 7, 15, 16, 30, 60, 61, 64])
def test_simple8b_round_trip(n, bits):
    rng = np.random.default_rng(n * 100 + bits)
    ids = rng.integers(0, 1 << 64, n, dtype=np.uint64) >> np.uint64(64 - bits) if bits else np.zeros(n, np.uint64)
    ids = np.where(rng.random(n) < 0.5, ids & np.uint64(3), ids)
    words, offsets, exceptions = simple8b.pack(ids)
    assert (simple8b.unpack(words, offsets, exceptions, n) == ids).all()
    # Blocks stand for themselves.
    if n > simple8b.BLOCK and not len(exceptions):
        second = simple8b.unpack(words[offsets[1] :], offsets[1:] - offsets[1], exceptions, n - simple8b.BLOCK)
        assert (second == ids[simple8b.BLOCK :]).all()


def test_small_ids_take_little_room():
    words, _, _ = simple8b.pack(np.ones(12_800, np.uint64))
    assert len(words) <= 12_800 / 42


def test_damaged_file_is_refused():
    data = bytearray(token_files.to_file(np.array([3, 5]), np.array([2, 1]), np.array([7, 8, 1])))
    docs, counts, ids = token_files.from_file(bytes(data))
    assert (docs.tolist(), counts.tolist(), ids.tolist()) == ([3, 5], [2, 1], [7, 8, 1])
    data[-9] ^= 1
    with pytest.raises(ValueError):
        token_files.from_file(bytes(data))


@pytest.mark.parametrize("file_ids", [50, 1 << 20])
def test_token_files_hold_all_documents_in_order(docs, corpus, file_ids):
    manifest = token_files.write_tokens(docs.selectExpr("*", "1 AS start"), WORD_BPE, end_id=1, file_ids=file_ids)
    rows = token_files.read_tokens(manifest).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    tokenizer.encode_special_tokens = True
    lowest = -(1 << 63)
    expected = sorted((lowest if i is None else i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in corpus)
    assert [r.doc_id for r in rows] == [i for i, _ in expected]  # rows with equal ids stand in any order
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == expected
    start = 0
    for row in rows:
        assert (row.start, row.n_tokens) == (start, len(row.ids) // 4)
        start += row.n_tokens


def test_rows_of_one_id_are_dealt_out(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(4000).selectExpr("if(id % 2 = 0, 7L, NULL) AS doc_id", "concat('some text ', id) AS text")
    manifest = token_files.write_tokens(rows, WORD_BPE, end_id=1)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.groupBy("part").count().count() >= 3  # two ids, more than two tasks
    done = token_files.read_tokens(manifest)
    assert done.count() == 4000 and done.selectExpr("count(distinct start)").first()[0] == 4000


def test_query_reads_added_tokens_as_the_library_does(spark, tmp_path):
    texts = ["a b <|endoftext|> c", "<|startoftext|>Über\x0b<|endoftext|>", "x<|endoftext|><|endoftext|> y\n", "<|ENDOFTEXT|> <| endoftext |>", "plain words", None, "é<|endoftext|", "漢 <|endoftext|> 12"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op1_simple8b_tokens"](spark, str(tmp_path)).orderBy("doc_id").collect()
    tokenizer, start = Tokenizer.from_file(WORD_BPE), 0
    for row, text in zip(rows, texts, strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_no_documents_no_files(no_docs):
    manifest = token_files.write_tokens(no_docs, WORD_BPE, end_id=1)
    assert manifest.count() == 0 and token_files.read_tokens(manifest).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abThé \n\t\x0b\x1c\x85'.,12ÉßİſΣ漢🙂²½", max_size=60))
def test_word_encoder_equals_the_library(text):
    encoder = _word_encoder()
    data = np.frombuffer((text + text[:7]).encode(), np.uint8)  # two texts of one piece
    first = len(text.encode())
    ids, bounds = encoder.encode(data, np.array([0, first, len(data)]))
    for part, a, b in zip((text, text[:7]), bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == encoder.tokenizer.encode(part, add_special_tokens=False).ids


_KEPT = []


def _word_encoder():
    if not _KEPT:
        with open(WORD_BPE, encoding="utf-8") as f:
            _KEPT.append(remembered.LibraryEncoder(f.read()))
    return _KEPT[0]


@pytest.fixture(scope="module")
def ranks():
    with open(BYTE_BPE, "rb") as f:
        return bpe.read_ranks(f.read())


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return bpe.Encoder(ranks, public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet="abtheons LT\n\t\r'.,éßñ漢字🙂1234　\x0b\x1c\x85‍", max_size=80))
def test_transducer_equals_tiktoken(encoder, reference, text):
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab's. L1\n\té　\x85\u2003", max_size=9), max_size=6))
def test_texts_of_one_piece_stay_apart(encoder, reference, texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids, bounds = encoder.encode_piece(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [reference.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("text", ["a" * 9000, "ab" * 5000 + "c", "the" * 4000, "!" * 9000, " " * 5000 + "x", "\n" * 4097])
def test_long_matches_are_settled_on_the_way(encoder, reference, text):
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_states_and_caches_may_start_anew(ranks, reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_STATES", 50)
    monkeypatch.setattr(bpe, "KEPT_MATCHES", 20)
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    encoder.table = remembered.IdTable(encoder._learn, slots=64, store_ids=500)
    rng = random.Random(3)
    for _ in range(200):
        text = " ".join("".join(rng.choice("etaoins") for _ in range(rng.randint(1, 12))) for _ in range(20))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(0, 40), max_size=5))
def test_utf8_stream_equals_the_whole(data, cuts):
    stream, out, last = bpe.Utf8Stream(), [], 0
    for cut in sorted(c for c in cuts if c <= len(data)):
        out.append(stream.feed(data[last:cut]))
        last = cut
    out += [stream.feed(data[last:]), stream.close()]
    assert "".join(out) == data.decode("utf-8", "replace")


def test_round_trip_of_all_texts(docs, corpus, reference):
    rows = bpe.round_trip(docs.selectExpr("*", "'x' AS ids", "2 AS other"), BYTE_BPE, public_tokenizers.PATTERN).collect()
    assert sorted(rows[0].asDict()) == ["decoded", "doc_id", "ids", "n_replaced", "n_tokens", "other", "text"]
    assert len(rows) == len(corpus)
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(r.text or "")
        assert (bytes(r.decoded), r.n_replaced, r.n_tokens) == ((r.text or "").encode(), 0, len(r.ids) // 4)


def test_encode_then_decode(docs, no_docs):
    encoded = bpe.encode(docs, BYTE_BPE, public_tokenizers.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in bpe.decode(encoded, BYTE_BPE).collect())
    assert bpe.encode(no_docs, BYTE_BPE, public_tokenizers.PATTERN).count() == 0


