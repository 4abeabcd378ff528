import numpy as np
import pyarrow as pa
import pytest

from basecov.llm.words import WHITE_TABLE, pieces, prefix_keys, text_buffers


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
def test_words_and_keys(corpus, limit):
    texts = [t for _, t in corpus]
    got, keys = [], {}
    for w in pieces(pa.array(texts), WHITE_TABLE, limit=limit):
        for i in range(w.n_docs):
            own = [w.data[w.start[j] : w.end[j]].tobytes() for j in range(w.first[i], w.first[i + 1])]
            for word, key in zip(own, w.key[w.first[i] : w.first[i + 1]]):
                assert keys.setdefault(word, key) == key
            got.append(own)
    assert got == [(t or "").encode().split() for t in texts]
    assert len(set(keys.values())) == len(keys)


def test_slices_large_types_and_case():
    column = pa.array(["A b", None, "c", "ÀB a"])
    for array in (column, column.cast(pa.large_string())):
        w = next(iter(pieces(array.slice(1), lower=True)))
        assert w.count.tolist() == [0, 1, 2]
    upper, lower = (next(iter(pieces(pa.array([t]), lower=True))).key for t in ("AbC d", "aBc D"))
    assert (upper == lower).all()
    assert text_buffers(pa.array([], pa.string()))[1].tolist() == [0]


def test_prefix_keys():
    w = next(iter(pieces(pa.array(["abcd abce abc ab"]))))
    (three,) = prefix_keys(w.data, w.start, w.end, (3,))
    assert three[0] == three[1] != 0 and (three[2:] == 0).all()


def test_windows_stay_inside_documents():
    w = next(iter(pieces(pa.array(["a b c", "a b", "", "x a b"]))))
    at, key = w.windows(2)
    assert at.tolist() == [0, 1, 3, 5, 6]
    assert key[0] == key[2] == key[4] and len(set(key.tolist())) == 3
    assert len(w.windows(9)[0]) == 0 and np.array_equal(w.doc(), [0, 0, 0, 1, 1, 3, 3, 3])


@pytest.mark.parametrize("size", [64, 256, 1024, 2048, 32_768])
def test_words_that_a_polynomial_cannot_tell_apart_have_different_keys(size):
    """A Thue-Morse string and its complement agree under every polynomial hash modulo 2^64."""
    signs = [bin(i).count("1") % 2 for i in range(size)]
    text = " ".join("".join("ab"[b ^ flip] for b in signs) for flip in (0, 1))
    keys = next(pieces(pa.array([text]))).key
    assert len(keys) == 2 and keys[0] != keys[1]
