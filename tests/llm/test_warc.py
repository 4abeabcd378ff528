"""Operator 6: archives written, revisits resolved, read back, against brute force."""

import base64
import gzip
import hashlib

import pytest

from basecov.llm import warc
from basecov.llm.files import locate
from basecov.llm.queries import QUERIES

PAGES = [
    (1, "http://a/1", "<p>same</p>"),
    (2, "http://a/2", "<p>other é</p>"),
    (7, "http://a/ü b\r\nX: y", "<p>same</p>"),
    (5, None, "<p>same</p>"),
    (3, "http://a/3", None),
    (4, "http://a/4", ""),
    (9, "http://a/9", "x" * 300_000),
    (6, "http://a/6", "x" * 300_000),
    (8, "http://a/8", "WARC/1.1\r\n\r\nnot a record"),
    (7, "http://a/ü b\r\nX: y", "<p>same</p>"),
    (None, "http://a/null", "<p>same</p>"),
]


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "pages.parquet")
    spark.createDataFrame(PAGES, "page_id BIGINT, url STRING, html STRING").selectExpr("*", "1 AS record_type").repartition(3).write.parquet(path)
    return path


def expected(least=0):
    out = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        same = [warc.LOWEST if j is None else j for j, _, h in PAGES if (h or "") == (html or "")]
        own = warc.LOWEST if i is None else i
        revisit = len(data) >= least and own != max(same)
        out.append((i, len(data), sha(html), "revisit" if revisit else "response", max(same) if revisit else None))
    # of two equal rows with the largest id one is the original
    at = max(k for k, row in enumerate(out) if row[0] == 7)
    if len(PAGES[at][2]) >= least:
        out[at] = (*out[at][:3], "revisit", 7)
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1, warc.ARCHIVE_BYTES])
@pytest.mark.parametrize("least", [0, 100])
def test_resolved_archives(spark, pages, limit, least):
    raw = warc.write_archives(spark.read.parquet(pages), limit=limit)
    assert {r.record_type for r in warc.read_headers(raw).collect()} == {"response"}
    done = warc.resolve_revisits(raw, least_bytes=least, limit=limit)
    rows = warc.read_headers(done).collect()
    got = sorted(((None if r.page_id == warc.LOWEST else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)
    assert got == expected(least)


def test_files_are_readable_by_others(spark, pages):
    done = warc.resolve_revisits(warc.write_archives(spark.read.parquet(pages)))
    records = []
    for (path,) in done.select("path").collect():
        system, inner = locate(path)
        with system.open_input_stream(inner, compression=None) as f:
            data = f.read()
        assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type: ") >= 1
        records += [record for _, _, record in warc.members(data)]
    assert len(records) == len(PAGES)
    parsed = [warc.parse(r) for r in records]
    kept = {f["WARC-Record-ID"]: p.decode() for f, p in parsed if f["WARC-Type"] == "response"}
    assert kept["<urn:page:7>"] == "<p>same</p>" and len(kept["<urn:page:9>"]) == 300_000
    for fields, payload in parsed:
        if fields["WARC-Type"] == "revisit":
            assert payload == b"" and fields["WARC-Profile"] == warc.PROFILE and fields["WARC-Refers-To"] in kept
        assert "X" not in fields


def test_damage_is_noticed():
    record = warc.response(1, "http://a", b"payload")
    with pytest.raises(ValueError):
        list(warc.members(record[:-5]))
    text = gzip.decompress(record).replace(b"payload\r\n", b"payl0ad\r\n")
    with pytest.raises(ValueError):
        warc.parse(text)


def test_query_and_empty_table(spark, pages, tmp_path):
    folder = pages.rsplit("/", 1)[0]
    rows = QUERIES["op6_warc_revisits"](spark, folder).collect()
    own = [None if r.page_id is None else r.page_id for r in rows]
    assert sorted(map(str, own)) == sorted(str(i) for i, _, _ in PAGES)
    empty = warc.write_archives(spark.read.parquet(pages).limit(0))
    assert warc.read_headers(warc.resolve_revisits(empty)).count() == 0
