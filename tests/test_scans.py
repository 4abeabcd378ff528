"""What reaches the scans: filters, columns, byte ranges of indexed files, and sheets of many samples."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThanOrEqual, Not, StringContains

from basecov import fixtures
from basecov.fixtures import encode_indexed_bam
from basecov.sources import bam
from basecov.sources.alignments import Sample, read_bam, read_samples
from basecov.sources.bam_index import BamIndex, bin_of_range, bins_over

REFERENCES = [(f"chr{i}", 1 << 28) for i in (1, 2, 3)]


@pytest.fixture(scope="module")
def indexed(tmp_path_factory):
    draw = random.Random(3)
    records = []
    for i in range(40_000):
        cigar = [(draw.choice([20, 50, 50, 50, 90_000]) if op == "N" else draw.randint(1, 80), op) for op in draw.choice(["M", "MNM", "MIM", "SM"])]
        records.append((f"r{i}", draw.choice([0, 16, 4]), f"chr{draw.randint(1, 3)}", draw.randint(1, 3_000_000), draw.randint(0, 60), cigar))
    records.sort(key=lambda r: (r[2], r[3]))
    path = tmp_path_factory.mktemp("indexed") / "reads.bam"
    data, index = encode_indexed_bam(records, REFERENCES, block_bytes=4_000)
    path.write_bytes(data)
    (path.parent / "reads.bam.bai").write_bytes(index)
    rows = [(r[0], r[1], r[2], r[3], r[3] + sum(n for n, op in r[5] if op in "MDN=X") - 1, r[4], "".join(f"{n}{op}" for n, op in r[5])) for r in records]
    return str(path), rows


def decoded(path, filters, **options):
    """Rows that the reader itself makes, its partitions, and the filters it leaves to Spark."""
    reader = bam.BamReader({"paths": path} | options)
    left = list(reader.pushFilters(filters))
    parts = reader.partitions()
    return [r for p in parts for b in reader.read(p) for r in b.to_pylist()], parts, left


@pytest.mark.parametrize("chrom, start, end", [("chr1", 1, 5000), ("chr2", 1_000_000, 1_016_500), ("chr3", 2_999_000, 9_000_000), ("chr2", 70_000, 70_000), ("chr9", 1, 10)])
def test_only_the_region_is_decoded(indexed, chrom, start, end):
    path, rows = indexed
    filters = [IsNotNull(("chrom",)), EqualTo(("chrom",), chrom), LessThanOrEqual(("start_pos",), end), GreaterThanOrEqual(("end_pos",), start)]
    found, parts, left = decoded(path, filters, columns="read_name,chrom,start_pos,end_pos", split_bytes="65536")
    assert not left
    expected = [(r[0], r[2], r[3], r[4]) for r in rows if r[2] == chrom and r[3] <= end and r[4] >= start]
    assert sorted(tuple(r.values()) for r in found) == sorted(expected)
    whole = sum(p.end - p.start for p in bam.BamReader({"paths": path}).partitions())
    assert sum(p.end - p.start for p in parts) < whole / 4  # byte ranges of the region only


def test_filters_reach_the_scan(spark, indexed):
    path, rows = indexed
    df = read_bam(spark, path, split_bytes=65_536).where("chrom IN ('chr1', 'chr3') AND flag = 16 AND mapq >= 30 AND start_pos > 2000000 AND read_name LIKE '%7%'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    left = re.search(r"Filter (.*)", plan).group(1)
    assert "read_name" in left and not any(c in left for c in ("flag", "mapq", "start_pos", "chrom"))
    expected = {r for r in rows if r[2] in ("chr1", "chr3") and r[1] == 16 and r[5] >= 30 and r[3] > 2_000_000 and "7" in r[0]}
    assert {tuple(r) for r in df.select("read_name", "flag", "chrom", "start_pos", "end_pos", "mapq", "cigar").collect()} == expected and expected


def test_other_filters_stay_with_spark(indexed):
    path, rows = indexed
    other = [Not(EqualTo(("chrom",), "chr1")), StringContains(("read_name",), "1"), EqualTo(("cigar",), "5M"), GreaterThanOrEqual(("chrom",), "chr2"), In(("mapq",), ("x",))]
    found, _, left = decoded(path, other)
    assert left == other and len(found) == len(rows)


def test_bins_cover_every_read():
    draw = random.Random(5)
    for _ in range(3000):
        begin = draw.randrange(1 << 29)
        end = min(begin + draw.choice([1, 100, 20_000, 1 << 20]), 1 << 29)
        at = draw.randrange(begin, end)
        assert bin_of_range(begin, end) in bins_over(at, at + 1)


def test_a_file_without_reads_of_the_chromosome_is_not_read(indexed):
    path, _ = indexed
    assert decoded(path, [EqualTo(("chrom",), "absent")])[1] == []


def test_unknown_columns_and_damaged_indexes_raise(tmp_path):
    with pytest.raises(ValueError):
        bam.BamReader({"paths": "x", "columns": "chrom,nothing"})
    with pytest.raises(ValueError):
        BamIndex(b"BAM\1")


@pytest.mark.parametrize("ending", ["bam", "sam"])
def test_a_sheet_of_any_size_is_one_scan(spark, tmp_path, ending):
    files = []
    for k in range(4):
        path = tmp_path / f"{k}.{ending}"
        if ending == "bam":
            path.write_bytes(encode_indexed_bam([(f"r{k}", 0, "chr1", 5 + k, 9, [(10, "M")])], REFERENCES)[0])
        else:
            path.write_text(f"@HD\n\nr{k}\t0\tchr1\t{5 + k}\t9\t10M\t*\t0\t0\t*\t*\n".replace("\n\n", "\n"))
        files.append(str(path))
    sheet = [Sample(i, "case", files[i % 4]) for i in range(1000)]
    reads = read_samples(spark, sheet)
    plan = reads._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Scan", plan)) == 1 and "Union" not in plan
    some = read_samples(spark, sheet[:12]).orderBy("sample_id").select("sample_id", "read_name", "start_pos", "end_pos").collect()
    assert [tuple(r) for r in some] == [(i, f"r{i % 4}", 5 + i % 4, 14 + i % 4) for i in range(12)]


@pytest.mark.parametrize("split", [1, 2, 7, 1 << 20])
def test_lines_of_any_split_come_once(tmp_path, split):
    from basecov.sources.lines import LineReader

    texts = ["a\nbb\n\nccc", "", "\n", "x" * 30 + "\r\ny\n", "é\nü"]
    samples = []
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.sam").write_bytes(text.encode())
        samples.append([k, str(tmp_path / f"{k}.sam")])
    import json

    reader = LineReader({"samples": json.dumps(samples), "split_bytes": str(split)})
    found = [(r["sample_id"], r["value"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert found == [(k, line) for k, text in enumerate(texts) for line in text.replace("\r\n", "\n").split("\n")[: text.count("\n") + (text[-1:] not in ("", "\n"))]]


@pytest.mark.parametrize("n", [0, 1, 10, 11, 12_345])
def test_reads_encoded_from_arrays_are_the_same_bytes(n):
    rng = np.random.default_rng(n)
    reference, start, length = np.sort(rng.integers(-1, 3, n)), rng.integers(1, 200_000, n), rng.choice([0, 1, 50, 40_000], n)
    order = np.lexsort((start, reference))
    start, names = start[order], {-1: "chrX"} | {i: name for i, (name, _) in enumerate(REFERENCES)}
    records = [(f"r{i}", 0, names[r], s, 60, [(k, "M")]) for i, (r, s, k) in enumerate(zip(reference.tolist(), start.tolist(), length.tolist()))]
    assert fixtures.encode_indexed_reads(reference, start, start + length - 1, REFERENCES, 4_000) == encode_indexed_bam(records, REFERENCES, 4_000)


def test_written_reads_are_dealt_out_evenly(spark, tmp_path, monkeypatch):
    """One sample and chromosome are no longer one task; every read is in one file of its sample."""
    monkeypatch.setattr(fixtures, "FILE_READS", 700)
    reads = spark.range(8000).selectExpr("int(id % 2) AS sample_id", "'chr1' AS chrom", "int(id + 1) AS start_pos", "int(id + 20) AS end_pos")
    sizes = []
    write = fixtures.write_bam
    monkeypatch.setattr(fixtures, "write_bam", lambda rows, path: sizes.extend(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()) or write(rows, path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        fixtures.bam_files(reads, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = read_bam(spark, str(tmp_path), columns=["start_pos", "end_pos"])
    assert sorted(map(tuple, found.select("start_pos", "end_pos").collect())) == [(i + 1, i + 20) for i in range(8000)]
    assert len(sizes) > 2 and max(sizes) <= 4000
    for sample in (0, 1):
        files = sorted(tmp_path.glob(f"sample={sample}/*.bam"))
        assert len(files) >= 6 and read_bam(spark, f"{tmp_path}/sample={sample}/*.bam", columns=["start_pos"]).where(f"start_pos % 2 <> {1 - sample}").count() == 0
