import random
import struct

import pytest
from pyspark.sql import functions as F

from basecov.fixtures import _bgzf, encode_bam
from basecov.functions import ids
from basecov.operators.coverage import base_coverage, bases_at_depth, region_coverage
from basecov.plans.study import CoverageStudy
from basecov.sources.alignments import Sample, read_bam, read_sam, read_sample, read_samples
from basecov.sources.annotation import read_exons, read_null_table
from basecov.sources.bam import CIGAR_OPS, list_files

SAM = [
    "@HD\tVN:1.6",
    "@SQ\tSN:chr1\tLN:100000",
    "r1\t0\tchr1\t11200\t60\t50M\t*\t0\t0\t*\t*",
    "r2\t0\tchr1\t11215\t60\t50M\t*\t0\t0\t*\t*",
    'r3\t16\tchr1\t11240\t60\t50M\t*\t0\t0\t*\t"##"\tNM:i:0\tMD:Z:50',
    "r4\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*",
    "r5\t0\tchr1\t20000\t60\t10M100N10M\t*\t0\t0\t*\t*",
]
RECORDS = [
    ("r1", 0, "chr1", 11200, 60, [(50, "M")]),
    ("r2", 0, "chr1", 11215, 60, [(50, "M")]),
    ("r3", 16, "chr1", 11240, 60, [(50, "M")]),
    ("r4", 4, "*", 0, 0, []),
    ("r5", 0, "chr1", 20000, 60, [(10, "M"), (100, "N"), (10, "M")]),
]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("alignments")
    (folder / "sample_1.sam").write_text("\n".join(SAM) + "\n")
    (folder / "sample_1.bam").write_bytes(encode_bam(RECORDS, [("chr1", 100_000)]))
    (folder / "sample_1.bed").write_text("chr1\t11210\t11261\t.\t 12421\t1\n")
    return folder


@pytest.mark.parametrize("name", ["sample_1.sam", "sample_1.bam"])
def test_golden_counts(spark, files, name):
    reads = read_sample(spark, str(files / name), 25)
    exons = read_exons(spark, str(files / "sample_1.bed"))
    assert [tuple(r) for r in exons.collect()] == [("12421", "1", "chr1", 11210, 11261, ".")]
    assert [r.cov for r in region_coverage(reads, exons).collect()] == [3]
    packed = F.expr(ids.pack_position("sample_id", ids.chrom_number("chrom"), "pos"))
    for options in ({}, {"chrom": "chr1", "start": 11_000, "end": 16_000}):
        cov = base_coverage(reads, **options).where(packed == 25001000011240)
        assert [r.cov for r in cov.collect()] == [3]


def test_sam_and_bam_agree(spark, files):
    columns = ["read_name", "flag", "chrom", "start_pos", "end_pos", "mapq", "cigar"]
    sam = read_sam(spark, str(files / "sample_1.sam")).select(columns).orderBy("read_name").collect()
    bam = read_bam(spark, str(files / "sample_1.bam")).select(columns).orderBy("read_name").collect()
    assert sam == bam
    assert [(r.start_pos, r.end_pos) for r in bam] == [
        (11200, 11249), (11215, 11264), (11240, 11289), (0, -1), (20000, 20119)
    ]


def test_gap_is_not_covered(spark, files):
    reads = read_sample(spark, str(files / "sample_1.sam"), 1)
    covered = {r.pos for r in base_coverage(reads, chrom="chr1", start=20_000, end=30_000).collect()}
    assert covered == set(range(20_000, 20_010)) | set(range(20_110, 20_120))
    assert bases_at_depth(reads, 3).first().n_bases == 10
    inside_gap = spark.createDataFrame([("g", "e", "chr1", 20_020, 20_090)], "gene_id STRING, exon_id STRING, chrom STRING, start_pos INT, end_pos INT")
    assert region_coverage(reads, inside_gap).count() == 0


def test_bam_splits_lose_and_repeat_nothing(spark, tmp_path):
    draw = random.Random(7)
    records = []
    for i in range(60_000):
        cigar = [(draw.randint(1, 300), op) for op in draw.choices("MIDNS", k=draw.randint(1, 12))]
        records.append((f"read{i}_{draw.getrandbits(64):x}", 0, f"chr{draw.randint(1, 3)}", draw.randint(1, 10**8), 9, cigar))
    path = tmp_path / "many.bam"
    path.write_bytes(encode_bam(records, [(f"chr{i}", 1 << 28) for i in (1, 2, 3)], block_bytes=7_001))
    whole = read_bam(spark, str(path), split_bytes=1 << 30)
    cut = read_bam(spark, str(path), split_bytes=65_536)
    assert cut.rdd.getNumPartitions() > 20
    expected = {(r[0], r[2], r[3], "".join(f"{n}{op}" for n, op in r[5])) for r in records}
    rows = cut.select("read_name", "chrom", "start_pos", "cigar").collect()
    assert len(rows) == len(records) and {tuple(r) for r in rows} == expected
    assert whole.count() == len(records)


def test_bam_with_records_longer_than_blocks_and_empty_file(spark, tmp_path):
    long_cigar = [(n % 50 + 1, "MID"[n % 3]) for n in range(30_000)]
    records = [(f"long{i}", 0, "chr1", 1 + i, 60, long_cigar) for i in range(12)]
    path = tmp_path / "long.bam"
    path.write_bytes(encode_bam(records, [("chr1", 1 << 28)], block_bytes=5_000))
    assert read_bam(spark, str(path), split_bytes=65_536).select("read_name").distinct().count() == 12
    assert read_bam(spark, str(path), split_bytes=65_536).count() == 12
    empty = tmp_path / "empty.bam"
    empty.write_bytes(encode_bam([], [("chr1", 1000)]))
    assert read_bam(spark, str(empty)).count() == 0


def _long_read(name, start, cigar, tags):
    """A record of 3 bases whose operations are in ``tags``, with the placeholder kSmN in their place."""
    span = sum(n for n, op in cigar if op in "MDN=X")
    ops = struct.pack("<II", 3 << 4 | CIGAR_OPS.index("S"), span << 4 | CIGAR_OPS.index("N"))
    core = struct.pack("<iiBBHHHiiii", 0, start - 1, len(name) + 1, 60, 0, 2, 0, 3, -1, -1, 0)
    body = core + name.encode() + b"\0" + ops + bytes(2) + bytes(3) + tags
    return struct.pack("<i", len(body)) + body


def _tag(cigar):
    return b"CGBI" + struct.pack("<I", len(cigar)) + b"".join(struct.pack("<I", n << 4 | CIGAR_OPS.index(op)) for n, op in cigar)


@pytest.mark.parametrize("split_bytes", [1 << 30, 65_536])
def test_bam_with_operations_in_a_tag(spark, tmp_path, split_bytes):
    long, short = [(2, "M"), (1, "D")] * 40_000 + [(5, "M")], [(4, "M"), (10, "N"), (4, "M")]
    others = b"NMi" + struct.pack("<i", 7) + b"MDZ50^A\0" + b"XAAq" + b"ZBBs" + struct.pack("<Ihh", 2, 1, 2)
    plain = b"BAM\1" + struct.pack("<ii", 0, 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1 << 28)
    plain += _long_read("a", 101, long, others + _tag(long)) + _long_read("b", 1001, short, _tag(short) + others)
    path = tmp_path / "sample.bam"
    path.write_bytes(b"".join(_bgzf(plain[i : i + 60_000]) for i in range(0, len(plain), 60_000)) + _bgzf(b""))
    rows = {r.read_name: r for r in read_bam(spark, str(path), split_bytes=split_bytes).collect()}
    assert {k: r.cigar for k, r in rows.items()} == {"a": "2M1D" * 40_000 + "5M", "b": "4M10N4M"}
    assert {k: (r.start_pos, r.end_pos) for k, r in rows.items()} == {"a": (101, 120_105), "b": (1001, 1018)}
    covered = {r.pos: r.cov for r in base_coverage(read_sample(spark, str(path), 1), chrom="chr1", start=1, end=110).collect()}
    assert covered == {p: 1 for p in range(101, 111) if (p - 101) % 3 < 2}


def test_bam_without_the_tag_raises(spark, tmp_path):
    plain = b"BAM\1" + struct.pack("<ii", 0, 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1 << 28)
    path = tmp_path / "sample.bam"
    path.write_bytes(_bgzf(plain + _long_read("lost", 101, [(9, "M")], b"NMi" + struct.pack("<i", 7))) + _bgzf(b""))
    with pytest.raises(Exception, match="no CG tag"):
        read_bam(spark, str(path)).count()


def test_damaged_bam_raises(spark, tmp_path):
    good = encode_bam(RECORDS * 5000, [("chr1", 100_000)])
    path = tmp_path / "cut.bam"
    path.write_bytes(good[: len(good) // 2])
    with pytest.raises(Exception, match="truncated"):
        read_bam(spark, str(path)).count()


def test_samples_with_globs_and_names_with_blanks(spark, files, tmp_path):
    for name in ("S 1_a.sam", "S 1_b.sam", "S2.sam"):
        (tmp_path / name).write_text("\n".join(SAM) + "\n")
    (tmp_path / "S3.bam").write_bytes((files / "sample_1.bam").read_bytes())
    sheet = [
        Sample(7, "case", str(tmp_path / "S 1_*.sam"), 1.0),
        Sample(8, "control", str(tmp_path / "S2.sam"), 2.0),
        Sample(9, "control", str(tmp_path / "S3.bam"), 1.0),
    ]
    counts = {r.sample_id: r.n for r in read_samples(spark, sheet).groupBy("sample_id").agg(F.expr("count(*) AS n")).collect()}
    assert counts == {7: 10, 8: 5, 9: 5}
    study = CoverageStudy.open(spark, sheet, read_exons(spark, str(files / "sample_1.bed")))
    assert study.sample_num == 3 and study.samples().count() == 3
    at = {r.sample_id: r.cov for r in study.base_coverage_region("chr1", 11240, 11240).collect()}
    assert at == {7: 6, 8: 6, 9: 3}
    assert [tuple(r) for r in study.exon_coverage().collect()] == [("12421", "1", 6, 6, 3)]
    assert [tuple(r) for r in study.gene_coverage(["12421"]).collect()] == [("12421", 6, 6, 3)]
    assert study.gene_coverage(["none"]).count() == 0
    with pytest.raises(FileNotFoundError):
        read_samples(spark, [Sample(1, "case", str(tmp_path / "absent*.sam"))])
    assert len(list_files(str(tmp_path))) == 4


@pytest.mark.parametrize("ending", ["sam", "bam", "parquet"])
def test_samples_by_any_spelling_of_their_paths(spark, files, tmp_path, monkeypatch, ending):
    monkeypatch.chdir(tmp_path)
    names = ["a+b", "a%20b", "a b", "dir/plain", "one/x/deep", "two/x/deep"]
    for name in names:
        path = tmp_path / f"{name}.{ending}"
        path.parent.mkdir(parents=True, exist_ok=True)
        if ending == "sam":
            path.write_text("\n".join(SAM) + "\n")
        elif ending == "bam":
            path.write_bytes((files / "sample_1.bam").read_bytes())
        else:
            read_sam(spark, str(files / "sample_1.sam")).drop("file_path").write.parquet(str(path))
    here = str(tmp_path)
    paths = [f"{here}/a+b", f"{here}/a%20b", f"{here}/a b", "a+b", "./dir/plain", f"{here}/dir//plain", f"file:{here}/dir/plain", f"file://{here}/a+b", f"{here}/*/x/deep", f"{here}/a+b"]
    if ending == "parquet":
        paths = [p for p in paths if not p.startswith(("a", "./"))]  # Spark resolves relative paths where the JVM began
    elif ending == "sam":
        paths = [p if p.startswith(("/", "file:")) else f"{here}/{p}" for p in paths]
    sheet = [Sample(i, "case", f"{p}.{ending}") for i, p in enumerate(paths)]
    sheet.append(sheet[0])  # a repeated line counts once
    counts = {r.sample_id: r.n for r in read_samples(spark, sheet).groupBy("sample_id").agg(F.expr("count(*) AS n")).collect()}
    assert counts == {i: 10 if "*" in p else 5 for i, p in enumerate(paths)}
    with pytest.raises(FileNotFoundError):
        read_samples(spark, [Sample(1, "case", f"{here}/absent.{ending}")])


def test_null_table_with_carriage_returns(spark, tmp_path):
    path = tmp_path / "table.txt"
    path.write_text("0.0833333333\t0.400000000000\r\n0.1944444444\t0.800000000000\r\n")
    rows = read_null_table(spark, str(path), 3, 3).orderBy("score").collect()
    assert [(r.score, r.cdf) for r in rows] == [(27, 0.4), (63, 0.8)]


def test_packed_ids(spark):
    row = spark.sql("SELECT 25 AS s, 'chrX' AS c, 11240 AS p").selectExpr(
        f"{ids.pack_position('s', ids.chrom_number('c'), 'p')} AS packed",
        f"{ids.chrom_number(chr(39) + 'scaffold_9' + chr(39))} AS unknown",
        f"{ids.new_region_id('42')} AS novel",
    ).first()
    assert (row.packed, row.unknown, row.novel) == (25_023_000_011_240, None, "NEWREG000000042")
    back = spark.createDataFrame([(row.packed,)], "id BIGINT").selectExpr(
        f"{ids.sample_of('id')} AS s", f"{ids.to_coordinates(ids.strip_sample('id'))} AS at"
    ).first()
    assert (back.s, back["at"].chrom, back["at"].pos) == (25, "chrX", 11240)
