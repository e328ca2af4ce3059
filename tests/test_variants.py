"""Block-compressed variant files: round trips, indexes, and how little of a file is read."""

import gzip
import io
import random

import pytest
from lociframe.sources import bgzf, variants
from lociframe.sources.sequences import read_vcf
from pyspark.sql import functions as F


class Bytes:
    """Bytes as a file that counts what is read."""

    def __init__(self, data):
        self.data, self.read = data, 0

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        self.read += n
        return self.data[at:at + n]


def records(n, contigs=("1", "2", "X"), seed=1, long=0.02):
    r = random.Random(seed)
    rows = []
    for c in contigs:
        for pos in sorted(r.sample(range(1, 40 * n), n)):
            ref = "A" if r.random() > long else "ACGT" * r.randint(1, 9000)
            info = f"END={pos + r.randint(1, 200_000)}" if r.random() < long else f"CLNSIG=x{pos}"
            rows.append((c, pos, f"{c}\t{pos}\trs{pos}\t{ref}\tG,T\t.\t.\t{info}"))
    return rows


def span(value):
    c, start, end = bgzf.record_span(value.encode())
    return c.decode(), start, end


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vcf") / "parts")
    rows = records(4000)
    variants.write_variants(spark.createDataFrame(rows, "chrom string, pos long, value string").repartition(5), path, 4)
    return path, rows


def test_blocks_are_gzip_and_end_with_the_mark():
    text = b"".join(b"line %d\n" % k for k in range(50_000))
    data = bgzf.compressed(text)
    assert gzip.decompress(data) == text
    assert data.endswith(bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000"))
    assert b"".join(t for _, _, t in bgzf.blocks(Bytes(data))) == text


def test_lines_between_any_two_offsets():
    r = random.Random(3)
    out = io.BytesIO()
    writer = bgzf.Writer(out)
    lines = [bytes(r.choices(b"abc", k=r.choice([0, 1, 50, 70_000, 200_000]))) for _ in range(60)]
    for x in lines:
        writer.line(x)
    writer.close()
    source = Bytes(out.getvalue())
    pairs = [p for batch in bgzf.lines_between(source) for p in zip(*batch)]
    assert [x for _, x in pairs] == lines
    at = [p[0] for p in pairs] + [source.size() << 16]
    for _ in range(60):
        a, b = sorted(r.sample(range(len(at)), 2))
        assert [x for _, batch in bgzf.lines_between(source, at[a], at[b]) for x in batch] == lines[a:b]


def test_damaged_files_are_refused():
    data = bytearray(bgzf.compressed(b"some text\n" * 1000))
    for bad in (b"plain text, no block at all", bytes(data[:40]), gzip.compress(b"x")):
        with pytest.raises(ValueError):
            list(bgzf.blocks(Bytes(bad)))


def test_bins_hold_their_records():
    r = random.Random(4)
    for shift, depth in ((14, 5), (12, 7)):
        for _ in range(500):
            start = r.randrange(1 << 28)
            end = start + r.choice([1, 5, 1000, 100_000, 1 << 24])
            width, k = bgzf.bin_range(bgzf.bin_of(start, end, shift, depth), shift, depth)
            assert k << width <= start and end <= (k + 1) << width


def test_index_survives_its_file_and_equals_that_of_a_scan(folder):
    from pathlib import Path
    path, _ = folder
    for file in Path(path).glob("*.gz"):
        kept = bgzf.unpack_index(Bytes(Path(f"{file}.tbi").read_bytes()))
        made = bgzf.index_records(Bytes(file.read_bytes()))
        assert kept.contigs.keys() == made.contigs.keys()
        for c in kept.contigs:
            assert kept.contigs[c].bins.keys() == made.contigs[c].bins.keys() and kept.contigs[c].floors == made.contigs[c].floors


def test_csi_is_read():
    import struct
    names = b"1\0"
    aux = struct.pack("<7i", *bgzf.VCF_LAYOUT, len(names)) + names
    data = b"CSI\1" + struct.pack("<3i", 14, 6, len(aux)) + aux + struct.pack("<i", 1) + struct.pack("<i", 2)
    data += struct.pack("<IQi", bgzf.level_start(6) + 3, 5, 1) + struct.pack("<QQ", 5, 9)
    data += struct.pack("<IQi", bgzf.level_start(7) + 1, 0, 2) + struct.pack("<QQQQ", 1, 2, 3, 4)
    index = bgzf.unpack_index(Bytes(bgzf.compressed(data)))
    assert (index.shift, index.depth, index.contigs["1"].bins) == (14, 6, {bgzf.level_start(6) + 3: [[5, 9]]})
    assert variants.planned(index, [("chr1", 3 << 14, (3 << 14) + 1)]) == [(5, 9)] and variants.planned(index, [("1", 0, 5)]) == []


def test_a_whole_file_is_read_in_splits(spark, folder):
    path, rows = folder
    lines = variants.variant_lines(spark, path, range_bytes=1 << 14)
    got = [r["value"] for r in lines.collect() if not r["value"].startswith("#")]
    assert sorted(got) == sorted(r[2] for r in rows) and lines.rdd.getNumPartitions() > 4
    assert variants.read_variants(spark, path).count() == len(rows)


@pytest.mark.parametrize("seed", range(3))
def test_regions_equal_a_full_scan(spark, folder, seed):
    path, rows = folder
    r = random.Random(seed)
    regions = []
    for _ in range(25):
        a = r.randrange(170_000)
        regions.append((r.choice(["chr1", "1", "2", "chrX", "Y"]), a, a + r.choice([0, 1, 200, 30_000])))
    def wanted(value):
        c, start, end = span(value)
        return any(n.removeprefix("chr") == c and a < end and start < b and a < b for n, a, b in regions)
    got = variants.read_variants(spark, path, spark.createDataFrame(regions, "chrom string, start long, end long"), range_bytes=1 << 15)
    assert sorted((x["chrom"], x["pos"], x["ref"]) for x in got.collect()) == sorted((c, p, v.split("\t")[3]) for c, p, v in rows if wanted(v))
    text = ",".join(f"{n}:{a + 1}-{b}" for n, a, b in regions if a < b)
    few = variants.read_region(spark, path, text)
    assert sorted((x["chrom"], x["pos"], x["ref"]) for x in few.collect()) == sorted((c, p, v.split("\t")[3]) for c, p, v in rows if wanted(v))


def test_one_percent_of_a_genome_reads_less_than_five_percent_of_the_file(spark, tmp_path):
    rows = records(60_000, contigs=("1",), seed=9, long=0.0)
    out = io.BytesIO()
    writer = bgzf.Writer(out)
    for c, pos, value in rows:
        writer.line(value.encode(), span(value))
    writer.close()
    data, last = out.getvalue(), rows[-1][1]
    (tmp_path / "all.vcf.gz").write_bytes(data)
    assert variants.index_variants(spark, str(tmp_path)) == 1
    lo, hi = last // 2, last // 2 + last // 100
    region = spark.createDataFrame([("1", lo, hi)], "chrom string, start long, end long")
    ranges = variants.wanted_ranges(spark, str(tmp_path), region).collect()
    bgzf_fetch, bgzf.FETCH = bgzf.FETCH, 1 << 16
    try:
        source = Bytes(data)
        got = [x for r in ranges for _, batch in bgzf.lines_between(source, r["begin"], r["stop"]) for x in batch]
    finally:
        bgzf.FETCH = bgzf_fetch
    assert sum(lo < r[1] <= hi for r in rows) <= len(got) < len(rows) / 20
    assert source.read < 0.05 * len(data) + (1 << 17), (source.read, len(data))
    blocks = sum((r["stop"] >> 16) - (r["begin"] >> 16) for r in ranges)
    assert blocks < 0.05 * len(data)


def test_no_index_is_an_error_and_nothing_asked_gives_nothing(spark, folder, tmp_path):
    path, _ = folder
    (tmp_path / "x.vcf.gz").write_bytes(bgzf.compressed(b"1\t5\t.\tA\tG\t.\t.\t.\n"))
    with pytest.raises(Exception, match="no index"):
        variants.read_variants(spark, str(tmp_path)).count()
    none = spark.createDataFrame([], "chrom string, start long, end long")
    assert variants.read_variants(spark, path, none).count() == 0


def test_columns_equal_those_of_the_plain_reader(spark, tmp_path):
    lines = ["1\t5\trs1\tA\tG\t.\t.\tDB;CLNSIG=Benign;MC=a|b;GENEINFO=X:1", "1\t9\t.\tAC\t.\t.\t.\t."]
    (tmp_path / "plain.vcf").write_text("\n".join(["##x", *lines]) + "\n")
    df = spark.createDataFrame([("1", 5, lines[0]), ("1", 9, lines[1])], "chrom string, pos long, value string")
    variants.write_variants(df, str(tmp_path / "parts"), 1)
    a, b = (x.withColumn("info", F.map_entries("info")) for x in (read_vcf(spark, str(tmp_path / "plain.vcf")), variants.read_variants(spark, str(tmp_path / "parts"))))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.columns == b.columns
