import bz2
import gzip
import io
import lzma
import zipfile

import pytest
import zstandard
from pyspark.sql import functions as F

from lociframe import sinks
from lociframe.operators import datasets as ds
from lociframe.operators import structure as st
from lociframe.operators.clinical import clinical_label, is_coding, noncoding, snv_only
from lociframe.sources import intervals as si
from lociframe.sources import logs as sl
from lociframe.sources import sequences as ss
from lociframe.sources.lines import numbered_lines, read_compressed_lines
from lociframe.streaming import follow_call_log

NOISY = ("﻿track name=x\nbrowser position chr1\n# comment\n\n   \nchr1\t10\t20\tCatalog#: 5; note\t3.5\r\n"
         "chr2\t5\t9\tb\t4\n")


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def codecs(data):
    half = len(data) // 2
    z = zstandard.ZstdCompressor()
    return {"plain.bed": data, "a.gz": gzip.compress(data), "no_suffix": gzip.compress(data), "a.bz2": bz2.compress(data),
            "a.xz": lzma.compress(data), "a.zip": zipped({"dir/": b"", "dir/p.bed": data, "__MACOSX/p.bed": b"junk"}),
            "a.zst": z.compress(data), "frames.zst": z.compress(data[:half]) + z.compress(data[half:]),
            "wrong.bz2.bin": gzip.compress(data)}


def test_bed_noise(spark, rows, tmp_path):
    (tmp_path / "p.bed").write_bytes(NOISY.encode())
    got = si.read_bed(spark, str(tmp_path / "p.bed"), ["name", "score"])
    assert rows(got, "line_no", "chrom", "start", "end", "name", "score") == [
        (6, "chr1", 10, 20, "Catalog#: 5; note", "3.5"), (7, "chr2", 5, 9, "b", "4")]


def test_bad_utf8_becomes_a_replacement(spark, rows, tmp_path):
    (tmp_path / "p.bed").write_bytes(b"chr1\t1\t2\tx\xffy\n")
    for by_content in (False, True):
        assert rows(si.read_bed(spark, str(tmp_path / "p.bed"), ["name"], by_content), "name") == [("x�y",)]


def test_every_codec_equals_the_plain_file(spark, tmp_path):
    data = NOISY.encode() + "".join(f"chr1\t{i}\t{i + 5}\tn{i}\n" for i in range(3000)).encode()
    for name, content in codecs(data).items():
        folder = tmp_path / name.replace(".", "_")
        folder.mkdir()
        (folder / name).write_bytes(content)
    want = None
    for folder in sorted(tmp_path.iterdir()):
        got = sorted(tuple(r) for r in si.read_bed(spark, str(folder), ["name"], True).drop("file").collect())
        want = want or got
        assert got == want and len(got) == 3002, folder


@pytest.mark.parametrize("name, content", [
    ("cut.gz", gzip.compress(b"x" * 10_000)[:-20]), ("cut.bz2", bz2.compress(bytes(range(256)) * 99)[:-20]),
    ("cut.xz", lzma.compress(bytes(range(256)) * 99)[:-20]), ("cut.zst", zstandard.ZstdCompressor().compress(bytes(range(256)) * 99)[:-5]),
    ("many.zip", zipped({"a.bed": b"1", "b.bed": b"2"})), ("corrupt.gz", b"\x1f\x8b\x08" + b"\x00" * 7 + b"garbage")])
def test_damaged_files_are_named(spark, tmp_path, name, content):
    (tmp_path / name).write_bytes(content)
    with pytest.raises(Exception, match=f"{name} cannot be read"):
        read_compressed_lines(spark, str(tmp_path / name)).collect()


def test_line_numbers_hold_across_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{i}\n" for i in range(1, 20_001)))
    (tmp_path / "b.txt").write_text("".join(f"{i}\n" for i in range(1, 51)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        df = numbered_lines(spark, str(tmp_path))
        assert df.where(F.col("line_no") != F.col("value").cast("long")).count() == 0 and df.count() == 20_050
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def peaks_file(tmp_path, text):
    path = tmp_path / "peaks.bed"
    path.write_text(text)
    return str(path)


def test_peaks(spark, rows, tmp_path):
    df, problem = si.read_peaks(spark, peaks_file(tmp_path, "chr1\t1\t5\t3\nchr1 7 9 4\n"))
    assert problem is None and rows(df) == [("chr1", 1, 5, 3), ("chr1", 7, 9, 4)] and dict(df.dtypes)["num"] == "bigint"
    df, problem = si.read_peaks(spark, peaks_file(tmp_path, "chr1\t1\t5\t3\nchr1\t7\t9\t2.5\n"))
    assert problem is None and rows(df, "num") == [(2.5,), (3.0,)]
    df, problem = si.read_peaks(spark, peaks_file(tmp_path, "#h\nchr1\t1\t5\t3\nchr1\t7\t9\tID=a\n"))
    assert problem == "line 3 has 'ID=a' in column 4" and rows(df, "num") == [(1,), (1,)]
    _, problem = si.read_peaks(spark, peaks_file(tmp_path, "chr1\t1\t5\n"))
    assert problem == "line 1 has no 4th column"
    for bad, what in (("chr1\t1\t5\nchr1\t2\n", "line 2 has fewer than 3"), ("chr1\t1\t5\nchr1\tx\t9\n", "line 2 start and end")):
        with pytest.raises(ValueError, match=what):
            si.read_peaks(spark, peaks_file(tmp_path, bad))


def test_intersect_skips_the_header_and_absent_factors(spark, rows, tmp_path):
    (tmp_path / "A.allintersect.bed").write_text("chrom\tstart\tend\tnum\tlist\tx\nchr1\t1\t9\t3\ta,b\t0\nchr2\t4\t6\t1\ta\t1\n")
    got = si.read_intersect(spark, str(tmp_path), ["A", "B"])
    assert rows(got) == [("A", "chr1", 1, 9, 3.0), ("A", "chr2", 4, 6, 1.0)]
    with pytest.raises(ValueError, match="has a file"):
        si.read_intersect(spark, str(tmp_path), ["B"])


FASTA = ">chrA first one\r\nACGT\r\nNNac\n\ngt\n>\nTTTT\n>last > with a mark\nGG\nC"


def test_fasta_and_genome(spark, rows, tmp_path):
    path = str(tmp_path / "g.fa")
    with open(path, "w", newline="") as f:
        f.write(FASTA)
    assert rows(ss.read_fasta(spark, path), "record_no", "name", "seq") == [(0, "chrA", "ACGTNNacgt"), (1, "seq1", "TTTT"), (2, "last", "GGC")]
    want = [("chrA", 0, "ACGT"), ("chrA", 1, "NNAC"), ("chrA", 2, "GT"), ("last", 0, "GGC"), ("seq1", 0, "TTTT")]
    assert rows(ss.read_genome(spark, path, 4)) == want
    indexed = tmp_path / "i.fa"
    text = {"c1": "ACGTNacgtACGTAC", "c2": "GGGTTT", "c3": "A" * 12}
    lines, fai, offset = "", "", 0
    for name, s in text.items():
        head, body = f">{name} x\n", "".join(s[i:i + 6] + "\n" for i in range(0, len(s), 6))
        fai += f"{name}\t{len(s)}\t{offset + len(head)}\t6\t7\n"
        lines, offset = lines + head + body, offset + len(head) + len(body)
    indexed.write_text(lines)
    plain = rows(ss.read_genome(spark, str(indexed), 4))
    (tmp_path / "i.fa.fai").write_text(fai)
    assert rows(ss.read_genome(spark, str(indexed), 4)) == plain
    assert "".join(q for c, _, q in plain if c == "c1") == text["c1"].upper()


MEME = """MEME version 4

ALPHABET= ACGT

Background letter frequencies
A 0.3 C 0.2 G 0.2 T 0.3

MOTIF one first
letter-probability matrix: alength= 4 w= 2 nsites= 20 E= 0
 0.5 0.25 0.25 0
 1e-1 0.2 0.3 0.4
URL x

MOTIF two
letter-probability matrix: alength= 4 w= 1 nsites= 7 E= 0
0.1\t0.2\t0.3\t0.4"""


def test_meme(spark, tmp_path):
    (tmp_path / "m.meme").write_text(MEME)
    got = {(r["motif"], r["pos"], r["base"]): (r["prob"], r["bg"], r["nsites"]) for r in ss.read_meme(spark, str(tmp_path / "m.meme")).collect()}
    assert len(got) == 12 and got[("one", 1, "A")] == (.1, .3, 20.0) and got[("two", 0, "T")] == (.4, .3, 7.0) and got[("one", 0, "C")][0] == .25
    again = ss.read_meme(spark, str(tmp_path / "m.meme")).select("motif", "pos", "base", "prob", "nsites")
    sinks.write_meme(again, str(tmp_path / "out"))
    back = ss.read_meme(spark, str(tmp_path / "out")).select("motif", "pos", "base", "prob", "nsites")
    assert sorted(back.collect()) == sorted(again.collect())
    assert {r["bg"] for r in ss.read_meme(spark, str(tmp_path / "out")).collect()} == {.25}


def test_variant_records(spark, rows, tmp_path):
    path = tmp_path / "v.vcf"
    path.write_text("##x\n#CHROM\tPOS\n1\t10\trs1\tA\tC,G\t.\t.\tCLNSIG=Pathogenic;MC=SO:0001627|intron_variant;DB;GENEINFO=G1:5\n"
                    "2\t20\t.\tA\t.\t.\t.\tDB\n2\t21\trs3\tA\tT\t.\t.\tCLNSIG=Benign\n2\t22\trs4\tA\tTT\t.\t.\tCLNSIG=Benign\n")
    df = ss.read_vcf(spark, str(path))
    assert rows(df, "chrom", "pos", "rsid", "ref", "clinsig") == [
        ("1", 10, "rs1", "A", "Pathogenic"), ("2", 20, "", "A", ""), ("2", 21, "rs3", "A", "Benign"), ("2", 22, "rs4", "A", "Benign")]
    assert rows(snv_only(df), "pos", "alt") == [(10, "C"), (21, "T")]
    assert rows(noncoding(snv_only(df), "mc", "geneinfo"), "pos", "gene") == [(10, "G1"), (21, "?")]


def test_clinical_rules(spark):
    terms = {"Pathogenic": "pathogenic", "Likely_pathogenic": "pathogenic", "Benign/Likely_benign,other": "benign",
             "Conflicting_interpretations_of_pathogenicity": None, "Pathogenic,Benign": "pathogenic", "Uncertain_significance": None}
    df = spark.createDataFrame([(t,) for t in terms], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", clinical_label("t").alias("x")).collect()} == terms
    consequences = {"SO:0001627|intron_variant,SO:0001587|nonsense": True, "SO:0001627|intron_variant": False, "SO:0001583|x": True, "": False}
    df = spark.createDataFrame([(t,) for t in consequences] + [(None,)], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", is_coding("t").alias("x")).collect()} == {**consequences, None: False}


def atom(chain, resnum, b, resname="ALA", name="CA"):
    return f"ATOM  {1:5d}  {name:<3} {resname:>3} {chain}{resnum:4d}    {0:8.3f}{0:8.3f}{0:8.3f}{1:6.2f}{b:6.2f}"


def test_structures(spark, tmp_path):
    lines = [atom("A", 1, 30), atom("A", 1, 99, name="CB"), atom("A", 2, 20), atom("A", 3, 45), atom("B", 4, 10), atom("B", 5, 90),
             atom("B", 6, 70), "HETATM", atom("C", 2, 80, " DG"), atom("C", 1, 80, " DA"), atom("D", 1, 80, " DC"), atom("D", 2, 80, " DT")]
    (tmp_path / "s.pdb").write_text("\n".join(lines) + "\n")
    atoms = ss.read_pdb_atoms(spark, str(tmp_path / "s.pdb"))
    row = st.residue_confidence(atoms).first()
    assert row["low_segments"] == ["A:1:3", "B:4:4"] and row["low_segments_total"] == 2
    assert (row["n_residues"], row["fraction_confident"], row["fraction_low"]) == (10, .6, .4)
    assert sorted((r["chain"], r["sequence"]) for r in st.dna_chains(atoms).collect()) == [("C", "AG"), ("D", "CT")]
    assert st.has_dna(atoms).first()["has_dna"] is True
    d = st.duplexes(atoms).first()
    assert (d["fwd_chain"], d["rev_chain"]) == ("C", "D")


def test_small_files_in_bundles_come_back(spark, tmp_path):
    """Names and lines of any beginning, empty lines, and bundles that are cut into splits."""
    from lociframe import sinks
    from lociframe.sources.lines import bundled_lines
    rows = [(f, n, text) for f in ("a-1", "==> b", "\\c", "d e") for n, text in enumerate(["==> no file", "\\x", "", "plain", " é ", ""], 1)]
    rows += [(f"f{i}", n, f"line {n} of {i}") for i in range(300) for n in range(1, 1 + i % 5)]
    sinks.write_bundles(spark.createDataFrame(rows, "file string, line_no long, value string"), str(tmp_path / "b"))
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    try:
        got = bundled_lines(spark, str(tmp_path / "b"))
        assert got.rdd.getNumPartitions() > 50 and sorted(map(tuple, got.collect())) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    (tmp_path / "crlf").write_bytes(b"==> x.csv\r\n1\r\n2\r\n")
    assert [tuple(r) for r in bundled_lines(spark, str(tmp_path / "crlf")).collect()] == [("x.csv", 1, "1"), ("x.csv", 2, "2")]


@pytest.mark.parametrize("name", ["read_pdb_atoms", "read_metric_logs"])
def test_many_small_files_are_written_as_few(spark, tmp_path, monkeypatch, name):
    from lociframe.queries import QUERIES, file_queries
    monkeypatch.setattr(file_queries, "folder", lambda v, kind: str(tmp_path / kind))
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert 0 < len([p for p in tmp_path.rglob("part-*") if p.suffix != ".crc"]) <= 8


def test_metric_logs_of_differing_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("epoch,val_loss\n0,0.5\n1,\n")
    (tmp_path / "b.csv").write_text("val_auc,epoch,val_loss\n0.7,0,nan\n")
    got = {(r["file"][-5:], r["row_no"]): (r["epoch"], r["val_loss"], r["val_auc"]) for r in sl.read_metric_logs(spark, str(tmp_path)).collect()}
    assert got == {("a.csv", 0): ("0", "0.5", None), ("a.csv", 1): ("1", None, None), ("b.csv", 0): ("0", "nan", "0.7")}


LOG = ('{"timestamp": "2026-01-02T03:04:05.678Z", "tool": "a", "arguments": {"x": [1, 2]}, "seconds": 1.5, "is_error": false, "result": {"error": "no"}}\n'
       'nonsense\n[1, 2]\n\n{"timestamp": "2026-01-02T03:04:06Z", "tool": "b_c", "arguments": {}, "seconds": -2.0, "is_error": false}\n')


def test_call_log_batch_and_stream(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "calls.jsonl").write_text(LOG)
    good, bad = sl.read_call_log(spark, str(folder))
    assert bad.first()["bad_lines"] == 2
    assert sorted((r["call_id"], r["tool"], r["arguments"], r["ts_ms"] % 100_000) for r in good.collect()) == [
        (1, "a", '{"x":[1,2]}', 45_678), (5, "b_c", "{}", 46_000)]
    stream = follow_call_log(spark, str(folder), [("b_*", "Bees")])
    q = (stream.writeStream.format("memory").queryName("calls_seen").option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r["tool"]: (r["phase"], r["duration"], r["error"], r["state"]) for r in spark.table("calls_seen").collect()}
    assert got == {"a": ("Analysis", 1.5, True, "ok"), "b_c": ("Bees", 0.0, False, "missing")}


def test_tables_and_summaries(spark, rows, tmp_path):
    df = spark.createDataFrame([("m1", "0.5", "x"), ("m2", "NaN", "3"), ("m3", "inf", "4")], "method string, auc string, note string")
    sinks.write_table(df, str(tmp_path / "csv"), "csv")
    got = si.read_summary(spark, str(tmp_path / "csv"))
    assert dict(got.dtypes)["auc"] == "double" and dict(got.dtypes)["note"] == "string"
    assert {r["method"]: r["auc"] for r in got.collect()} == {"m1": .5, "m2": None, "m3": None}


def test_metrics_widen(spark, tmp_path):
    path = str(tmp_path / "metrics")
    sinks.append_metrics(spark, path, spark.createDataFrame([("a", 1.0)], "model string, test_loss double"))
    sinks.append_metrics(spark, path, spark.createDataFrame([("b", 2.0, .9)], "model string, test_loss double, test_auc double"))
    assert sorted((r["model"], r["test_auc"]) for r in sinks.read_metrics(spark, path).collect()) == [("a", None), ("b", .9)]
    (tmp_path / "metrics" / "_temporary").mkdir()      # an append that was never finished
    assert sinks.read_metrics(spark, path).count() == 2


def test_resumed_chunks(spark, rows, tmp_path):
    path = str(tmp_path / "scan")
    work = spark.range(100).withColumn("chunk", F.col("id") % 5)

    def compute(factor):
        return lambda df: df.withColumn("score", F.col("id") * factor)
    assert sinks.write_resumable(work.where("chunk < 2"), path, {"step": 1}, compute(2)) == 2
    assert sinks.write_resumable(work, path, {"step": 1}, compute(3)) == 3      # the two done chunks keep their values
    assert sinks.write_resumable(work, path, {"step": 1}, compute(9)) == 0
    assert sinks.write_resumable(work, path, {"step": 2}, compute(5)) == 5      # other parameters, other chunks
    got = rows(sinks.read_resumable(spark, path, {"step": 1}), "id", "score")
    assert got == [(i, i * (2 if i % 5 < 2 else 3)) for i in range(100)]


def test_negatives_are_numbered_in_genome_order(spark, tmp_path):
    df = spark.createDataFrame([("chr2", 5, 9, .5), ("chr1", 70_000, 70_004, .25), ("chr1", 3, 7, 1.0)], "chrom string, start long, end long, gc double")
    sinks.write_negatives(df, str(tmp_path / "neg"))
    got = si.read_bed(spark, str(tmp_path / "neg"), ["name", "gc"]).collect()
    assert sorted((r["name"], r["chrom"], r["start"], r["gc"]) for r in got) == [
        ("neg_1", "chr1", 3, "1.0000"), ("neg_2", "chr1", 70_000, "0.2500"), ("neg_3", "chr2", 5, "0.5000")]


@pytest.mark.parametrize("n, sizes", [(8, (1, 1, 6)), (3, (1, 1, 1)), (1000, (200, 160, 640))])
def test_split_sizes(spark, n, sizes):
    got = {r["split"]: r["count"] for r in ds.split_dataset(spark.range(n)).groupBy("split").count().collect()}
    assert (got["test"], got["val"], got["train"]) == sizes


def test_a_split_needs_three_rows(spark):
    with pytest.raises(Exception, match="at least 3"):
        ds.split_dataset(spark.range(2)).collect()


def test_scaling_is_fitted_on_train_and_undone(spark):
    df = spark.createDataFrame([("train", 1.0), ("train", 2.0), ("train", 3.0), ("test", 7.0)], "split string, label double")
    p = ds.fit_scaling(df)
    assert (p.first()["mean"], p.first()["std"]) == (2.0, 1.0)
    scaled = ds.apply_scaling(df, p)
    assert sorted(r["label"] for r in scaled.collect()) == [-1.0, 0.0, 1.0, 5.0]
    assert sorted(r["label"] for r in ds.inverse_scale(scaled, p, "label").collect()) == [1.0, 2.0, 3.0, 7.0]
    assert sorted(r["label"] for r in ds.inverse_scale(scaled, p, "label", classifier=True).collect()) == [-1.0, 0.0, 1.0, 5.0]
    assert ds.units("standardize", False) == "training_scale" and ds.units("none", False) == "label"
    assert ds.units("standardize", True) == "label" and ds.units(None, False, known=False) == "unknown"


def test_classification_balances_and_checks_lengths(spark):
    pos = spark.createDataFrame([(i, "ACGT") for i in range(9)], "id long, seq string")
    neg = spark.createDataFrame([(i, "TTTT") for i in range(4)], "id long, seq string")
    got = {r["label"]: r["count"] for r in ds.make_classification(pos, neg).groupBy("label").count().collect()}
    assert got == {0: 4, 1: 4}
    with pytest.raises(ValueError, match="lengths differ"):
        ds.make_classification(pos, neg.withColumn("seq", F.lit("AC")))
