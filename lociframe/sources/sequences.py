"""FASTA, genomes, motif files, variants and structures."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lociframe.sources.lines import bundled_lines, numbered_lines, on_store, unpacked

BIN_WIDTH = 8192


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """file, record_no (from 0), name, seq: one row per record.

    The name is the first word after ">", or seq and the record's number; lines are joined and blank ones
    ignored; text before the first header is dropped.
    """
    raw = numbered_lines(spark, path, line_sep="\n>")
    # Files that begin with other text; they count their records from the second piece. At most one row per file.
    late = raw.where((F.col("line_no") == 1) & ~F.col("value").rlike(r"^\s*>")).select("file", F.lit(1).alias("_late"))
    body = F.when(F.col("line_no") == 1, F.regexp_replace("value", r"^\s*>", "")).otherwise(F.col("value"))
    head = F.trim(F.regexp_extract(body, r"^[^\r\n]*", 0))
    rows = raw.where((F.col("line_no") > 1) | F.col("value").rlike(r"^\s*>")).join(F.broadcast(late), "file", "left")
    no = F.col("line_no") - 1 - F.coalesce("_late", F.lit(0))
    return rows.select(
        "file", no.alias("record_no"),
        F.when(head == "", F.concat(F.lit("seq"), no.cast("string"))).otherwise(F.regexp_extract(head, r"^\S+", 0)).alias("name"),
        F.regexp_replace(F.regexp_replace(body, r"^[^\r\n]*", ""), r"\s+", "").alias("seq"))


def indexed_files(path: str) -> list[str]:
    """The FASTA file of a path, or those of a folder, that have a .fai; none where the store is not known to pyarrow.fs."""
    try:
        store, place = on_store(path)
    except (pa.ArrowInvalid, OSError):
        return []
    if store.get_file_info(place).type == fs.FileType.Directory:
        own = [x.path for x in store.get_file_info(fs.FileSelector(place)) if x.path.endswith(".fai")]
        return sorted(f"{path.rstrip('/')}/{x.rsplit('/', 1)[-1][:-4]}" for x in own)
    return [path] if store.get_file_info(place + ".fai").type == fs.FileType.File else []


def _index_rows(pieces: Iterator[bytes]) -> Iterator[tuple[str, int, int, int, int]]:
    """(name, length, offset, bases per line, bytes per line) of each record, from the bytes of a file in pieces."""
    at, name, length, offset, bases, width, rest = 0, None, 0, 0, 0, 0, b""
    for data in itertools.chain(pieces, [None]):
        lines = [rest] if data is None else (rest + data).split(b"\n")
        rest = b"" if data is None else lines.pop()
        for line in lines:
            size = len(line) + (data is not None)
            if line.startswith(b">"):
                if name is not None:
                    yield name, length, offset, bases, width
                name, length, offset, bases, width = (line[1:].split() or [b""])[0].decode(), 0, at + size, 0, 0
            elif line.strip():
                own = len(line.rstrip())
                if not bases:
                    bases, width = own, size if data is not None else own
                length += own
            at += size
    if name is not None:
        yield name, length, offset, max(1, bases), max(1, width)


def _indexer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = []
        for file in batch.column("file").to_pylist():
            rows = list(_index_rows(unpacked(file)))
            store, place = on_store(file)
            with store.open_output_stream(place + ".fai", compression=None) as out:
                out.write("".join("\t".join(map(str, r)) + "\n" for r in rows).encode())
            counts.append(len(rows))
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(counts, pa.int64())], names=["file", "records"])


def index_fasta(spark: SparkSession, path) -> int:
    """Write a .fai next to every FASTA file of path, a task per file, and return the number of records.

    Lines of a record have one length, but for the last, as the index demands.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file")).where(~F.col("file").endswith(".fai"))
    return files.repartition("file").mapInArrow(_indexer, "file string, records long").agg(F.sum("records")).first()[0] or 0


class _Ranges(InputPartition):
    """Bins first..last of contigs of one file: (chrom, first, last, length, offset, bases, width) each."""

    def __init__(self, fasta):
        self.fasta, self.ranges, self.bins = fasta, [], 0


class IndexedFasta(DataSource):
    """Genome bins out of FASTA files with .fai indexes: partitions are byte ranges of the files.

    Options: path (a file, or a folder of files with indexes; a path or a URI of a store that pyarrow.fs knows), bin_width,
    bins_per_partition.
    """

    @classmethod
    def name(cls):
        return "indexed_fasta"

    def schema(self):
        return "chrom string, bin long, seq string"

    def reader(self, schema):
        return _IndexedFastaReader(self.options)


class _IndexedFastaReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.bin_width = int(options.get("bin_width", BIN_WIDTH))
        self.per_part = int(options.get("bins_per_partition", 4096))

    def partitions(self):
        parts = []
        for fasta in indexed_files(self.path):
            store, place = on_store(fasta)
            with store.open_input_stream(place + ".fai", compression=None) as index:
                rows = [x.split("\t")[:5] for x in index.read().decode().splitlines() if x]
            for name, *numbers in rows:
                length, offset, bases, width = map(int, numbers)
                n = -(-length // self.bin_width)
                for first in range(0, n, self.per_part):
                    last = min(first + self.per_part, n)
                    if not parts or parts[-1].fasta != fasta or parts[-1].bins + last - first > self.per_part:
                        parts.append(_Ranges(fasta))
                    parts[-1].ranges.append((name, first, last, length, offset, bases, width))
                    parts[-1].bins += last - first
        return parts

    def read(self, part) -> Iterator[pa.RecordBatch]:
        store, place = on_store(part.fasta)
        with store.open_input_file(place) as fasta:
            for chrom, start, last, length, offset, bases, width in part.ranges:
                def byte(pos):
                    return offset + pos // bases * width + pos % bases
                for first in range(start, last, 64):
                    bins = range(first, min(first + 64, last))
                    seqs = []
                    for b in bins:
                        lo, hi = b * self.bin_width, min((b + 1) * self.bin_width, length)
                        text = fasta.read_at(byte(hi - 1) + 1 - byte(lo), byte(lo))
                        seqs.append(text.replace(b"\n", b"").replace(b"\r", b"").decode("ascii").upper())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chrom] * len(seqs)), pa.array(list(bins), pa.int64()), pa.array(seqs)],
                        names=["chrom", "bin", "seq"])


def read_genome(spark: SparkSession, fasta: str, bin_width: int = BIN_WIDTH) -> DataFrame:
    """(chrom, bin, seq) bins of a genome, upper case.

    With a .fai next to the file, or to each file of a folder, bins are read by byte range (index_fasta writes them);
    without one, records are read whole and cut. Write the result once as Parquet and read that afterwards.
    """
    if indexed_files(fasta):
        spark.dataSource.register(IndexedFasta)
        return spark.read.format("indexed_fasta").option("path", fasta).option("bin_width", str(bin_width)).load()
    from lociframe.functions.dna import as_bytes, cut
    records = read_fasta(spark, fasta).select(F.col("name").alias("chrom"), as_bytes(F.upper("seq")).alias("_s"))
    starts = F.sequence(F.lit(0).cast("long"), F.expr(f"(octet_length(_s) - 1) div {bin_width}"))
    return (records.where(F.octet_length("_s") > 0).withColumn("bin", F.explode(starts))
            .select("chrom", "bin", cut("_s", F.col("bin") * bin_width, bin_width).alias("seq")))


_NUMBER = r"[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?"


def read_meme(spark: SparkSession, path) -> DataFrame:
    """file, motif, pos, base, prob, bg, nsites of motif files; several motifs per file.

    The background is the file's, else even. A matrix is the lines of four numbers after its
    letter-probability line, up to the first other line.
    """
    text = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r", "").alias("t"))
    line = F.regexp_extract("t", r"Background letter frequencies[^\n]*\n([^\n]*)", 1)
    bg = F.array(*[F.coalesce(F.regexp_extract(line, rf"(?:^|\s){b}\s+({_NUMBER})", 1).try_cast("double"), F.lit(0.25)) for b in "ACGT"])
    blocks = text.select("file", bg.alias("bg"), F.explode(F.slice(F.split("t", r"(?m)^MOTIF"), 2, 1 << 20)).alias("b"))
    row = rf"[ \t]*{_NUMBER}(?:[ \t]+{_NUMBER}){{3}}[ \t]*(?:\n|$)"
    head = F.regexp_extract("b", r"letter-probability matrix([^\n]*)", 1)
    matrix = F.regexp_extract("b", rf"letter-probability matrix[^\n]*\n((?:{row})+)", 1)
    rows = blocks.select(
        "file", F.regexp_extract(F.trim("b"), r"^\S+", 0).alias("motif"), "bg",
        F.regexp_extract(head, rf"nsites=\s*({_NUMBER})", 1).try_cast("double").alias("nsites"),
        F.posexplode(F.filter(F.split(matrix, "\n"), lambda x: F.trim(x) != "")).alias("pos", "line"))
    values = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("double"))
    return rows.select("file", "motif", F.col("pos").cast("long").alias("pos"), "nsites", "bg", F.posexplode(values).alias("_b", "prob")).select(
        "file", "motif", "pos", F.substring(F.lit("ACGT"), F.col("_b") + 1, F.lit(1)).alias("base"), "prob",
        F.get("bg", F.col("_b")).alias("bg"), "nsites")


def read_vcf(spark: SparkSession, path) -> DataFrame:
    """chrom, pos, rsid, ref, alts (NULL for "."), info (a map), clinsig, mc, geneinfo.

    Reads all of the files; sources.variants.read_variants reads the wanted blocks of block-compressed ones with an index.
    """
    return variant_columns(spark.read.text(path))


def variant_columns(lines: DataFrame, *keep: str) -> DataFrame:
    """The columns of read_vcf from the lines (value) of variant files, after the columns to keep."""
    p = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(
        *keep, F.get(p, F.lit(0)).alias("chrom"), F.get(p, F.lit(1)).try_cast("long").alias("pos"), F.get(p, F.lit(2)).alias("_id"),
        F.get(p, F.lit(3)).alias("ref"), F.get(p, F.lit(4)).alias("_alt"), F.str_to_map(F.get(p, F.lit(7)), F.lit(";"), F.lit("=")).alias("info"))
    return rows.select(
        *keep, "chrom", "pos", F.when(F.col("_id") == ".", "").otherwise(F.col("_id")).alias("rsid"), "ref",
        F.when(F.col("_alt") != ".", F.split("_alt", ",")).alias("alts"), "info",
        F.coalesce(F.try_element_at("info", F.lit("CLNSIG")), F.lit("")).alias("clinsig"),
        F.try_element_at("info", F.lit("MC")).alias("mc"), F.try_element_at("info", F.lit("GENEINFO")).alias("geneinfo"))


def read_pdb_atoms(spark: SparkSession, path, bundled: bool = False) -> DataFrame:
    """file, line_no, chain, resname, resnum, residue (number and insertion code), bfactor, short (no room for one) of ATOM lines.

    bundled: the structures stand one after the other in bundles (sources.lines.bundled_lines), as many files of some KB should.
    """
    v = F.col("value")
    return (bundled_lines if bundled else numbered_lines)(spark, path).where(v.startswith("ATOM")).select(
        "file", "line_no", F.substring(v, 22, 1).alias("chain"), F.trim(F.substring(v, 18, 3)).alias("resname"),
        F.trim(F.substring(v, 23, 4)).try_cast("int").alias("resnum"), F.substring(v, 23, 5).alias("residue"),
        F.when(F.length(v) >= 66, F.trim(F.substring(v, 61, 6)).try_cast("double")).alias("bfactor"),
        (F.length(v) < 66).alias("short"))
