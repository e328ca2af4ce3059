"""Numbered text lines, plain or compressed."""

from __future__ import annotations

import lzma
import zipfile
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIECE = 4 << 20
# The first bytes of the formats.
MAGIC = {"gzip": b"\x1f\x8b", "bz2": b"BZh", "xz": b"\xfd7zXZ\x00", "zstd": b"\x28\xb5\x2f\xfd", "zip": b"PK\x03\x04", "empty zip": b"PK\x05\x06"}
# Endings of names that Spark's text reader takes for a codec.
CODEC_ENDINGS = (".gz", ".bz2", ".zst", ".deflate", ".lz4", ".snappy")


def numbered_lines(spark: SparkSession, path, line_sep: str | None = None) -> DataFrame:
    """(file, line_no, value): the lines of text files, numbered from 1 within each file.

    Files are split as usual. The rows of one split follow each other, so a line's number is its
    place in its split plus the lines of the file's earlier splits, of which there is one
    count each. Bad UTF-8 becomes U+FFFD; a byte order mark and carriage returns are dropped.
    """
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    raw = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        F.regexp_replace(F.make_valid_utf8("value"), r"^\x{FEFF}|\r$", "").alias("value"))
    blocks = raw.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).drop("_n")
    return raw.join(offsets, ["file", "_block"]).select(
        "file", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line_no"), "value")


# What stands before the name of a small file, and before a line or a name that would be taken for one.
MARK, ESCAPE = "==> ", "\\"


def bundled_lines(spark: SparkSession, path) -> DataFrame:
    """(file, line_no, value): the lines of small files that were put one after the other into a few large ones (sinks.write_bundles).

    A small file begins with a line of "==> " and its name; a backslash before another line is dropped, and an empty line that
    ends one is no line of it. Bundles are split as usual, but a small file is
    one record, so it should hold some MB at most. A table of millions of small files thus costs no listing and no task for each.
    """
    text = F.make_valid_utf8("value")
    raw = spark.read.option("lineSep", "\n" + MARK).text(path)
    # Only a bundle's first record begins with the mark, as a name that does so has a backslash before it.
    whole = raw.select(F.regexp_replace(text, rf"\A{MARK}|\r?\n\z", "").alias("_text")).where(F.col("_text") != "")
    parts = whole.select(F.posexplode(F.split("_text", "\r?\n")).alias("_i", "_line"), F.substring_index("_text", "\n", 1).alias("_name")).where("_i > 0")

    def plain(c):
        return F.when(F.startswith(c, F.lit(ESCAPE)), F.substr(c, F.lit(2))).otherwise(c)
    return parts.select(plain(F.rtrim(F.col("_name"), F.lit("\r"))).alias("file"), F.col("_i").cast("long").alias("line_no"), plain(F.col("_line")).alias("value"))


class CompressedReadError(ValueError):
    """A file that cannot be decompressed; names the file and the reason."""


def on_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote(path[5:]).replace("//", "/", 1) if path[5:7] == "//" else unquote(path[5:])
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), str(Path(path).absolute()))


def codec_of(first: bytes) -> str:
    """The format of a file by its first bytes, else plain."""
    return next((name for name, magic in MAGIC.items() if first.startswith(magic)), "plain")


def _only_member(archive: zipfile.ZipFile) -> zipfile.ZipInfo:
    """The one file of an archive; folders, and what a Mac adds, are none."""
    files = [x for x in archive.infolist() if not x.is_dir() and x.filename.split("/")[0] != "__MACOSX"]
    if len(files) == 1:
        return files[0]
    raise ValueError(f"the zip archive holds {len(files)} files, not one")


def unpacked(path: str) -> Iterator[bytes]:
    """The bytes of a file in pieces, decompressed by what its first bytes say; never the whole file at once."""
    store, place = on_store(path)
    with store.open_input_file(place) as source:
        codec = codec_of(source.read(8))
        source.seek(0)
        if codec.endswith("zip") and codec != "gzip":
            with zipfile.ZipFile(source) as archive, archive.open(_only_member(archive)) as text:
                yield from iter(lambda: text.read(PIECE), b"")
        elif codec == "xz":
            with lzma.LZMAFile(source) as text:
                yield from iter(lambda: text.read(PIECE), b"")
        elif codec == "plain":
            yield from iter(lambda: source.read(PIECE), b"")
        else:
            with pa.CompressedInputStream(source, codec) as text:
                yield from iter(lambda: text.read(PIECE), b"")


def _text_lines(pieces: Iterator[bytes]) -> Iterator[list[str]]:
    """Lists of lines; a line ends with a line feed, a carriage return or both."""
    rest, first = b"", True
    for piece in pieces:
        data = rest + piece
        if first and len(data) >= 3:
            data, first = data.removeprefix(b"\xef\xbb\xbf"), False
        cut = data.rfind(b"\n") + 1
        rest = data[cut:]
        if cut:
            yield [x.decode("utf-8", "replace") for x in data[:cut].splitlines()]
    if rest:
        yield [x.decode("utf-8", "replace") for x in rest.splitlines()]


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("file").to_pylist():
            done = 0
            try:
                for lines in _text_lines(unpacked(path)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(lines)), pa.array(range(done + 1, done + 1 + len(lines)), pa.int64()), pa.array(lines, pa.string())],
                        names=["file", "line_no", "value"])
                    done += len(lines)
            except Exception as exc:
                raise CompressedReadError(f"{path} cannot be read: {type(exc).__name__}: {exc}") from exc


def _peeked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codecs = []
        for path in batch.column("file").to_pylist():
            store, place = on_store(path)
            with store.open_input_stream(place, compression=None) as source:
                codecs.append(codec_of(source.read(8)))
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("path"), pa.array(codecs, pa.string())], names=["file", "path", "codec"])


def read_compressed_lines(spark: SparkSession, path) -> DataFrame:
    """(file, line_no, value) of plain, gzip, bzip2, xz, zstd and one-file zip files, told by content.

    Only the first bytes of each file are read to tell them. Plain files go to Spark's text reader, in splits; compressed
    ones, and those whose name feigns a codec, are streamed in pieces, a file to a task. A corrupt or truncated file, or a zip with
    several files, fails with CompressedReadError.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "path")
    told = files.mapInArrow(_peeked, "file string, path string, codec string").collect()      # one short row per file, as in Spark's own listing
    readable = {r["file"]: r["codec"] == "plain" and not r["path"].endswith(CODEC_ENDINGS) for r in told}
    direct, other = [r["path"] for r in told if readable[r["file"]]], [(r["file"],) for r in told if not readable[r["file"]]]
    streamed = (spark.createDataFrame(other, "file string").repartition(max(1, len(other)), "file")
                .mapInArrow(_streamed, "file string, line_no long, value string"))
    if not direct:
        return streamed
    plain = numbered_lines(spark, direct)
    return plain.unionByName(streamed) if other else plain
