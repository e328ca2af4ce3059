"""Variants out of block-compressed files with a .tbi or .csi index: only the blocks of wanted regions are read.

For a table of regions the index is a table too, one row per chunk of a bin; regions are joined to it on (contig, width, bin),
what is left of the chunks is merged and cut into ranges of a bounded number of bytes, and each task reads ranges. The driver sees
no chunk. For a few regions given as text there is a data source, whose partitions are such ranges, planned from the index.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lociframe.functions.contigs import contig_key
from lociframe.operators.intervals import merge_intervals, overlap_join
from lociframe.session import stored
from lociframe.sources import bgzf
from lociframe.sources.lines import on_store
from lociframe.sources.sequences import variant_columns

RANGE_BYTES = 32 << 20     # compressed bytes that a task reads at about most
SUFFIXES = (".tbi", ".csi")
_CHUNKS = "file string, chrom string, width int, bin long, begin long, stop long"
_LINES = "file string, at long, value string"


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def index_of(file: str) -> str | None:
    """The index file next to a variant file."""
    store, place = on_store(file)
    return next((place + s for s in SUFFIXES if store.get_file_info(place + s).type == fs.FileType.File), None)


def _files(spark: SparkSession, path) -> DataFrame:
    """(file) of the block-compressed files of a path, in which only names are read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,bgz}").load(path)
    return found.select(F.col("_metadata.file_path").alias("file"))


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.column("file").to_pylist():
            store, _ = on_store(file)
            at = index_of(file)
            if at is None:
                raise FileNotFoundError(f"{file} has no index; index_variants writes one")
            with store.open_input_file(at) as source:
                index = bgzf.unpack_index(source)
            for chrom, own in index.contigs.items():
                rows = []
                for number, chunks in own.bins.items():
                    rows += [(file, chrom, *bgzf.bin_range(number, index.shift, index.depth), a, b) for a, b in chunks]
                rows += [(file, chrom, -index.shift, k, floor, floor) for k, floor in enumerate(own.floors)]
                for k in range(0, len(rows), 10_000):
                    yield _batch(_CHUNKS, rows[k:k + 10_000])


def index_table(spark: SparkSession, path) -> DataFrame:
    """(file, chrom, width, bin, begin, stop): a row per chunk of a bin of 2^width bases; rows with a negative width give the first
    offset of the records that reach into the bin of 2^-width bases."""
    files = _files(spark, path)
    return files.repartition("file").mapInArrow(_chunk_rows, _CHUNKS)


def _indexer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.column("file").to_pylist():
            store, place = on_store(file)
            with store.open_input_file(place) as source:
                index = bgzf.index_records(source)
            with store.open_output_stream(place + ".tbi", compression=None) as out:
                out.write(bgzf.compressed(index.packed()))
            yield pa.RecordBatch.from_pydict({"file": [file], "contigs": [len(index.contigs)]})


def index_variants(spark: SparkSession, path) -> int:
    """Write a .tbi next to every block-compressed variant file of path, a task per file; returns the number of files."""
    return _files(spark, path).repartition("file").mapInArrow(_indexer, "file string, contigs long").count()


def write_variants(lines: DataFrame, path: str, parts: int, header: tuple[str, ...] = ("##fileformat=VCFv4.2",)) -> None:
    """Write variant lines (chrom, pos, value) as block-compressed files with indexes, sorted, `parts` ranges of the genome.

    A task writes under a name of its own and moves its file in place when it is whole, so a task that is run
    again leaves one file.
    """
    head = [h.encode() for h in header] + [b"#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, folder = on_store(path)
        store.create_dir(folder)
        own = f"{folder}/part-{task.partitionId():05d}.vcf.gz"
        draft, n = f"{folder}/_{task.taskAttemptId()}-{task.partitionId()}", 0
        with store.open_output_stream(draft, compression=None) as out:
            writer = bgzf.Writer(out)
            for h in head:
                writer.line(h)
            for batch in batches:
                for value in batch.column("value").to_pylist():
                    line = value.encode()
                    chrom, start, end = bgzf.record_span(line)
                    writer.line(line, (chrom.decode(), start, end))
                    n += 1
            writer.close()
        if not n:
            store.delete_file(draft)
            return
        with store.open_output_stream(draft + ".tbi", compression=None) as out:
            out.write(bgzf.compressed(writer.index.packed()))
        store.move(draft + ".tbi", own + ".tbi")
        store.move(draft, own)
        yield pa.RecordBatch.from_pydict({"file": [own], "rows": [n]})

    sorted_ = lines.select("chrom", "pos", "value").repartitionByRange(parts, "chrom", "pos").sortWithinPartitions("chrom", "pos", "value")
    sorted_.mapInArrow(write, "file string, rows long").agg(F.sum("rows")).collect()


def _read_ranges(rows: Iterator[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
    now, source = None, None
    for file, begin, stop in rows:
        if file != now:
            if source is not None:
                source.close()
            store, place = on_store(file)
            now, source = file, store.open_input_file(place)
        for offsets, lines in bgzf.lines_between(source, begin, stop):
            text = [x.rstrip(b"\r").decode("utf-8", "replace") for x in lines]
            yield _batch(_LINES, [(file, at, x) for at, x in zip(offsets, text)] if text else [])
    if source is not None:
        source.close()


def _touched_bins(width: int) -> Column:
    """The bins of 2^width bases that start .. end touches."""
    return F.transform(F.sequence(F.shiftright("start", width), F.shiftright(F.col("end") - 1, width)), lambda b: F.struct(F.lit(width).alias("width"), b.alias("bin")))


def wanted_ranges(spark: SparkSession, path, regions: DataFrame | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, begin, stop): disjoint ranges of virtual offsets that hold all records of the regions (chrom, start, end), or all records.

    A chunk counts if its bin touches a region and it does not end before the first record that reaches into the region's first bin.
    """
    index = stored(index_table(spark, path).withColumn("key", contig_key("chrom")))
    chunks = index.filter("width > 0")
    if regions is not None:
        # The widths are a handful of numbers that the format fixes.
        widths = [r[0] for r in chunks.select("width").distinct().collect()]
        asked = regions.filter(F.col("start") < F.col("end")).select(contig_key("chrom").alias("key"), F.greatest(F.col("start").cast("long"), F.lit(0)).alias("start"), F.col("end").cast("long").alias("end"))
        bins = [_touched_bins(w) for w in widths] or [F.array().cast("array<struct<width:int,bin:long>>")]
        touched = asked.select("key", "start", F.explode(F.flatten(F.array(*bins))).alias("x")).select("key", "start", "x.*")
        hits = chunks.join(touched, ["key", "width", "bin"])
        floors = index.filter("width < 0").select("file", "key", (-F.col("width")).alias("_w"), F.col("bin").alias("_b"), F.col("begin").alias("floor"))
        # Only wide bins can hold chunks far before the region; narrow ones lie in it.
        narrow = min(widths, default=0)
        far = hits.filter(F.col("width") > narrow).withColumn("_b", F.shiftright("start", narrow))
        far = far.join(floors, ["file", "key", "_b"], "left").filter(F.col("floor").isNull() | (F.col("stop") > F.col("floor")))
        chunks = hits.filter(F.col("width") == narrow).select("file", "begin", "stop").unionByName(far.select("file", "begin", "stop"))
    slab = F.shiftright("begin", 16 + (range_bytes - 1).bit_length())
    pieces = merge_intervals(chunks.select("file", slab.alias("slab"), F.col("begin").alias("start"), F.col("stop").alias("end")), ["file", "slab"], None, 32)
    after = F.lead("start").over(Window.partitionBy("file").orderBy("start"))       # a few rows per slab of a file
    return pieces.select("file", F.col("start").alias("begin"), F.least("end", F.coalesce(after, F.col("end"))).alias("stop"))


def variant_lines(spark: SparkSession, path, regions: DataFrame | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, at, value): the lines of the wanted ranges, with their virtual offsets."""
    ranges = stored(wanted_ranges(spark, path, regions, range_bytes))
    size = ranges.agg(F.sum(F.shiftright("stop", 16) - F.shiftright("begin", 16) + bgzf.BLOCK)).first()[0] or 0
    dealt = ranges.repartitionByRange(max(1, -(-size // range_bytes)), "file", "begin").sortWithinPartitions("file", "begin")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _read_ranges(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("file", "begin", "stop"))))
    return dealt.mapInArrow(read, _LINES)


def read_variants(spark: SparkSession, path, regions: DataFrame | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The columns of read_vcf, from block-compressed files with indexes: all variants, or those that overlap a region, each once.

    regions has chrom, start, end; chr1 and 1 name one contig. The contig is named as in the file.
    """
    rows = variant_columns(variant_lines(spark, path, regions, range_bytes), "file", "at")
    if regions is None:
        return rows.drop("file", "at")
    merged = merge_intervals(regions.filter(F.col("start") < F.col("end")).select(contig_key("chrom").alias("_key"), "start", "end"), ["_key"], None)
    end = F.greatest(F.col("pos") - 1 + F.length("ref"), F.coalesce(F.try_element_at("info", F.lit("END")).try_cast("long"), F.lit(0)))
    placed = rows.withColumns({"_key": contig_key("chrom"), "start": F.col("pos") - 1, "end": end})
    found = overlap_join(placed, merged, ["_key"], row_key=F.struct("file", "at"))
    return found.dropDuplicates(["file", "at"]).select(*[c for c in rows.columns if c not in ("file", "at")])


class _Part(InputPartition):
    def __init__(self, ranges):
        self.ranges = ranges


class IndexedVariants(DataSource):
    """Lines of block-compressed variant files with indexes: file, at (virtual offset), value.

    Options: path (a file, or a folder of files; a path or a URI of a store that pyarrow.fs knows), regions (`1:100-200,X`; first and
    last base, from 1; all when absent), range_bytes. Lines near a region may come with it; read_region drops them.
    """

    @classmethod
    def name(cls):
        return "indexed_variants"

    def schema(self):
        return _LINES

    def reader(self, schema):
        return _IndexedVariantsReader(self.options)


def parse_regions(text: str) -> list[tuple[str, int, int]]:
    """(contig, start, end) of `1:100-200,X`, 0-based and half-open."""
    out = []
    for part in filter(None, (x.strip() for x in text.split(","))):
        m = re.fullmatch(r"(.+?)(?::([0-9]+)(?:-([0-9]+))?)?", part)
        out.append((m[1], int(m[2]) - 1 if m[2] else 0, int(m[3]) if m[3] else 1 << 40))
    return out


def _bare(name: str) -> str:
    name = name.removeprefix("chr")
    return "MT" if name == "M" else name


def planned(index: bgzf.Index, regions: list[tuple[str, int, int]] | None, range_bytes: int = RANGE_BYTES) -> list[tuple[int, int]]:
    """Disjoint ranges of virtual offsets for a few regions, from an index in memory."""
    chunks = []
    for chrom, own in index.contigs.items():
        spans = [(0, 1 << 40)] if regions is None else [(a, b) for name, a, b in regions if _bare(name) == _bare(chrom)]
        for start, end in spans:
            floor = own.floors[min(start >> index.shift, len(own.floors) - 1)] if own.floors else 0
            for number, pieces in own.bins.items():
                width, k = bgzf.bin_range(number, index.shift, index.depth)
                if k << width < end and start < (k + 1) << width:
                    chunks += [c for c in pieces if c[1] > floor]
    out: list[list[int]] = []
    for begin, stop in sorted(chunks):
        if out and begin <= out[-1][1] and (begin - out[-1][0]) >> 16 < range_bytes:
            out[-1][1] = max(out[-1][1], stop)
        else:
            if out:
                out[-1][1] = min(out[-1][1], begin)
            out.append([begin, stop])
    return [(a, b) for a, b in out]


class _IndexedVariantsReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.range_bytes = options["path"], int(options.get("range_bytes", RANGE_BYTES))
        self.regions = parse_regions(options["regions"]) if "regions" in options else None

    def partitions(self):
        store, place = on_store(self.path)
        files = [place]
        if store.get_file_info(place).type == fs.FileType.Directory:
            files = sorted(x.path for x in store.get_file_info(fs.FileSelector(place)) if x.path.endswith((".gz", ".bgz")))
        parts, room = [], 0
        for file in files:
            at = index_of(file)
            if at is None:
                raise FileNotFoundError(f"{file} has no index; index_variants writes one")
            with store.open_input_file(at) as source:
                ranges = planned(bgzf.unpack_index(source), self.regions, self.range_bytes)
            for begin, stop in ranges:
                size = (stop - begin >> 16) + bgzf.BLOCK
                if not parts or room < size:
                    parts.append(_Part([]))
                    room = self.range_bytes
                parts[-1].ranges.append((file, begin, stop))
                room -= size
        return parts

    def read(self, part) -> Iterator[pa.RecordBatch]:
        yield from _read_ranges(iter(part.ranges))


def read_region(spark: SparkSession, path: str, regions: str) -> DataFrame:
    """The columns of read_vcf for the variants that overlap one of a few regions, `1:100-200,X`, through the data source."""
    spark.dataSource.register(IndexedVariants)
    rows = variant_columns(spark.read.format("indexed_variants").option("path", path).option("regions", regions).load(), "file", "at")
    end = F.greatest(F.col("pos") - 1 + F.length("ref"), F.coalesce(F.try_element_at("info", F.lit("END")).try_cast("long"), F.lit(0)))
    hit = F.lit(False)
    for chrom, a, b in parse_regions(regions):
        hit = hit | ((contig_key("chrom") == _bare(chrom)) & (F.col("pos") - 1 < b) & (end > a))
    return rows.filter(hit).drop("file", "at")
