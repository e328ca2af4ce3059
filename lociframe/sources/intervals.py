"""BED files and tables of peaks, motif hits and labelled sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.sources.lines import numbered_lines, read_compressed_lines


def bed_lines(spark: SparkSession, path, by_content: bool = False) -> DataFrame:
    """The data lines of BED files, numbered: no blank lines, none that start with #, track or browser.

    A "#" inside a line is data. by_content tells the compression by the file's first bytes;
    otherwise files are read in splits and .gz and .bz2 names are decompressed.
    """
    lines = read_compressed_lines(spark, path) if by_content else numbered_lines(spark, path)
    return lines.where((F.trim("value") != "") & ~F.col("value").rlike(r"^(#|track|browser)")
                       & ~F.col("value").rlike(r"^\s+$"))


def read_bed(spark: SparkSession, path, names: Sequence[str] | None = None, by_content: bool = False) -> DataFrame:
    """file, line_no and the columns by position: chrom, start, end, then names or an array of the rest."""
    parts = F.split("value", "\t")
    rows = bed_lines(spark, path, by_content).select(
        "file", "line_no", F.get(parts, F.lit(0)).alias("chrom"), F.get(parts, F.lit(1)).try_cast("long").alias("start"),
        F.get(parts, F.lit(2)).try_cast("long").alias("end"), parts.alias("_p"))
    if names is None:
        return rows.withColumn("rest", F.slice("_p", 4, 1 << 20)).drop("_p")
    return rows.select("file", "line_no", "chrom", "start", "end",
                       *[F.get("_p", F.lit(3 + i)).alias(n) for i, n in enumerate(names)])


def read_peaks(spark: SparkSession, path, by_content: bool = False) -> tuple[DataFrame, str | None]:
    """chrom, start, end, num, and what keeps column 4 from being a count (None when nothing does).

    num is column 4 when it is a finite number on every line (whole numbers stay whole), otherwise 1.
    A line with fewer than 3 columns, or with a start or end that is no integer, is an error
    that names the first one.
    """
    tabs = F.split("value", "\t")
    parts = F.when(F.size(tabs) >= 3, tabs).otherwise(F.split(F.trim("value"), r"\s+"))
    rows = bed_lines(spark, path, by_content).withColumn("_p", parts)
    fourth = F.trim(F.get("_p", F.lit(3)))
    number = fourth.try_cast("double")
    rows = rows.select(
        "file", "line_no", "value", F.size("_p").alias("_n"), F.trim(F.get("_p", F.lit(0))).alias("chrom"),
        F.trim(F.get("_p", F.lit(1))).try_cast("long").alias("start"), F.trim(F.get("_p", F.lit(2))).try_cast("long").alias("end"),
        fourth.alias("_fourth"), F.when(F.abs(number) < float("inf"), number).alias("_num"))
    place = F.struct("file", "line_no")
    short = F.col("_n") < 3
    broken = ~short & (F.col("start").isNull() | F.col("end").isNull())

    def first(what, where):
        return F.min_by(F.struct("line_no", "file", what), F.when(where, place))

    f = rows.agg(
        first("value", short).alias("short"), first("value", broken).alias("broken"),
        first("_fourth", F.col("_num").isNull()).alias("odd"),
        F.bool_and(F.col("_num") == F.floor("_num")).alias("whole")).first()
    for bad, what in ((f["short"], "has fewer than 3 columns"), (f["broken"], "start and end must be integers")):
        if bad is not None:
            raise ValueError(f"{bad['file']} line {bad['line_no']} {what}: {bad['value'].strip()[:80]!r}")
    problem = None
    if f["odd"] is not None:
        text = f["odd"]["_fourth"]
        problem = (f"line {f['odd']['line_no']} has no 4th column" if text is None
                   else f"line {f['odd']['line_no']} has {text[:60]!r} in column 4")
    num = F.lit(1).cast("long") if problem else F.col("_num").cast("long") if f["whole"] else F.col("_num")
    return rows.select("chrom", "start", "end", num.alias("num")), problem


REMAP_COLUMNS = ("name", "score", "strand", "thickStart", "thickEnd", "itemRgb")


def read_remap(spark: SparkSession, path) -> DataFrame:
    """Peaks of nine named columns; score counts the supporting experiments."""
    rows = read_bed(spark, path, REMAP_COLUMNS)
    return rows.select("chrom", "start", "end", "name", F.col("score").try_cast("double").alias("score"), "strand",
                       F.col("thickStart").try_cast("long").alias("thickStart"),
                       F.col("thickEnd").try_cast("long").alias("thickEnd"), "itemRgb")


def read_intersect(spark: SparkSession, folder: str, tfs: Sequence[str], suffix: str = ".allintersect.bed") -> DataFrame:
    """tf, chrom, start, end, num of one file per factor: the header is skipped, columns 0-3 are read,
    factors without a file are left out."""
    schema = "chrom string, start long, end long, num double"
    parts = []
    for tf in tfs:
        try:
            rows = spark.read.csv(f"{folder}/{tf}{suffix}", sep="\t", header=True, schema=schema)
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" in str(exc):
                continue
            raise
        parts.append(rows.select(F.lit(tf).alias("tf"), "chrom", "start", "end", "num"))
    if not parts:
        raise ValueError(f"none of {list(tfs)} has a file in {folder}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_hits(spark: SparkSession, path, motif: str | None = None) -> DataFrame:
    """Motif hits of a tab-separated table with # comments, of one motif or of all."""
    rows = spark.read.csv(path, sep="\t", header=True, comment="#", inferSchema=False)
    rows = rows.withColumns({c: F.col(c).try_cast(t) for c, t in (
        ("start", "long"), ("stop", "long"), ("score", "double"), ("p-value", "double")) if c in rows.columns})
    return rows if motif is None else rows.where(F.col("motif_id") == motif)


def read_labelled(spark: SparkSession, path, seq: str | None = None, target: str | None = None) -> DataFrame:
    """seq and label of a two-column CSV, or of the columns named; an unnamed first column is the sequence."""
    rows = spark.read.csv(path, header=True)
    first = rows.columns[0]
    if first in ("_c0", "", "Unnamed: 0"):
        rows = rows.withColumnRenamed(first, "seq")
    seq, target = seq or rows.columns[0], target or rows.columns[1]
    return rows.select(F.col(f"`{seq}`").alias("seq"), F.col(f"`{target}`").try_cast("double").alias("label"))


def read_summary(spark: SparkSession, path) -> DataFrame:
    """A result table; a column whose non-blank values are all numbers is numeric, with NULL for NaN and infinity."""
    rows = spark.read.csv(path, header=True)
    blank = {c: F.col(f"`{c}`").isNull() | (F.trim(F.col(f"`{c}`")) == "") for c in rows.columns}
    facts = rows.agg(*[F.bool_and(blank[c] | F.col(f"`{c}`").try_cast("double").isNotNull()).alias(c) for c in rows.columns]).first()
    out = []
    for c in rows.columns:
        value = F.col(f"`{c}`").try_cast("double")
        out.append(F.when(F.abs(value) < float("inf"), value).alias(c) if facts[c] else F.col(f"`{c}`"))
    return rows.select(*out)
