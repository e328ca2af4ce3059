"""Writers of regions, sequences, tables, motifs, tracks, datasets and resumable results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociframe.operators.intervals import track_intervals
from lociframe.session import stored
from lociframe.sources.lines import ESCAPE, MARK


def number_rows(df: DataFrame, out: str = "k", bits: int = 16) -> DataFrame:
    """Numbers rows from 1 in the order of (chrom, start): counts per bin are summed up first, so only
    the rows of one bin are ever ordered together."""
    binned = df.withColumn("_bin", F.shiftright(F.col("start").cast("long"), bits))
    order = Window.partitionBy(F.lit(0)).orderBy("chrom", "_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = binned.groupBy("chrom", "_bin").agg(F.count(F.lit(1)).alias("_n"))   # one row per bin
    before = counts.select("chrom", "_bin", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("chrom", "_bin").orderBy("start", "end")
    return (binned.join(before, ["chrom", "_bin"])
            .withColumn(out, F.col("_before") + F.row_number().over(inside)).drop("_bin", "_before"))


def write_bed(df: DataFrame, path: str, extra: tuple[str, ...] = (), compression: str | None = None) -> None:
    """chrom, start, end and further columns as tab-separated lines; a gc column with four decimals."""
    cells = [F.format_string("%.4f", F.col(c)) if c == "gc" else F.col(c).cast("string") for c in ("chrom", "start", "end", *extra)]
    lines = df.select(F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in cells]).alias("value"))
    writer = lines.write.mode("errorifexists")
    (writer.option("compression", compression) if compression else writer).text(path)


def write_bundles(df: DataFrame, path: str, file: str = "file", order: str = "line_no", value: str = "value") -> None:
    """The lines of many small files, in order, as a few large ones that sources.lines.bundled_lines reads.

    Each small file begins with a line of "==> " and its name. Lines and names that begin so or with a backslash, and empty ones, get a backslash. A file for each
    of them would cost a file's opening, listing and task for some KB.
    """
    def escaped(c):
        return F.when((c == "") | F.startswith(c, F.lit(MARK)) | F.startswith(c, F.lit(ESCAPE)), F.concat(F.lit(ESCAPE), c)).otherwise(c)
    inside = Window.partitionBy("_file").orderBy("_order")
    rows = df.select(F.col(file).cast("string").alias("_file"), F.col(order).alias("_order"), escaped(F.col(value)).alias("_line"))
    numbered = rows.withColumn("_n", F.row_number().over(inside))
    head = F.when(F.col("_n") == 1, F.concat(F.lit(MARK), escaped(F.col("_file")), F.lit("\n"))).otherwise("")
    numbered.select(F.concat(head, "_line").alias("value")).write.text(path)


def write_negatives(df: DataFrame, path: str) -> None:
    """Negative windows as BED: neg_1, neg_2, ... in genome order, with their GC share."""
    named = number_rows(df).withColumn("name", F.concat(F.lit("neg_"), F.col("k").cast("string")))
    write_bed(named, path, ("name", "gc"))


def write_fasta(df: DataFrame, path: str, key: str = "id", seq: str = "seq") -> None:
    df.select(F.concat(F.lit(">"), F.col(key).cast("string"), F.lit("\n"), F.col(seq)).alias("value")).write.text(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A score or summary table as Parquet or CSV."""
    if fmt == "csv":
        df.write.csv(path, header=True)
    else:
        df.write.format(fmt).save(path)


def write_meme(pfms: DataFrame, path: str, motif: str = "motif") -> None:
    """Motifs as MEME text with six decimals and even background; nsites is the least covered column's count.

    pfms has motif, pos, base, prob and nsites. A motif library is small: one file.
    """
    wide = pfms.groupBy(motif, "pos").agg(
        F.max("nsites").alias("n"), *[F.max(F.when(F.col("base") == b, F.col("prob"))).alias(b) for b in "ACGT"])
    line = F.concat(F.lit(" "), F.concat_ws(" ", *[F.format_string("%.6f", F.col(b)) for b in "ACGT"]))
    blocks = wide.groupBy(motif).agg(
        F.sort_array(F.collect_list(F.struct("pos", line.alias("l")))).alias("rows"), F.min("n").cast("long").alias("n"))
    text = F.concat(F.lit("MOTIF "), F.col(motif).cast("string"), F.lit("\nletter-probability matrix: alength= 4 w= "),
                    F.size("rows").cast("string"), F.lit(" nsites= "), F.col("n").cast("string"), F.lit(" E= 0\n"),
                    F.array_join(F.transform("rows", lambda r: r["l"]), "\n"), F.lit("\n"))
    head = ("MEME version 4\n\nALPHABET= ACGT\n\nstrands: + -\n\nBackground letter frequencies\n"
            "A 0.25 C 0.25 G 0.25 T 0.25\n")
    rows = blocks.select(F.lit(1).alias("o"), F.col(motif).cast("string").alias("m"), text.alias("value"))
    first = pfms.sparkSession.range(1).select(F.lit(0).alias("o"), F.lit("").alias("m"), F.lit(head).alias("value"))
    first.unionByName(rows).repartition(1).sortWithinPartitions("o", "m").select("value").write.text(path)


def write_track(windows: DataFrame, lengths: DataFrame, width: int, step: int, path: str) -> None:
    """Windows as bedGraph lines that do not overlap."""
    t = track_intervals(windows, lengths, width, step)
    t.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), F.col("value").cast("string"))
             .alias("value")).write.text(path)


def write_dataset(df: DataFrame, path: str) -> None:
    """A split dataset as Parquet, one folder per split."""
    df.write.partitionBy("split").parquet(path)


def write_manifest(variants: DataFrame, path: str) -> None:
    """Every input variant with its status and window, as JSON lines."""
    variants.write.json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all appends; a metric that some of them lack is NULL there."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def append_metrics(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Adds rows to a metrics table; a new metric is a new column, NULL in the older rows. A metric keeps its type.

    Rows are appended as files of their own and become visible when their write commits; nothing is rewritten.
    """
    rows.write.mode("append").parquet(path)


def params_digest(params: dict) -> str:
    return hashlib.sha1(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]


def write_resumable(work: DataFrame, path: str, params: dict, compute: Callable[[DataFrame], DataFrame],
                    chunk: str = "chunk") -> int:
    """Computes and writes the chunks of work that are not complete yet; returns how many there were.

    work has the chunk column; compute gives one row per work row, with the chunk. A chunk is complete when
    it holds as many rows under the digest of the parameters; chunks of other parameters are left alone.
    """
    spark, digest = work.sparkSession, params_digest(params)
    wanted = work.groupBy(chunk).agg(F.count(F.lit(1)).alias("_wanted"))
    try:
        have = (spark.read.parquet(path).where(F.col("params_digest") == digest)
                .groupBy(F.col(chunk).cast(work.schema[chunk].dataType).alias(chunk)).agg(F.count(F.lit(1)).alias("_have")))
        wanted = wanted.join(have, chunk, "left").where(F.coalesce("_have", F.lit(0)) < F.col("_wanted"))
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
            raise
    todo = stored(wanted.select(chunk))      # stored, as the table that it was found from is written to
    n = todo.count()
    if n:
        rows = compute(work.join(todo, chunk, "left_semi")).withColumn("params_digest", F.lit(digest))
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("params_digest", chunk).parquet(path))
    return n


def read_resumable(spark: SparkSession, path: str, params: dict) -> DataFrame:
    """The rows of the chunks written under these parameters."""
    return spark.read.parquet(path).where(F.col("params_digest") == params_digest(params)).drop("params_digest")
