"""Contig names: chr1 and 1 name one chromosome, and so do chrM, MT and M."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contig_key(col) -> Column:
    """One spelling for all the names of a chromosome."""
    col = F.col(col) if isinstance(col, str) else col
    bare = F.when(col.startswith("chr"), F.substring(col, 4, 1 << 30)).otherwise(col)
    return F.when(bare.isin("M", "MT"), F.lit("MT")).otherwise(bare)


def name_priority(asked, present) -> Column:
    """How well a present contig name fits the one asked for; smaller is better.

    The exact name first, then the bare one, then the one with chr, then the mitochondrial names
    MT, chrM, M.
    """
    asked = F.col(asked) if isinstance(asked, str) else asked
    present = F.col(present) if isinstance(present, str) else present
    bare = F.when(asked.startswith("chr"), F.substring(asked, 4, 1 << 30)).otherwise(asked)
    return (F.when(present == asked, 0).when(present == bare, 1)
            .when(present == F.concat(F.lit("chr"), bare), 2)
            .when(present == "MT", 3).when(present == "chrM", 4).otherwise(5))


def resolve_contig(names: DataFrame, contigs: DataFrame, name: str = "chrom") -> DataFrame:
    """(name, contig) for the distinct names of a table; contig is NULL when none fits.

    names is reduced to its distinct values first, so the work after the first aggregation grows
    with the number of contigs, not of rows.
    """
    asked = names.select(F.col(name).alias("name")).distinct().withColumn("_key", contig_key("name"))
    have = contigs.select(F.col("chrom").alias("contig")).distinct().withColumn(
        "_key", contig_key("contig"))
    return (asked.join(have, "_key", "left")
            .groupBy("name").agg(F.min_by("contig", name_priority("name", "contig")).alias("contig")))
