"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.session import stored


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_small_batches(spark: SparkSession) -> SparkSession:
    """Long texts come in small Arrow batches, so that a Python worker holds few of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return spark


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, whatever else a table holds; a null text is an empty one."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_crc(column: str) -> Column:
    """crc32 of a value written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def with_key(docs: DataFrame) -> DataFrame:
    """docs with _d, doc_id without nulls, and _h, a hash of the text: together they name a document.

    Rows repeated with one id and one text are one document listed twice, and have one key.
    """
    return docs.withColumns({"_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")), "_h": F.xxhash64("text")})


def join_measured(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", width: Column | int = 32, limit: int = 16 << 20) -> DataFrame:
    """big joined to a stored table: broadcast where its rows, of `width` bytes each, come to `limit` bytes at most, shuffled otherwise."""
    size = small.agg(F.sum(F.lit(width) if isinstance(width, int) else width)).first()[0] or 0
    return big.join(F.broadcast(small) if size <= limit else small, on, how)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of edges (u, v); root is the least node. Nodes without an edge are absent.

    Alternating stars: every node's larger neighbours are hung on its least neighbour, then its smaller ones,
    until nothing moves. No step gathers a neighbourhood; each writes its table to the shared folder.
    """
    now = stored(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen
