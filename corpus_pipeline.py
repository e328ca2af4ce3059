"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Quality classifier, line dedup, near-duplicate removal, benchmark decontamination, SentencePiece encoding. A stage works on all that
the one before it kept. The first four return the columns of documents. Null texts count as empty, and keep their row
unless a stage drops it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm import decontaminate, jaccard, lines, pieces, quality
from lociframe.llm.common import read, with_small_batches
from lociframe.llm.queries import ORACLES, QUERIES, VOCABULARY
from lociframe.session import configure, stored

__all__ = ["ORACLES", "ORACLE_SQL", "QUERIES", "STAGES", "run"]


def _ready(spark: SparkSession) -> SparkSession:
    return with_small_batches(configure(spark))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of these documents, scores at 0.5 or more."""
    _ready(spark)
    model = quality.fit(docs, quality.quality_labels(read(spark, sf_dir, "labels")))
    return docs.filter(quality.scorer(model)(F.col("text")) >= 0.5)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines; one that consists of such copies alone goes."""
    _ready(spark)
    out = lines.dedup_lines(docs)
    lost = F.size("removed_lines") > 0
    out = out.filter(~lost | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.when(lost, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    _ready(spark)
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    _ready(spark)
    return decontaminate.clean(docs, decontaminate.split_items(read(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids, decoded_sha256, exact."""
    _ready(spark)
    return pieces.encode(docs, pieces.load(VOCABULARY))


STAGES = [("quality classifier", keep_quality), ("line dedup", cut_repeated_lines), ("n-gram Jaccard join", keep_one_of_each),
          ("benchmark decontamination", drop_contaminated), ("SentencePiece encoding and decoding", encode)]

#: The classifier, the pruned join and the pieces are no SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = read(_ready(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES["pipeline"] = run
