"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings. Broadcasts are left to Spark: a side is broadcast only when its size, known
# from statistics or measured by AQE, is below spark.sql.autoBroadcastJoinThreshold.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A task of a shuffle gets at most about this much: many parts to begin with, put together up to the size. Parts are never cut
    # for windows and groups, so with a fixed number of them a task's memory would grow with the input.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1024",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL_FOLDERS: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where none is set, a local session, as in tests, gets a temporary one, removed when Python ends; a cluster is an
    error, because its executors share no local folder.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[sc.applicationId] = folder = tempfile.mkdtemp(prefix="lociframe-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _LOCAL_FOLDERS[sc.applicationId]


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet to the shared folder and read back.

    For a table that several later steps read: it is computed once, later steps read only the
    columns they need, and a lost executor costs no recomputation of what came before. What was shuffled for it is removed
    once it is written; else the shuffles of all stored steps would stay until the driver collects garbage.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)      # bases take two bits, where snappy leaves a byte
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
