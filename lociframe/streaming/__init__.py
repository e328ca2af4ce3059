"""A call log followed while it is written.

A log is the one input that grows while it is read; parsing, status and phases are row functions, so the batch
operators serve a stream unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from lociframe.operators.events import call_status, label_phase
from lociframe.sources.logs import parse_calls


def follow_call_log(spark: SparkSession, folder: str, rules: Sequence[tuple[str, str]] = (),
                    files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame of the entries of a folder of JSON-lines logs, with status and phase."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = parse_calls(reader.text(folder)).where("not bad").drop("bad")
    return label_phase(call_status(rows), rules)
