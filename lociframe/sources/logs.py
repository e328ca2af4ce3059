"""Training metric logs and call logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociframe.sources.lines import bundled_lines, numbered_lines

CALL_SCHEMA = ("timestamp string, tool string, arguments string, seconds double, is_error boolean, result string, "
               "_corrupt string")


def read_metric_logs(spark: SparkSession, path, max_metrics: int = 10_000, bundled: bool = False) -> DataFrame:
    """file, row_no (from 0) and the metrics of many CSV logs as text; a metric a log lacks is NULL, a blank one too.

    Each line is joined with its own file's header, so logs of differing columns are read in one job. bundled: the logs stand one after the
    other in bundles (sources.lines.bundled_lines), as many files of some KB should.
    """
    lines = (bundled_lines if bundled else numbered_lines)(spark, path).where(F.col("value") != "")
    header = lines.where(F.col("line_no") == 1).select("file", F.split("value", ",").alias("_h"))
    found = header.select(F.explode("_h").alias("name")).distinct().orderBy("name").limit(max_metrics + 1).collect()
    if len(found) > max_metrics:
        raise ValueError(f"the logs name more than {max_metrics} metrics")
    names = [r["name"] for r in found]
    rows = lines.where(F.col("line_no") > 1).join(header, "file")
    parts = F.split("value", ",", -1)
    cells = F.map_from_entries(F.filter(F.arrays_zip(F.col("_h").alias("k"), parts.alias("v")), lambda x: x["k"].isNotNull()))
    return rows.select("file", (F.col("line_no") - 2).alias("row_no"), cells.alias("_m")).select(
        "file", "row_no", *[F.when(F.trim(F.try_element_at("_m", F.lit(n))) != "", F.trim(F.try_element_at("_m", F.lit(n)))).alias(n)
                            for n in names])


def canonical_json(text) -> Column:
    """JSON text with sorted keys and no spaces, so that equal values have equal texts; other text as it is."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def parse_calls(lines: DataFrame) -> DataFrame:
    """Call-log entries out of text lines (value): the fields, arguments and result as JSON text, ts_ms, and
    bad for a line that is no JSON object."""
    entry = F.from_json("value", CALL_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    fields = ("timestamp", "tool", "arguments", "seconds", "is_error", "result")
    rows = lines.where(F.trim("value") != "").withColumn("e", entry)
    bad = ~F.ltrim("value").startswith("{") | F.col("e").isNull() | F.col("e._corrupt").isNotNull()
    ts = F.unix_millis(F.col("e.timestamp").try_cast("timestamp"))
    return (rows.select("*", *[F.col(f"e.{f}").alias(f) for f in fields], ts.alias("ts_ms"), bad.alias("bad")).drop("e", "value")
            .withColumn("arguments", canonical_json("arguments")))


def read_call_log(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """The entries with call_id, their order in the logs (files by name), and one row with the number of bad lines."""
    lines = numbered_lines(spark, path)
    files = lines.groupBy("file").agg(F.max("line_no").alias("_n"))          # one row per file
    before = F.sum("_n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("file", F.coalesce(before, F.lit(0)).alias("_before"))
    rows = parse_calls(lines)
    good = rows.where(~F.col("bad")).drop("bad").join(F.broadcast(starts), "file")
    return (good.withColumn("call_id", F.col("_before") + F.col("line_no")).drop("_before", "line_no"),
            rows.agg(F.count_if("bad").alias("bad_lines")))
