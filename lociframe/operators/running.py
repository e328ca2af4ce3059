"""Running sums, maxima and counts along an order, of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.operators.joins import join_few
from lociframe.session import stored

PART_ROWS = 200_000   # rows of one group that are gone through together

_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min}


def _joined(kind: str, own: Column, carried: Column) -> Column:
    if kind == "sum":
        return own + F.coalesce(carried, F.lit(0))
    return F.greatest(own, carried) if kind == "max" else F.least(own, carried)


def running(df: DataFrame, by: Sequence[str], order: Sequence, what: dict[str, tuple[str, Column]], part_rows: int | None = None,
            most: int | None = None) -> DataFrame:
    """df with, per entry of what, the sum, max or min of a column up to and with each row of its group.

    The rows are cut along (by, order) into parts of bounded size, whose borders Spark's range partitioning takes from the
    data; windows run inside a part, and what a group has in its earlier parts is carried over, one row per part and
    group that reaches over a border. The order should be total within a group. most is a bound on the rows, where the
    caller knows one; without it they are stored and counted.
    """
    by, size = list(by), part_rows or PART_ROWS
    rows = df.withColumns({f"_{k}": c for k, (_, c) in what.items()})
    whole = most is not None and most <= size
    if not whole:
        rows = stored(rows)
        parts = -(-rows.count() // size)
        whole = parts <= 1
    if not whole:
        rows = stored(rows.repartitionByRange(2 * parts, *by, *order).withColumn("_part", F.spark_partition_id()))
    keys = by if whole else [*by, "_part"]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({k: _AGGREGATES[kind](f"_{k}").over(inside) for k, (kind, _) in what.items()}).drop(*[f"_{k}" for k in what])
    if whole:
        return out
    totals = rows.groupBy(*keys).agg(*[_AGGREGATES[kind](f"_{k}").alias(f"_{k}") for k, (kind, _) in what.items()])
    # Of each part only its first and its last group can reach over a border.
    several = totals.withColumn("_parts", F.count(F.lit(1)).over(Window.partitionBy(*by))).where("_parts > 1")
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = stored(several.select(*keys, *[_AGGREGATES[kind](f"_{k}").over(earlier).alias(f"_{k}") for k, (kind, _) in what.items()]))
    joined = join_few(out, carried, keys, "left")
    return stored(joined.withColumns({k: _joined(kind, F.col(k), F.col(f"_{k}")) for k, (kind, _) in what.items()}).select(*df.columns, *what))
