"""Equi-joins that survive a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner",
                row_key: Column | None = None, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """left join right on the keys, with every key of more than hot_rows left rows cut into parts.

    The left rows per key are counted first (partial aggregation, key columns only); the table of
    hot keys has at most rows/hot_rows rows. A hot key's left rows get a salt from a hash of
    row_key, so a retried task sends each row to the same place, and the right rows of only
    that key are repeated once per part. Keys below the limit are joined as they are. Copies of
    one row share a salt; AQE's skew join, which cuts by map output, splits those.
    how is inner or left. hot_rows None is for left rows whose number per key is bounded already.
    """
    if hot_rows is None:
        return left.join(right, on, how)
    sizes = (left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
             .where(F.col("_rows") > hot_rows)
             .select(*on, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_parts")))
    salt = F.xxhash64(*[F.col(c) for c in left.columns]) if row_key is None else F.xxhash64(row_key)
    salted = (left.join(sizes, on, "left")
              .withColumn("_salt", F.when(F.col("_parts").isNull(), F.lit(0))
                          .otherwise(F.pmod(salt, F.col("_parts").cast("long")).cast("int")))
              .drop("_parts"))
    copies = (right.join(sizes, on, "left")
              .withColumn("_salt", F.explode(
                  F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
              .drop("_parts"))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def grid_join(left: DataFrame, right: DataFrame, on: list[str], left_key: Column | None = None, right_key: Column | None = None,
              hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Inner join in which a key of more than hot_rows rows on either side is cut on that side.

    One joint count gives the rows of a key on both sides. A hot key's left rows fall into parts by a hash of left_key, its right rows
    by one of right_key, and each part of the one side meets each of the other: a grid of tasks, in which every pair
    of rows comes together once. A task so holds at most about hot_rows of a side, a row is repeated once per part of the other side, and keys
    below the limit are joined as they are. Rows with a NULL key meet nothing.
    """
    if hot_rows is None:
        return left.join(right, on)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    counted = (left.select(*on, one.alias("_l"), zero.alias("_r")).unionByName(right.select(*on, zero.alias("_l"), one.alias("_r")))
               .groupBy(*on).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r")))
    sizes = (counted.where((F.col("_l") > hot_rows) | (F.col("_r") > hot_rows)).where((F.col("_l") > 0) & (F.col("_r") > 0))
             .select(*on, *[F.ceil(F.col(c) / hot_rows).cast("long").alias(f"_{side}_parts") for c, side in (("_l", "left"), ("_r", "right"))]))

    def dealt(df, side, other, key):
        salt = F.xxhash64(*[F.col(c) for c in df.columns]) if key is None else F.xxhash64(key)
        parts = F.coalesce(F.col(f"_{side}_parts"), one)
        return (df.withColumn("_salt", salt).join(sizes, on, "left").withColumn(f"_{side}", F.pmod("_salt", parts))
                .withColumn(f"_{other}", F.explode(F.sequence(zero, F.coalesce(F.col(f"_{other}_parts"), one) - 1)))
                .drop("_salt", "_left_parts", "_right_parts"))

    return (dealt(left, "left", "right", left_key).join(dealt(right, "right", "left", right_key), [*on, "_left", "_right"])
            .drop("_left", "_right"))


FEW_ROWS = 100_000


def join_few(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int = FEW_ROWS) -> DataFrame:
    """left join a table of contigs or the like, which is broadcast when it is counted to have at most `rows` narrow rows.

    A genome has few contigs, so a shuffle on their name would deal the left side to a handful of tasks. A table with more rows
    has more keys, and is joined by a shuffle.
    """
    return left.join(F.broadcast(right) if right.limit(rows + 1).count() <= rows else right, on, how)
