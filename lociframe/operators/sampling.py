"""Exact, reproducible sampling by hash order.

Every draw orders rows by md5(seed:key). The result is the same on any number of partitions and
in any engine, has exactly the size asked for, and is not the draw of a numpy generator. Keys
must identify rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.operators.joins import join_few
from lociframe.session import stored

PREFIX = 4   # hex digits: 65,536 equal buckets, so a border's task ranks a 65,536th of a group


def hash_order(seed, key) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_cuts(df: DataFrame, key, seed, quotas: DataFrame, names: Sequence[str],
              by: Sequence[str] = ()) -> DataFrame:
    """For each group and each quota column, the hash of the quota-th row in hash order.

    quotas has one row per group (columns by and names). A row belongs to the first quota rows of
    its group exactly when its hash is <= the cut; a quota of 0 gives '', one of the group's size
    or more gives 'g', which is above every hash. Only counts per hash prefix and the rows of the
    prefixes that hold a cut are ordered, so no task orders a whole group.
    """
    by, names = list(by), list(names)
    quotas = quotas.select(*by, *names)

    def quota(q):
        return F.col(q) if by else quotas.select(q).scalar()

    rows = df.select(*by, hash_order(seed, key).alias("_h")).withColumn(
        "_p", F.substring("_h", 1, PREFIX))
    counts = rows.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*by, F.lit(0)).orderBy("_p")   # at most 65,536 rows a group
    upto = counts.withColumn("_upto", F.sum("_n").over(order)).withColumn(
        "_before", F.col("_upto") - F.col("_n"))
    if by:
        upto = upto.join(quotas, by)
    holds = F.lit(False)
    for q in names:
        holds = holds | ((F.col("_before") < quota(q)) & (quota(q) <= F.col("_upto")))
    # At most one row per group and quota: a shuffle on these keys would deal the rows to a task per group.
    edges = stored(upto.where(holds).select(*by, "_p", "_before", *(names if by else [])))
    inside = Window.partitionBy(*by, "_p").orderBy("_h")
    ranked = join_few(rows, edges, [*by, "_p"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(inside))
    found = ranked.groupBy(*by).agg(
        *[F.max(F.when(F.col("_rank") == quota(q), F.col("_h"))).alias(f"_cut_{q}") for q in names])

    def cut(q):
        return (F.when(quota(q) <= 0, F.lit(""))
                .otherwise(F.coalesce(F.col(f"_cut_{q}"), F.lit("g"))).alias(q))

    both = quotas.join(found, by, "left") if by else found
    return both.select(*by, *[cut(q) for q in names])


def take_by_hash(df: DataFrame, key, seed, quotas: DataFrame, quota: str = "quota",
                 by: Sequence[str] = ()) -> DataFrame:
    """The first quota rows of every group in hash order; groups without a quota give none."""
    by = list(by)
    cuts = hash_cuts(df, key, seed, quotas, [quota], by).withColumnRenamed(quota, "_cut")
    if not by:
        return df.where(hash_order(seed, key) <= cuts.scalar())
    return join_few(df, stored(cuts), by).where(hash_order(seed, key) <= F.col("_cut")).drop("_cut")


def sample_n(df: DataFrame, n: int, key, seed=42) -> DataFrame:
    """n rows without replacement, or all of them when there are no more than n."""
    quotas = df.sparkSession.range(1).select(F.lit(n).cast("long").alias("quota"))
    return take_by_hash(df, key, seed, quotas)
